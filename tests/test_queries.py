import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def sql_names():
    return sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", sql_names())
def test_query_equals_its_sql(spark, duck, sf_dir, name, tmp_path):
    out = f"{tmp_path}/out"
    entry.queries()[name](spark, sf_dir).write.parquet(out)
    a, b = duck.sql(entry.oracle_sql()[name]), duckdb.sql(f"select * from '{out}/*.parquet'")
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda r: sorted([tuple(x) for x in r.select(*[f'"{c}"' for c in cols]).fetchall()], key=str)
    for x, y in zip(rows(a), rows(b), strict=True):
        assert all(p == q or isinstance(p, float) and p == pytest.approx(q, abs=1e-6) for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
