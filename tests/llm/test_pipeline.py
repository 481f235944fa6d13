import pytest

import corpus_pipeline as P
from artifactlink.llm import mixing
from artifactlink.llm.common import materialize, read_table
from artifactlink.llm.toxicity import toxicity
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_scans import brute_mix


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = read_table(spark, sf_dir, "documents"), []
    for name, stage in P.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
    return [*out, docs]


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes
    assert P.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark, sf_dir, steps):
    docs = [rows(df) for df in steps[:-1]]
    scored = toxicity(steps[0], read_table(spark, sf_dir, "labels"))
    assert sorted(r[0] for r in docs[1]) == sorted(r.doc_id for r in scored.where("predicted = 0").collect())
    last = {}
    for r in docs[1]:
        last[r[1]] = max(r, last.get(r[1], r), key=lambda x: x[0])
    assert sorted(docs[2]) == sorted(last.values())
    least = {d for d, _, c in brute_components([r[:2] for r in docs[2]], 5, 80) if d == c}
    assert sorted(r[0] for r in docs[3]) == sorted(least) and len(docs[3]) < len(docs[0])
    want = brute_mix(docs[3], 9, 10, 1, 20, mixing.WEIGHTS)
    assert sorted(r[0] for r in docs[4]) == sorted(r[0] for r in want)
    packed = steps[-1].collect()
    assert {r.doc_id for r in packed} == {r[0] for r in docs[4]}
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_run(spark, sf_dir, steps):
    assert sorted((r.doc_id, r.piece, r.length) for r in P.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.piece, r.length) for r in steps[-1].collect())
