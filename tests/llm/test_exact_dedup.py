import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from artifactlink.llm.common import read_table
from artifactlink.llm.exact_dedup import exact_dedup, keep_one
from tests.llm.support import frame, odd_texts


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_odd_rows(spark):
    texts = odd_texts()
    rows = [(i, texts[i % 40]) for i in range(200)] + [(None, "a"), (None, "solo"), (None, "solo"), (7, "twice"), (7, "twice"), (7, "other"), (500, None), (501, "")]
    assert rows_of(exact_dedup(frame(spark, rows))) == brute(rows)


def test_weak_digest_compares_texts(spark):
    rows = [(i, "abcde"[i % 5] * 3) for i in range(50)]
    assert rows_of(exact_dedup(frame(spark, rows), digest=lambda t: F.length(t).cast("string"))) == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "n"), (None, "n"), (4, "b")]
    df = frame(spark, rows)
    out = keep_one(df)
    assert out.columns == df.columns
    assert rows_of(out.select("doc_id", "text", "source", "word")) == sorted([(2, "a", "src0", "w"), (3, None, "src0", "w"), (4, "b", "src0", "w"), (None, "n", "src0", "w")], key=str)


def test_empty_and_table(spark, sf_dir):
    assert exact_dedup(frame(spark, [])).count() == 0
    docs = read_table(spark, sf_dir, "documents")
    assert rows_of(exact_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
