"""Pipeline stages and shared helpers on odd inputs: clashing columns, nulls, repeated rows, empty tables."""

import pytest

from artifactlink.llm.common import byte_count, small_batches
from artifactlink.llm.exact_dedup import exact_dedup, keep_one
from artifactlink.llm.jaccard_join import keep_smallest
from artifactlink.llm.mixing import mix_documents
from artifactlink.llm.wordjoin import least_count
from pyspark.sql import functions as F
from tests.llm.support import frame
from tests.llm.test_exact_dedup import brute, rows_of

ROWS = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (None, "one two three four five six"), (5, "x"), (5, "x")]


def clashing(spark, rows):
    names = ("dropped_id", "cut_domain", "cut_lang", "component_id", "keep_id", "c", "key")
    return frame(spark, rows).withColumns({n: F.lit("z") for n in names})


@pytest.mark.parametrize("stage", [keep_one, keep_smallest, mix_documents])
def test_stages_keep_columns(spark, stage):
    options = {"bitmap_bits": 16} if stage is keep_smallest else {}
    df = clashing(spark, ROWS)
    out = stage(df, **options)
    assert out.dtypes == df.dtypes
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert set(ids) <= {1, 2, 3, 4, 5, None}
    if stage is keep_smallest:
        assert ids == [1, 3, 4, 5, 5, None]
    if stage is keep_one:
        assert ids == [2, 4, 5]
    empty = stage(clashing(spark, []), **options)
    assert empty.dtypes == df.dtypes and empty.count() == 0


def test_texts_that_share_a_class_key(spark):
    rows = [(i, "abcde"[i % 5] * 3) for i in range(50)] + [(None, "q")]
    weak = lambda t: [F.lit(1).alias("len"), F.lit(2).alias("h2")]
    assert rows_of(exact_dedup(frame(spark, rows), digest=lambda t: F.length(t).cast("string"), key=weak)) == brute(rows)


def test_sizes_and_batches(spark):
    assert [byte_count(x) for x in ("16m", "1g", "5KB", "77", "8b")] == [16 << 20, 1 << 30, 5 << 10, 77, 8]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16m")
    small_batches(spark.range(1))
    assert spark.conf.get(key) == str(4 << 20)
    spark.conf.set(key, before)


def test_least_count_bounds_the_head(spark):
    words = spark.range(1, 2001).select(F.col("id").alias("n"))
    for size in (1, 10, 300, 2000, 5000):
        assert words.where(F.col("n") >= least_count(words, size)).count() <= size
    assert least_count(words, 2000) <= 1 and words.where(F.col("n") >= least_count(words, 300)).count() > 150
