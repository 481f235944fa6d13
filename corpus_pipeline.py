"""A corpus pipeline of five of the corpus operators: each stage works on all that the one before it kept.

1. toxicity: documents that score 0.5 or more go;
2. exact dedup: of equal texts the row with the largest doc_id stays;
3. n-gram Jaccard join (five words, 0.8): of linked documents the one with the smallest doc_id stays;
4. mixing sources to target weights: nine tenths of the tokens, dealt over domain, language and source;
5. best-fit packing into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from artifactlink.llm.common import materialize, read_table
from artifactlink.llm.exact_dedup import keep_one
from artifactlink.llm.jaccard_join import keep_smallest
from artifactlink.llm.mixing import mix_documents
from artifactlink.llm.packing import pack_best_two_fit
from artifactlink.llm.queries import tokenizer_path
from artifactlink.llm.toxicity import drop_toxic


#: Pre-tokens that a worker keeps the ids of. Here it shares its executor with what earlier stages left in the JVM.
PACKING_CACHE = 200_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_smallest(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_best_two_fit(docs, tokenizer_path(), cache=PACKING_CACHE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage is a trained network, which SQL can't express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
