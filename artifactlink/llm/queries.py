"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from artifactlink.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.perplexity import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.jaccard_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.packing import pack_best_two_fit

    return pack_best_two_fit(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.licenses import license_scan

    return license_scan(read_table(spark, sf_dir, "documents")).drop("blocks")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.neural_lm import lm_scores

    return lm_scores(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactlink.llm.langid import language_id

    return language_id(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_jaccard_join, op3_exact_dedup, op4_best_fit_packing, op5_token_counts, op6_license_scan, op7_toxicity, op8_mixing, op9_lm_scores, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    """The other queries' results are those of trained models or tokenizers; tests hold them against brute force."""
    from artifactlink.llm import oracles

    return {"op3_exact_dedup": oracles.EXACT_DEDUP, "op6_license_scan": oracles.license_scan(), "op8_mixing": oracles.mixing()}
