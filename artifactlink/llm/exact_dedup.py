"""Exact dedup by skew-safe combining.

1. local: every task combines equal texts that it has read (map-side aggregation on digest, salt and full text);
2. salted: a digest's rows meet in one of `salts` places, by the task that read them, and equal texts combine;
3. global: the salts' winners of a digest meet and combine.

The full text is a grouping key of all three, so rows with the same digest and different texts never combine. A task
gets at most one row per distinct text from each task before it, however often a text occurs. Decisions then go back
to the rows by the class key (digest, length, second hash). Both sides of this join are written tables, one row a class
on the one, so that a class that holds many rows is split by AQE. Should texts share a class key, their rows meet their
class by the text itself instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize


def _classes(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text) -> keep_id, group_size, through local, salted and global combining."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _rows(docs: DataFrame, id_col: str, text_col: str, normalize, digest) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (normalize(text) if normalize else text).alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def _key(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("len"), F.xxhash64(text).alias("h2")]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 16,
    key: Callable[[Column], list[Column]] = _key,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The largest doc_id of equal texts stays. Null text counts as empty; a null doc_id loses to any other, and if all
    of a group are null keep_id is null and one row is kept. Of rows that repeat both doc_id and text, one is kept.
    Other columns of the input, whatever their names, play no part. An empty table gives no rows. `key` has the columns
    len and h2, which with the digest tell classes apart.
    """
    rows = _rows(docs, id_col, text_col, normalize, digest)
    classes = _classes(rows, salts)
    keyed = classes.groupBy("digest", *key(F.col("text"))).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    keyed = materialize(keyed.select(F.col("digest").alias("d"), F.col("len").alias("l"), F.col("h2").alias("h"), "keep_id", "group_size", "texts"), "dedup-classes")
    own = rows.select("doc_id", "digest", *key(F.col("text")), F.sha2("text", 256).alias("text_sha256"))
    ids = materialize(own.groupBy("doc_id", "digest", "len", "h2", "text_sha256").agg(F.count(F.lit(1)).alias("copies")), "dedup-rows")
    same = (F.col("digest") == F.col("d")) & (F.col("len") == F.col("l")) & (F.col("h2") == F.col("h"))
    joined = ids.join(keyed.where("texts = 1"), same)
    out = ["doc_id", "keep_id", "group_size", "text_sha256", "copies"]
    shared = keyed.where("texts > 1").select("d", "l", "h")
    if not shared.isEmpty():
        texts = classes.select("digest", F.col("text").alias("t"), *key(F.col("text")), "keep_id", "group_size").join(shared, same, "left_semi").select(F.col("digest").alias("g"), "t", "keep_id", "group_size")
        few = rows.groupBy("doc_id", "digest", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("text_sha256", F.sha2("text", 256))
        joined = joined.select(out).union(few.join(texts, (F.col("digest") == F.col("g")) & (F.col("text") == F.col("t"))).select(out))
    one = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return one.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The documents that stay, one per distinct text, with the columns of `docs`.

    The text comes from the combined classes and meets the other columns of the row that stays (the smallest such row
    where doc_id and text repeat) by (doc_id, class key). A text that stays is null only if its group has no empty text.
    Null counts as empty, a null doc_id loses to any other, an empty table stays empty, and further columns are carried
    along whatever their names.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = _rows(docs, id_col, text_col, None, sha256_hex)
    winners = materialize(_classes(rows, salts).select("keep_id", "digest", "text"), "dedup-winners")
    side = (
        docs.select(
            docs[id_col].alias("i"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("g"),
            F.struct(docs[text_col].isNull().alias("null_text"), *[docs[c].alias(c) for c in rest]).alias("s"),
        )
        .groupBy("i", "g")
        .agg(F.min("s").alias("s"))
    )
    out = winners.join(side, F.col("keep_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")))
    cols = {id_col: F.col("keep_id"), text_col: F.when(~F.col("s.null_text"), F.col("text"))} | {c: F.col(f"s.`{c}`") for c in rest}
    return out.select(*[cols[c].alias(c) for c in docs.columns])
