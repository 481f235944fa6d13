"""Coverage of an input: files, parts and totals. Errors are recorded, never raised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dex_rows(decoded: DataFrame) -> DataFrame:
    size = lambda k: F.coalesce(F.try_element_at("sizes", F.lit(k)), F.lit(0)).alias(f"{k}_ids" if k != "classes" else "class_defs")
    return decoded.where("dex_file is not null").select(
        "part_ord", "apk_part", "dex_file", "dex_ord", "bytes", F.col("version").isNotNull().alias("parsed"), "version", F.col("n_classes").alias("classes"),
        F.col("n_methods").alias("methods"), F.col("n_fields").alias("fields"), F.size("warnings").cast("bigint").alias("warnings"), "error",
        *[size(k) for k in ("strings", "types", "protos", "fields", "methods", "classes")],
    )


def totals(parts: DataFrame, decoded: DataFrame) -> DataFrame:
    d = dex_rows(decoded)
    read = decoded.where("dex_file is not null").select("apk_part").distinct().agg(F.count(F.lit(1)).alias("readable_parts"))
    sums = d.agg(
        F.count(F.lit(1)).alias("dex_files"), F.count_if("parsed").alias("parsed_dex_files"), F.count_if(~F.col("parsed")).alias("failed_dex_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "classes", "methods", "fields", "warnings")],
    )
    return parts.agg(F.count(F.lit(1)).alias("parts")).join(read).join(sums)


def issues(decoded: DataFrame) -> DataFrame:
    """(issue): `part!file: message`, `-` for a part's own error; warnings too."""
    file = F.coalesce("dex_file", F.lit("-"))
    lines = F.concat(F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")), "warnings")
    x = decoded.select("part_ord", "dex_ord", "apk_part", file.alias("file"), F.posexplode(lines).alias("pos", "message"))
    return x.orderBy("part_ord", "dex_ord", "pos").select(F.concat_ws("", "apk_part", F.lit("!"), "file", F.lit(": "), "message").alias("issue"))


def roll_up(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Counts and sums at each level of the keys, with `level`: how many keys are given."""
    sums = [F.sum(m).alias(m) for m in measures]
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums, (F.lit(len(keys)) - sum((F.grouping(k).cast("int") for k in keys[1:]), F.grouping(keys[0]).cast("int"))).alias("level"))
