"""Bindings of relational tables to the fingerprint schema, in Spark and, beside each, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactlink.operators.fingerprint import as_set
from artifactlink.schemas import SETS

TOKEN = r"[^\s.,;:!?]+"
CUT = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Documents of even (0) or odd (1) ids with their distinct lower-case tokens as `strings`."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == side)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
    return d.select(F.col("doc_id").alias("class_id"), F.col("doc_id").cast("string").alias("descriptor"), F.coalesce(tokens, F.array().cast("array<string>")).alias("strings"))


DOC_SQL = rf"""
doc AS (SELECT doc_id, doc_id % 2 AS side, coalesce(list_distinct(regexp_extract_all(lower(text), '{TOKEN}')), []) AS toks FROM documents),
tok AS (SELECT doc_id, side, unnest(toks) AS token FROM doc),
useful AS (SELECT * FROM tok WHERE strlen(token) >= 4 AND NOT regexp_full_match(token, '[0-9]+')),
df AS (SELECT token, count(*) FILTER (side = 0) AS old_df, count(*) FILTER (side = 1) AS new_df FROM useful GROUP BY token),
rare AS (SELECT * FROM df WHERE old_df BETWEEN 1 AND 3 AND new_df BETWEEN 1 AND 3)"""


def suppliers(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Suppliers before or after the cut: features of their line items as sets; every third one is renamed afterwards."""
    l = table(spark, sf_dir, "lineitem")
    l = l.where(F.col("l_shipdate") >= CUT) if new else l.where(F.col("l_shipdate") < CUT)
    q, s = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey")
    value = {
        "interfaces": F.concat(F.lit("I"), "l_linestatus"), "method_shapes": F.concat("l_returnflag", F.lit("("), q, F.lit(")->"), "l_linestatus"),
        "method_proto_shapes": F.concat(F.lit("("), q, F.lit(")->"), "l_linestatus"), "field_shapes": F.concat(F.lit("m"), F.month("l_shipdate").cast("string"), F.lit(":"), "l_returnflag"),
        "field_type_shapes": F.concat(F.lit("flag"), "l_returnflag"), "strings": F.concat(F.lit("part-"), F.col("l_partkey").cast("string")),
        "method_ref_shapes": F.concat(F.lit("line"), F.col("l_linenumber").cast("string")), "field_ref_shapes": F.lit(None).cast("string"),
        "class_ref_shapes": F.concat(F.lit("Lsup/"), ((F.col("l_partkey") * 7 + s) % 100).cast("string"), F.lit(";")),
    }
    sets = l.groupBy("l_suppkey").agg(*[as_set(F.collect_set(value[k])).alias(k) for k in SETS], F.count(F.lit(1)).alias("instruction_count"))
    per_op = l.groupBy("l_suppkey", F.col("l_linenumber").alias("op")).agg(F.count(F.lit(1)).alias("n"))
    hist = per_op.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("op", "n"))).alias("opcode_histogram"))
    name = F.concat(F.lit("Lsup/"), F.when((s % 3 == 0) & F.lit(new), F.lit("N")).otherwise(F.lit("")), s.cast("string"), F.lit(";"))
    x = sets.join(hist, "l_suppkey").withColumn("s", s)
    flags = F.when((F.col("s") % 11 == 0) & F.lit(new), 0x200).otherwise(1).cast("bigint")
    return x.select(
        F.col("s").alias("class_id"), name.alias("descriptor"), F.lit("*").alias("package_shape"), (F.col("s") % 5).cast("string").alias("superclass"), flags.alias("access_flags"),
        *SETS, "instruction_count", "opcode_histogram",
    )


def supplier_sql(name: str, new: bool) -> str:
    """A CTE of the same columns; histograms as (op, n) lists sorted by op."""
    s = lambda e: f"list_sort(list_distinct(list({e})))"
    return f"""
{name}_h AS (SELECT l_suppkey, list({{'op': l_linenumber, 'n': n}} ORDER BY l_linenumber) AS h
  FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_shipdate {'>=' if new else '<'} TIMESTAMP '{CUT}' GROUP BY 1, 2) GROUP BY 1),
{name} AS (SELECT l_suppkey AS class_id, 'Lsup/' || {"CASE WHEN l_suppkey % 3 = 0 THEN 'N' ELSE '' END" if new else "''"} || l_suppkey || ';' AS descriptor, '*' AS package_shape,
  (l_suppkey % 5)::VARCHAR AS superclass, {"CASE WHEN l_suppkey % 11 = 0 THEN 512 ELSE 1 END" if new else "1"} AS access_flags,
  {s("'I' || l_linestatus")} AS interfaces, {s("l_returnflag || '(' || l_quantity::INT || ')->' || l_linestatus")} AS method_shapes,
  {s("'(' || l_quantity::INT || ')->' || l_linestatus")} AS method_proto_shapes, {s("'m' || month(l_shipdate) || ':' || l_returnflag")} AS field_shapes,
  {s("'flag' || l_returnflag")} AS field_type_shapes, {s("'part-' || l_partkey")} AS strings, {s("'line' || l_linenumber")} AS method_ref_shapes,
  []::VARCHAR[] AS field_ref_shapes, {s("'Lsup/' || ((l_partkey * 7 + l_suppkey) % 100) || ';'")} AS class_ref_shapes, count(*) AS instruction_count, any_value(h) AS opcode_histogram
  FROM lineitem JOIN {name}_h USING (l_suppkey) WHERE l_shipdate {'>=' if new else '<'} TIMESTAMP '{CUT}' GROUP BY l_suppkey)"""


def jaccard_sql(a: str, b: str, empty: float = 1.0) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty}::FLOAT ELSE ({shared}::DOUBLE / (len({a}) + len({b}) - {shared}))::FLOAT END"


def cosine_sql(a: str, b: str) -> str:
    dot = f"list_sum(list_transform({a}, lambda x: x.n::DOUBLE * coalesce(list_sum(list_transform(list_filter({b}, lambda y: y.op = x.op), lambda y: y.n::DOUBLE)), 0)))"
    norm = lambda h: f"sqrt(list_sum(list_transform({h}, lambda x: x.n::DOUBLE * x.n)))"
    return f"({dot} / ({norm(a)} * {norm(b)}))::FLOAT"
