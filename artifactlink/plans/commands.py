"""The commands over application packages: compare, inspect, audit, remap and query, as DataFrames and report files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactlink.errors import ArtifactError, AuditFailed, InputError, MappingError
from artifactlink.functions.predicates import PLATFORM_PREFIXES
from artifactlink.operators import audit as A
from artifactlink.operators import mapping as M
from artifactlink.operators.decide import MatchConfig, match_classes, match_exact
from artifactlink.operators.fingerprint import fingerprint
from artifactlink.operators.members import match_members
from artifactlink.sources import dex
from artifactlink.sources.containers import app_classes, app_package, decode_blobs, dex_blobs, resolve_parts


@dataclass
class App:
    """An input: its parts, decoded files and classes."""

    name: str
    parts: DataFrame
    decoded: DataFrame
    classes: DataFrame
    package: str | None

    def coverage(self) -> dict[str, int]:
        r = self.decoded.agg(
            F.count_if(F.col("dex_file").isNotNull()).alias("dex_files"), F.coalesce(F.sum("n_classes"), F.lit(0)).alias("parsed_classes"), F.coalesce(F.sum("n_methods"), F.lit(0)).alias("parsed_methods"),
            F.coalesce(F.sum("n_fields"), F.lit(0)).alias("parsed_fields"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warning_count"),
        ).first()
        return {"apk_parts": self.parts.count(), **r.asDict()}


def read_app(spark: SparkSession, path: str, members: bool = True) -> App:
    """A part without DEX files is left out; any other error of a part or a file stops the read."""
    name = path.rstrip("/").rpartition("/")[2]
    parts = resolve_parts(spark, path, name)
    decoded = decode_blobs(dex_blobs(parts), members).persist()
    bad = decoded.where("error is not null and error not like 'no DEX files found%'").select("apk_part", "dex_file", "error").first()
    if bad:
        raise ArtifactError(f"{bad.apk_part}!{bad.dex_file or '-'}: {bad.error}")
    if decoded.where("dex_file is not null").isEmpty():
        raise InputError(f"no DEX files found in {path}")
    return App(name, parts, decoded, app_classes(decoded), app_package(decoded))


@dataclass
class Comparison:
    old: App
    new: App
    config: MatchConfig
    classes: DataFrame
    methods: DataFrame | None
    fields: DataFrame | None


def compare(spark: SparkSession, old: str, new: str, config: MatchConfig = MatchConfig(), members: bool = False, low_memory: bool = False, strict_package: bool = True) -> Comparison:
    """Class match of two inputs, and with `members` those of methods and fields. Low memory: exact descriptors only."""
    a, b = read_app(spark, old, not low_memory), read_app(spark, new, not low_memory)
    if strict_package and a.package and b.package and a.package != b.package:
        raise InputError(f"package names differ: {a.package} vs {b.package}\nhint: use --no-strict-package if these APKs are still related")
    match = match_exact if low_memory else match_classes
    classes = match(fingerprint(a.classes), fingerprint(b.classes), config)
    pick = lambda kind: match_members(classes, a.classes, b.classes, kind, config) if members and not low_memory else None
    return Comparison(a, b, config, classes, pick("methods"), pick("fields"))


_SITES = (
    "apk_part string, dex_file string, pos bigint, kind string, owner string, name string, params array<string>, ret string, dispatch string, source_class string, source_method string, offset bigint, error string"
)
_DEFS = "apk_part string, dex_file string, what string, descriptor string, superclass string, interfaces array<string>, name string, params array<string>, ret string, is_static boolean, is_direct boolean, error string"


def _exploded(blobs: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    rows, error = rows_of(bytes(r.content)), None
                except ArtifactError as e:
                    rows, error = [{}], str(e)
                base = {"apk_part": r.apk_part, "dex_file": r.dex_file, "error": error}
                names = [c.split()[0] for c in schema.split(", ")]
                yield pd.DataFrame([{n: (base | row).get(n) for n in names} for row in rows], columns=names)

    return blobs.mapInPandas(run, schema)


def _site_rows(data: bytes) -> list[dict]:
    return [s | {"pos": i} for i, s in enumerate(dex.reference_sites(data))]


def _definition_rows(data: bytes) -> list[dict]:
    classes, methods, fields = dex.definitions(data)
    out = [{"what": "class", **c} for c in classes]
    out += [{"what": "method", "descriptor": m["owner"], **{k: m[k] for k in ("name", "params", "ret", "is_static", "is_direct")}} for m in methods]
    return out + [{"what": "field", "descriptor": f["owner"], "name": f["name"], "ret": f["type"], "is_static": f["is_static"]} for f in fields]


def audit_references(
    spark: SparkSession, target: str, source_dex: Sequence[str] = (), references: Sequence[str] = (), ignore: Sequence[str] = (), include: Sequence[str] = (), mapping: DataFrame | None = None
) -> DataFrame:
    """operators.audit.audit over the chosen DEX files of an input and standalone DEX files (sources and definitions)."""
    if not source_dex and not references:
        raise InputError("audit-refs requires at least one --source-dex or --references input")
    found = dex_blobs(resolve_parts(spark, target, "target")).persist()
    bad = found.where("error is not null and error not like 'no DEX files found%'").select("apk_part", "error").first()
    if bad:
        raise ArtifactError(f"{bad.apk_part}: {bad.error}")
    blobs = found.where("dex_file is not null").select("apk_part", "dex_file", "content", "part_ord", "dex_ord").withColumn("standalone", F.lit(False))
    chosen = F.lit(False)
    for s in source_dex:
        one = (F.concat("apk_part", F.lit("!"), "dex_file") == s) if "!" in s else (F.col("dex_file") == s)
        if blobs.where(one).isEmpty():
            raise InputError(f"audit source DEX selector(s) did not match the target bundle: {s}")
        chosen = chosen | one
    blobs = blobs.withColumn("source", chosen)
    for i, path in enumerate(references):
        # known by its whole path: files of one name in different folders stay apart
        extra = spark.read.format("binaryFile").load(path).select(F.lit("standalone").alias("apk_part"), F.lit(path).alias("dex_file"), "content")
        extra = extra.select("*", F.lit(1 << 40).cast("bigint").alias("part_ord"), F.lit(i).cast("bigint").alias("dex_ord"), F.lit(True).alias("standalone"), F.lit(True).alias("source"))
        blobs = blobs.unionByName(extra)
    blobs = blobs.persist()
    sites = _exploded(blobs.where("source"), _SITES, _site_rows)
    bad = sites.where("error is not null").select("apk_part", "dex_file", "error").first()
    if bad:
        raise InputError(f"cannot audit {bad.apk_part}!{bad.dex_file}: {bad.error}")
    order = blobs.select("apk_part", "dex_file", "standalone", F.struct("part_ord", "dex_ord", "dex_file").alias("load_ord"))
    sites = sites.join(order.select("apk_part", "dex_file", "standalone"), ["apk_part", "dex_file"])
    sites = sites.withColumn("site_id", F.concat_ws("!", "apk_part", "dex_file", F.col("pos").cast("string"))).withColumnsRenamed({"apk_part": "part", "dex_file": "dex"}).drop("error", "pos")
    defs = _exploded(blobs, _DEFS, _definition_rows).persist()
    bad = defs.where("error is not null").select("apk_part", "dex_file", "error").first()
    if bad:
        raise ArtifactError(f"{bad.apk_part}!{bad.dex_file}: {bad.error}")
    defs = defs.join(order.select("apk_part", "dex_file", "load_ord"), ["apk_part", "dex_file"])
    classes = defs.where("what = 'class'").select("descriptor", "load_ord", F.col("apk_part").alias("part"), F.col("dex_file").alias("dex"), "superclass", "interfaces")
    methods = defs.where("what = 'method'").select(F.col("descriptor").alias("owner"), "name", "params", "ret", "is_static", "is_direct", "load_ord")
    fields = defs.where("what = 'field'").select(F.col("descriptor").alias("owner"), "name", F.col("ret").alias("type"), "is_static", "load_ord")
    return A.audit(sites, classes, methods, fields, (*PLATFORM_PREFIXES, *ignore), include, mapping)


def require_pass(audited: DataFrame, allow_missing: int = 0) -> None:
    if not A.passes(audited, allow_missing):
        raise AuditFailed("reference audit found more unresolved references than allowed")


def load_replacements(spark: SparkSession, path: str, include_unsafe: bool = False) -> dict[str, str]:
    """old -> new descriptors of a mapping file (.json, or report and ProGuard text). A mapping comes from one file."""
    if path.endswith(".json"):
        from artifactlink.sources.reports import read_mapping

        m = read_mapping(spark, path)
        rows = M.json_replacements(m.matches, m.old, m.new, include_unsafe)
    else:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))
        rows = M.parse_mapping_lines(lines, include_unsafe)
    out = {r.old: r.new for r in M.normalize_replacements(rows).collect()}
    if not out:
        raise MappingError(f"no usable mappings in {path}")
    return out
