"""Containers: paths to parts, parts to DEX blobs, blobs to class tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artifactlink.errors import ArtifactError, InputError
from artifactlink.schemas import CLASSES, PARTS
from artifactlink.sources import dex

BUNDLES = (".apks", ".xapk", ".apkm")
_DEX_NAME = re.compile(r"^classes([0-9]*)\.dex$")


def input_kind(path: str, is_dir: bool) -> str:
    """SplitDirectory, ApkFile or BundleArchive, by the path's form."""
    ext = PurePath(path).suffix.lower()
    if is_dir:
        return "SplitDirectory"
    if ext == ".apk":
        return "ApkFile"
    if ext in BUNDLES:
        return "BundleArchive"
    raise InputError(f"input type cannot be recognized: {path}")


def dex_ordinal(name: str) -> int | None:
    """classes.dex is 1, classes10.dex 10 (overflow: the largest); None for anything else, also in folders."""
    m = _DEX_NAME.match(name)
    return None if m is None else min(int(m.group(1) or 1), (1 << 63) - 1)


def manifest_package(data: bytes) -> str | None:
    """The package of a text or binary manifest, if it can be seen."""
    if data.startswith(b"<manifest"):
        m = re.search(rb'package="([^"]*)"', data)
        return m.group(1).decode("utf-8", "replace") if m else None
    at = data.find(b"package")
    if at < 0:
        return None
    m = re.search(rb"[A-Za-z0-9._]+", data[at + len(b"package") :])
    text = m.group().decode() if m else ""
    return text if "." in text else None


def _open(data: bytes, name: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise InputError(f"file is not a readable APK/ZIP: {name}") from None


def bundle_parts(data: bytes, name: str) -> list[tuple[str, bytes]]:
    with _open(data, name) as z:
        parts = sorted((PurePath(n).name, z.read(n)) for n in z.namelist() if n.endswith(".apk"))
    if not parts:
        raise InputError(f"no APK parts found in input: {name}")
    return parts


def part_key(name: str) -> tuple[int, str]:
    return (0 if name == "base.apk" or name.endswith("!base.apk") else 1, name)


def resolve_parts(spark: SparkSession, path: str, app: str = "app") -> DataFrame:
    """schemas.PARTS of an input path, read by Spark: a file, a bundle, or a folder of both (not its subfolders)."""
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(hconf)
    if not fs.exists(where):
        raise InputError(f"input APK path does not exist: {path}")
    kind = input_kind(path, fs.getFileStatus(where).isDirectory())
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                name, suffix = PurePath(p).name, PurePath(p).suffix.lower()
                if suffix in BUNDLES:
                    lead = f"{name}!" if kind == "SplitDirectory" else ""
                    for part, data in bundle_parts(bytes(content), p):
                        yield pd.DataFrame({"app": [app], "part_ord": [0], "part_name": [lead + part], "path": [None], "content": [data]})
                elif suffix == ".apk":
                    yield pd.DataFrame({"app": [app], "part_ord": [0], "part_name": [name], "path": [p], "content": [bytes(content)]})

    parts = files.mapInPandas(explode, PARTS)
    base = F.when((F.col("part_name") == "base.apk") | F.col("part_name").endswith("!base.apk"), 0).otherwise(1)
    # an input has few parts: one row each in this window, contents included once
    return parts.withColumn("part_ord", F.row_number().over(Window.partitionBy("app").orderBy(base, "part_name")).cast("bigint") - 1)


BLOBS = "app string, part_ord bigint, apk_part string, dex_file string, dex_ord bigint, package_name string, error string, content binary"


def dex_blobs(parts: DataFrame) -> DataFrame:
    """A row for each DEX file; a part without any, or that can't be read, has a row with `error`."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                row = {"app": r.app, "part_ord": r.part_ord, "apk_part": r.part_name, "dex_file": None, "dex_ord": None, "package_name": None, "error": None, "content": None}
                try:
                    with _open(bytes(r.content), r.part_name) as z:
                        names = set(z.namelist())
                        row["package_name"] = manifest_package(z.read("AndroidManifest.xml")) if "AndroidManifest.xml" in names else None
                        found = sorted((k, n) for n in names if (k := dex_ordinal(n)) is not None)
                        if not found:
                            yield pd.DataFrame([row | {"error": f"no DEX files found in {r.part_name}"}])
                        for k, n in found:
                            yield pd.DataFrame([row | {"dex_file": n, "dex_ord": k, "content": z.read(n)}])
                except ArtifactError as e:
                    yield pd.DataFrame([row | {"error": str(e)}])

    return parts.mapInPandas(explode, BLOBS)


DECODED = f"app string, part_ord bigint, apk_part string, dex_file string, dex_ord bigint, package_name string, bytes bigint, version string, error string, n_classes bigint, n_methods bigint, n_fields bigint, sizes map<string,bigint>, warnings array<string>, classes array<struct<{CLASSES.replace(' array', ':array').replace(' bigint', ':bigint').replace(' string', ':string').replace(' struct', ':struct')}>>"


def decode_blobs(blobs: DataFrame, members: bool = True) -> DataFrame:
    """Each blob decoded by one task; `error` says why one could not be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                row = {"app": r.app, "part_ord": r.part_ord, "apk_part": r.apk_part, "dex_file": r.dex_file, "dex_ord": r.dex_ord, "package_name": r.package_name, "bytes": len(r.content or b""), "version": None, "error": r.error}
                row |= {"n_classes": 0, "n_methods": 0, "n_fields": 0, "sizes": {}, "warnings": [], "classes": []}
                if r.error is None:
                    try:
                        d = dex.decode(bytes(r.content), r.apk_part, r.dex_file, 0, members)
                        row |= {"version": d["version"], "n_classes": len(d["classes"]), "n_methods": d["methods"], "n_fields": d["fields"], "sizes": d["sizes"], "warnings": d["warnings"], "classes": d["classes"]}
                    except ArtifactError as e:
                        row["error"] = str(e)
                yield pd.DataFrame([row])

    return blobs.mapInPandas(run, DECODED)


def app_classes(decoded: DataFrame) -> DataFrame:
    """schemas.CLASSES with ids that run over the app's files in order. Offsets are sums over one small row per file."""
    files = decoded.where("dex_file is not null").select("app", "part_ord", "dex_ord", "dex_file", "apk_part", "n_classes", "n_methods", "n_fields")
    before = Window.partitionBy("app").orderBy("part_ord", "dex_ord", "dex_file").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
    index = (F.row_number().over(Window.partitionBy("app").orderBy("part_ord", "dex_ord", "dex_file")) - 1).cast("bigint").alias("dex_index")
    offsets = files.select("app", "apk_part", "dex_file", start("n_classes"), start("n_methods"), start("n_fields"), index)
    x = decoded.select("app", "apk_part", "dex_file", F.explode("classes").alias("c")).join(offsets, ["app", "apk_part", "dex_file"])
    moved = lambda col, by: F.transform(col, lambda m: m.withField("id", m["id"] + F.col(by)))
    return x.select(
        "app", (F.col("c.id") + F.col("n_classes_before")).alias("id"), "c.descriptor", "c.access_flags", "c.superclass", "c.interfaces",
        moved(F.col("c.methods"), "n_methods_before").alias("methods"), moved(F.col("c.fields"), "n_fields_before").alias("fields"),
        F.col("c.origin").withField("dex_index", F.col("dex_index")).alias("origin"),
    )


def app_package(decoded: DataFrame) -> str | None:
    """The first package that a part with DEX files names."""
    row = decoded.where("package_name is not null and dex_file is not null").orderBy("part_ord").select("package_name").first()
    return row.package_name if row else None
