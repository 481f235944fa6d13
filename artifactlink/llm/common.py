"""Shared helpers of the corpus operators: table access, shared scratch space, row identity and Arrow batches."""

from __future__ import annotations

import contextlib
import copy
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that separate words in the `[^\x20\x09-\x0D]+` definition are exactly those `bytes.split()` splits on.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one serves a local session; a cluster has none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("artifactlink.scratch.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='artifactlink-')}"
        spark.conf.set("artifactlink.scratch.dir", where)
    return where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage is cut, and the size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and Python: what both sides hold at a time follows it.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Hold this session's Arrow batches to BATCH_BYTES, whatever their rows; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if byte_count(conf.get(key, str((1 << 31) - 1))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def byte_count(size: str) -> int:
    """Bytes of a Spark size: a number with k, m, g, t or p and b after it, or none of them."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow that, at a task's end, gives freed memory back to the system: workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def own_value(shared: Broadcast) -> Any:
    """A copy of a broadcast value that the task may change, and that its worker, which outlives it, doesn't keep."""
    if getattr(shared, "_path", None) is None:  # encrypted ones are read once
        return copy.deepcopy(shared.value)
    value = shared.value
    vars(shared).pop("_value", None)
    return value


def one_thread() -> None:
    """numpy's matrix products in this worker process use one thread: the others would only wait, and use up its core."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def project(docs: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under internal names, so that extra or clashing columns of the input never matter."""
    return docs.select(*[docs[c].alias(name) for name, c in columns.items()])


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if t is None else t for t in col.cast(pa.binary()).to_pylist()]


def pieces_of(batch: pa.RecordBatch, max_bytes: int = 4_000_000, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `max_bytes` of text each, so that working memory doesn't follow the batch size."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def row_base() -> int:
    """First row number of this task: numbers of different tasks never meet (2**33 rows a task)."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def heldout(id_col: Column, mod: int, rest: int) -> Column:
    """crc32(id as text) mod `mod` = `rest`; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest, F.lit(False))
