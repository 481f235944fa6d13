"""Structured Streaming over a folder into which packages are dropped: each new file is decoded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from artifactlink.sources.containers import decode_blobs, dex_blobs

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def decoded_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded DEX files (sources.containers.DECODED) of `.apk` files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.apk").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(name.alias("app"), F.lit(0).cast("bigint").alias("part_ord"), name.alias("part_name"), "path", "content")
    return decode_blobs(dex_blobs(parts))


def on_arrival(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `handle` on what is there and not yet seen, then stops; progress is kept in `checkpoint`."""
    return decoded_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
