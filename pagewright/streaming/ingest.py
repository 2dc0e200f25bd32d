"""Streams of documents: the batch transforms, run on micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.metadata import element_id

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, folder: str, max_files: int = 1000, **options: str) -> DataFrame:
    """Files as they arrive in a landing folder."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("maxFilesPerTrigger", max_files)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder).withColumn("doc_id", F.xxhash64("path"))


def rows(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(folder)


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def once_each(stream: DataFrame, text: str = "text", time: str = "modificationTime", delay: str = "1 hour") -> DataFrame:
    """Without texts that came before, within the watermark; the state is dropped behind it."""
    return timed(stream.withColumn("element_id", element_id(F.col(text))), time, delay).dropDuplicatesWithinWatermark(["element_id"])


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "1 hour", *keys: str) -> DataFrame:
    """Counts by window of time, late rows up to the watermark included."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed(stream, time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", **aggregates: Column) -> DataFrame:
    return timed(stream, time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])


def drain(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> DataStreamWriter:
    """A writer that takes what is there and ends; start it with ``start()``."""
    return stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True)
