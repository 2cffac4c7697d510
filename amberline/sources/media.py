"""Blobs: files read as binary rows, cut into segments, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bytes of a segment.
SEGMENT = 1 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """id (SHA-256), path, size and bytes of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("id"), "path", F.col("length").alias("size"), F.col("content").alias("bytes"))


def listing(media: DataFrame) -> DataFrame:
    """What is known without the bytes, which are not read."""
    return media.select("id", "path", "size").orderBy("path")


def stat(media: DataFrame, blob: str) -> DataFrame:
    """Size and number of segments of one blob."""
    return media.where(F.col("id") == blob).select("id", "path", "size", F.greatest(F.ceil(F.col("size") / SEGMENT), F.lit(1)).alias("segments"))


def part(data: Column, offset: int, size: int | None = None) -> Column:
    """A range of bytes, from 0."""
    return F.substring(data, offset + 1, size if size is not None else 1 << 30)


def segments(media: DataFrame, size: int = SEGMENT) -> DataFrame:
    """id, seq and bytes; an empty blob has one empty segment."""
    n = F.greatest(F.ceil(F.octet_length("bytes") / size), F.lit(1)).cast("int")
    at = media.select("id", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return at.select("id", "seq", F.substring("bytes", F.col("seq") * size + 1, F.lit(size)).alias("bytes"))


def assembled(parts: DataFrame) -> DataFrame:
    """Blobs from their segments in order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "bytes")))
    joined = F.aggregate(ordered, F.lit(b""), lambda all_, x: F.concat(all_, x["bytes"]))
    return parts.groupBy("id").agg(joined.alias("bytes"))
