"""Byte scans of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import scan


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", F.col("content").alias("data"))


def hits(stream: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """path, type, hit, value of each file, without state: it runs in append mode."""
    return scan.matches(stream, patterns or scan.PATTERNS, "path")


def printable(stream: DataFrame) -> DataFrame:
    return stream.select("path", F.octet_length("data").alias("size"), B.printable_ratio(F.col("data")).alias("printable_ratio"))
