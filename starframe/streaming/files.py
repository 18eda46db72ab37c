"""Newly arriving files as a stream: the same scans, since they keep no state across files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starframe.sources import files

#: What ``binaryFile`` gives.
SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(spark: SparkSession, path: str, pattern: str | None = None, scan: Callable[[DataFrame], DataFrame] = files.scan_hdus) -> DataFrame:
    """A stream of what ``scan`` finds in files as they come: HDU lists, or any other scan of files with their content."""
    read = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true")
    return scan(files.from_content((read.option("pathGlobFilter", pattern) if pattern else read).load(path)))
