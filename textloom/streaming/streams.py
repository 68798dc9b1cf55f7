"""Streams of text and of tables through the cleaner and the checks.

All transformations are stateless selects, so there is no watermark and no state store; order
is within a file. Progress is what a query reports (recentProgress); back-pressure is
max_files a trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.jsonl import checked_line, cleaned_line


def read_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """raw: the lines of text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "raw")


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.regexp_replace("value", "\r", "").alias("raw"))


def read_table(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def cleaned(lines: DataFrame, **options) -> DataFrame:
    """line of every raw line; streams have no line numbers, so provenance says 0."""
    return lines.select(cleaned_line(F.lit(0).cast("long"), F.col("raw"), **options)["line"].alias("line"))


def checked(lines: DataFrame, **options) -> DataFrame:
    """failed, issue_types and report of every raw line."""
    c = checked_line(F.lit(0).cast("long"), F.col("raw"), **options)
    return lines.withColumn("c", c).select("raw", "c.failed", "c.issue_types", "c.report")


def start(stream: DataFrame, output: str, checkpoint: str, kind: str = "parquet", once: bool = True, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write a stream; once: all that is there, then end. each takes every batch instead of the file sink."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(each) if each else writer.format(kind).option("path", output)
    return (writer.trigger(availableNow=True) if once else writer).start()
