"""Generated records for demonstrations and tests, and lines of text as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, n: int, topic: str = "demo", keys: int = 10) -> DataFrame:
    """``n`` records keyed ``user0..``, a second apart, with values of 40 bytes."""
    return spark.range(n).select(
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition_id"),
        F.col("id").alias("log_offset"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + 1_000 * F.col("id")).alias("ts"),
        F.encode(F.concat(F.lit("user"), F.col("id") % keys), "utf-8").alias("rec_key"),
        F.encode(F.rpad(F.concat(F.lit("value-"), F.col("id")), 40, "."), "utf-8").alias("rec_value"),
    )


def read_lines(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Lines of text as records without key. Lines have no order across files; the caller appends them under one of its own."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return lines.select(F.lit(topic).alias("topic"), F.lit(None).cast("binary").alias("rec_key"), F.encode("value", "utf-8").alias("rec_value"), "file")
