"""File changes as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .debounce import QUIET_MS, debounce_stream, watched


def change_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Rows of ``file_changes`` as parquet files arrive in a folder, without ignored paths."""
    raw = spark.readStream.schema(schema.FILE_CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return watched(raw)


def debounced_changes(spark: SparkSession, folder: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Changes to act upon: the first of each path, then each after a quiet time (see ``debounce_stream``)."""
    return debounce_stream(change_stream(spark, folder), "path", "changed_at", "change_id", quiet_ms)


def change_rates(changes: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, repo, status, n): changes per window of changed_at; rows later than ``late`` are dropped on a stream."""
    repo = F.substring_index("path", "/", 1).alias("repo")
    counted = changes.withWatermark("changed_at", late).groupBy(F.window("changed_at", window).alias("w"), repo, "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "repo", "status", "n")
