"""Reading the index tables and undoing re-deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that are in the index now (the table is a history)."""
    return read(spark, folder, "symbols").where(F.col("gone_at").isNull())


def current_files(files: DataFrame) -> DataFrame:
    """The newest row of each path; of equally new rows the one with the greatest hash.

    Exact repeats fall together. A null path is no file and is left out; a null time is older than
    any other.
    """
    newest = F.max(F.struct(F.col("indexed_at"), F.col("sha256"))).alias("v")
    return (
        files.where(F.col("path").isNotNull()).groupBy("path").agg(newest)
        .select("path", F.col("v.sha256").alias("sha256"), F.col("v.indexed_at").alias("indexed_at"))
    )


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
