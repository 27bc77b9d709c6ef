"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the library's defaults, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quarrystone")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local master may do without (a
    folder of this machine is used then); on a cluster a missing setting is an error. A lost
    executor cannot lose the written rows.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` (a scan without shuffles) on at least as many partitions as the cluster has cores.

    For work in Python on few or unsplittable files; where the scan has enough partitions, which large
    tables always have, nothing moves. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
