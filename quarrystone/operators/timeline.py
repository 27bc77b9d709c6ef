"""Running totals and last values along time that no hot key can bring into one task.

A window over a key alone puts all rows of the key into one task. Here the time line of a key is cut
into slices; a slice is summed up before it moves, the (few) slices of a key are put in order, and
rows only meet the rows of their own key and slice. The work of a hot key is thus spread over as many
tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _slices(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(at) / seconds)


def running_sum(rows: DataFrame, keys: list[str], at: str, delta: str, out: str, seconds: int) -> DataFrame:
    """``out`` = sum of ``delta`` over the rows of the same keys up to and including the row's time."""
    sliced = rows.withColumn("_slice", _slices(F.col(at), seconds))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "_slice").agg(F.sum(delta).alias("_sum"))
    slices = slices.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = W.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = sliced.withColumn("_own", F.sum(delta).over(within))
    return counted.join(slices, [*keys, "_slice"]).withColumn(out, F.col("_own") + F.col("_base")).drop("_slice", "_own", "_base")


def previous_value(rows: DataFrame, keys: list[str], order: list[str], at: str, value: str, out: str, seconds: int) -> DataFrame:
    """``out`` = ``value`` of the row before this one in ``order`` (of which ``at`` is the first), or null."""
    sliced = rows.withColumn("_slice", _slices(F.col(at), seconds))
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.withColumn("_base", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    own = F.lag(value).over(W.partitionBy(*keys, "_slice").orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) == 1
    lagged = sliced.withColumn("_own", own).withColumn("_first", first).join(last, [*keys, "_slice"], "left")
    return lagged.withColumn(out, F.when(F.col("_first"), F.col("_base")).otherwise(F.col("_own"))).drop("_slice", "_own", "_first", "_base")
