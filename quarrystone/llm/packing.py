"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokens import TOKEN_PATTERN, token_counts

OPEN_BINS = 64
CONTAINERS_PER_GROUP = 256  # what one task fills; half a million tokens at the usual capacity
_SCHEMA = "container_id bigint, doc_id bigint, part int, n_tokens bigint"


class BestFit:
    """Online best-fit with a fixed number of open bins.

    Bit f of ``free`` is set while an open bin has f units free; ``bins[f]`` lists these bins. The
    bin that an item fits best is the lowest set bit at or above its size. With all bins open, the
    fullest (the lowest set bit) closes for a new one.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.bins, self.open, self.used = 0, {}, 0, 0

    def _take(self, level: int) -> int:
        waiting = self.bins[level]
        chosen = waiting.pop()
        if not waiting:
            del self.bins[level]
            self.free &= ~(1 << level)
        self.open -= 1
        return chosen

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of 1..capacity units."""
        fitting = self.free >> size
        if fitting:
            level = size + (fitting & -fitting).bit_length() - 1
            chosen = self._take(level)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            level, chosen, self.used = self.capacity, self.used, self.used + 1
        if level > size:
            self.bins.setdefault(level - size, []).append(chosen)
            self.free |= 1 << (level - size)
            self.open += 1
        return chosen


def sized(documents: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of the documents that need space: with an id and at least one token, each id once."""
    counted = token_counts(documents.where("doc_id is not null and text is not null"), ["doc_id"], pattern)
    return counted.where("n_tokens > 0").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(items: DataFrame, capacity: int, open_bins: int = OPEN_BINS, per_group: int = CONTAINERS_PER_GROUP) -> DataFrame:
    """(container_id, doc_id, part, n_tokens): which containers hold which items (doc_id, n_tokens).

    An item of more than ``capacity`` units fills containers of its own and its rest is packed as an
    item (parts count from 0); no other item is divided. Items are dealt by a hash of their id to as
    many groups as their total fills ``per_group`` containers each, so a group has a bounded size at
    any scale and only ids and sizes are shuffled; each group is one online run, in an order that the
    ids give. A group leaves at most ``open_bins`` containers less than best filled. Items of 0 units
    or null size are in no container; without items there are no rows.
    """
    items = checkpointed(items.where("doc_id is not null and n_tokens > 0").select("doc_id", "n_tokens"))
    total = items.agg(F.sum("n_tokens").alias("n")).collect()[0]["n"] or 0
    groups = max(1, -(-total // (capacity * per_group)))
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values("doc_id")
        fit, containers, docs, parts, sizes = BestFit(capacity, open_bins), [], [], [], []
        for doc_id, size in zip(rows["doc_id"].tolist(), rows["n_tokens"].tolist(), strict=True):
            for part in range(-(-size // capacity)):
                piece = min(capacity, size - part * capacity)
                containers.append(fit.put(piece))
                docs.append(doc_id)
                parts.append(part)
                sizes.append(piece)
        ids = pd.Series(containers, dtype="int64") + (int(rows["grp"].iloc[0]) << 32)
        return pa.table([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64())], names=["container_id", "doc_id", "part", "n_tokens"])

    return dealt.groupBy("grp").applyInArrow(run, _SCHEMA)


def pack_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, the least possible number of containers and the unused share."""
    totals = packed.agg(F.countDistinct("doc_id").alias("items"), F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    unused = 1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity)
    return totals.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("unused_share", F.round(F.coalesce(unused, F.lit(0.0)), 4))
