"""Sizes of texts in tokens of a public rule, and settings of the index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKEN_PATTERN = r"\w+|[^\w\s]+"


def setting(meta: DataFrame, key: str, default: str) -> str:
    """A value of the small key/value table, or the default where it is missing or null."""
    rows = meta.where((F.col("key") == key) & F.col("value").isNotNull()).select("value").limit(1).collect()
    return rows[0]["value"] if rows else default


def token_counts(documents: DataFrame, keep: list[str], pattern: str = TOKEN_PATTERN) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of documents (text); null and empty texts have 0 tokens.

    The rule is Python's (Unicode letters, digits and marks of ``re``), so it is counted there, in
    Arrow batches.
    """
    find = re.compile(pattern).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(find(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    chosen = documents.select(F.col("text").alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return spread(chosen).mapInArrow(run, f"{schema}, n_tokens bigint")
