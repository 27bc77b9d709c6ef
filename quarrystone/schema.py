"""Schemas of the index tables."""

from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_S, _L, _I = StringType(), LongType(), IntegerType()

FILES = _table(("path", _S), ("sha256", _S), ("indexed_at", _L))
CHUNKS = _table(
    ("id", _L), ("path", _S), ("symbol", _S), ("kind", _S), ("line_start", _I), ("line_end", _I),
    ("header", _S), ("source", _S), ("parent", _S), ("body_sha256", _S),
)
CHUNK_VECS = _table(("chunk_id", _L), ("embedding", ArrayType(FloatType())))
SYMBOLS = _table(
    ("id", _L), ("path", _S), ("name", _S), ("kind", _S), ("line_start", _I), ("line_end", _I),
    ("signature", _S), ("parent", _S), ("seen_at", TimestampType()), ("gone_at", TimestampType()),
)
DEPS = _table(
    ("id", _L), ("source_path", _S), ("source_symbol", _S), ("target_path", _S), ("target_symbol", _S),
    ("kind", _S), ("seen_at", TimestampType()), ("loaded_at", TimestampType()),
)
FILE_CHANGES = _table(
    ("change_id", _L), ("path", _S), ("status", _S), ("changed_at", TimestampType()), ("logged_at", TimestampType()),
)
EVAL_QUERIES = _table(("query", _S), ("expected_path", _S), ("expected_symbol", _S))
ADRS = _table(("id", _L), ("title", _S), ("body", _S), ("created_at", _L))
