"""Key/value rows of the index, kept results of searches, decision records, and the index as an artifact."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_PREFIX = "cache:"
CACHE_SECONDS = 300
_ENTRY = "struct<ts:bigint,hits:array<struct<id:bigint,score:float>>>"


def put(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after its rows (key, value) were replaced or joined by ``rows``; of equal new keys the greatest value stays."""
    new = rows.where("key is not null").groupBy("key").agg(F.max("value").alias("value"))
    return meta.join(new, "key", "left_anti").select("key", "value").unionByName(new)


def value_of(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    """The value of one key; the default where the key is missing or its value null."""
    rows = meta.where((F.col("key") == key) & F.col("value").isNotNull()).agg(F.max("value").alias("value")).collect()
    return default if rows[0]["value"] is None else rows[0]["value"]


def drop_prefix(meta: DataFrame, prefix: str = CACHE_PREFIX) -> DataFrame:
    return meta.where(F.col("key").isNull() | ~F.startswith("key", F.lit(prefix)))


def cache_key(query: str, k: int, semantic: bool) -> str:
    """The key of a kept result; result size and mode belong to it, what is shown of a hit does not."""
    return CACHE_PREFIX + hashlib.sha256(f"{query}\0{k}\0{str(semantic).lower()}".encode()).hexdigest()


def cached_entries(meta: DataFrame, now: int | Column) -> DataFrame:
    """(key, ts, hits, fresh): the kept results; fresh ones are younger than ``CACHE_SECONDS`` and can be read."""
    entry = F.from_json("value", _ENTRY)
    rows = meta.where(F.startswith("key", F.lit(CACHE_PREFIX))).select("key", entry.alias("e"))
    age = (now if isinstance(now, Column) else F.lit(now)) - F.col("e.ts")
    return rows.select("key", "e.ts", "e.hits", F.coalesce(age < CACHE_SECONDS, F.lit(False)).alias("fresh"))


def cached_hits(meta: DataFrame, chunks: DataFrame, key: str, now: int) -> DataFrame:
    """(rank, id, score, path, symbol) of a fresh kept result, in its order; chunks that are gone drop out."""
    found = cached_entries(meta.where(F.col("key") == key), now).where("fresh").select(F.posexplode("hits").alias("rank", "h"))
    hits = found.select("rank", F.col("h.id").alias("id"), F.col("h.score").alias("score"))
    known = hits.join(chunks.select("id", "path", "symbol"), "id").dropDuplicates(["rank"])
    return known.select("rank", "id", "score", "path", "symbol").orderBy("rank")


def cache_row(hits: DataFrame, key: str, now: int) -> DataFrame:
    """The (key, value) row that keeps hits (rank, id, score); of no hits no row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda h: F.struct(h["id"].alias("id"), h["score"].cast("float").alias("score")))
    row = hits.agg(ordered.alias("hits")).where(F.size("hits") > 0)
    return row.select(F.lit(key).alias("key"), F.to_json(F.struct(F.lit(now).cast("bigint").alias("ts"), "hits")).alias("value"))


def without_expired(meta: DataFrame, now: int) -> DataFrame:
    """The table without the kept results that can no longer be read; other rows stay."""
    fresh = cached_entries(meta, now).where("fresh").select("key").distinct()
    kept = meta.where(F.startswith("key", F.lit(CACHE_PREFIX))).join(fresh, "key", "left_semi").select("key", "value")
    return drop_prefix(meta).select("key", "value").unionByName(kept)


def add_record(adrs: DataFrame, title: str, body: str, created_at: str) -> DataFrame:
    """The decision records with one more, whose id is the greatest so far plus 1. Blank titles are refused."""
    if not title.strip():
        raise ValueError("a record needs a title")
    new = adrs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(title).alias("title"), F.lit(body).alias("body"), F.lit(created_at).alias("created_at"))
    return adrs.select("id", "title", "body", F.col("created_at").cast("string").alias("created_at")).unionByName(new)


def hit_json(columns: list[str], optional: str = "source") -> Column:
    """A hit as one JSON object: nulls are kept, but ``optional`` is left out where it is null."""
    keep = {"ignoreNullFields": "false"}
    rest = [c for c in columns if c != optional]
    return F.when(F.col(optional).isNull(), F.to_json(F.struct(*rest), keep)).otherwise(F.to_json(F.struct(*columns), keep))


def newest_records(adrs: DataFrame) -> DataFrame:
    """Decision records, newest first; equally new ones by id, greatest first. The time is text."""
    return adrs.orderBy(F.desc("created_at"), F.desc("id")).select("id", "title", "body", F.col("created_at").cast("string").alias("created_at"))


def export_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Write tables side by side as zstd-compressed parquet."""
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def import_tables(spark: SparkSession, folder: str, schemas: dict) -> dict[str, DataFrame]:
    """Tables of an artifact. A table that lacks a column of its schema, or has it in another type, is an error."""
    out = {}
    for name, wanted in schemas.items():
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        types = dict(df.dtypes)
        wrong = [f.name for f in wanted.fields if types.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"{name}: not as expected: {', '.join(wrong)}")
        out[name] = df
    return out


def hit_line(score: bool = False) -> Column:
    """A hit as text: path, lines, symbol and, if asked for, the score with four decimals."""
    head = F.format_string("%s:%d-%d %s", "path", "line_start", "line_end", F.coalesce("symbol", F.lit("")))
    return F.rtrim(F.concat(head, F.format_string("  %.4f", F.col("score").cast("double")))) if score else F.rtrim(head)


def tool_query(tool: Column, pattern: Column) -> Column:
    """What a tool call searches for: the pattern of Grep as it is, the words of Glob, else null."""
    from ..functions.text import glob_words

    return F.when(tool == "Grep", pattern).when(tool == "Glob", glob_words(pattern))
