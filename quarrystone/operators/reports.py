"""Aggregate reports over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import display_language, first_segment


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, last_indexed (null for an empty index)."""
    f = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return f.join(chunks.agg(F.count("*").alias("chunks")))


def language_histogram(files: DataFrame) -> DataFrame:
    counted = files.groupBy(display_language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), "language")


def top_directories(files: DataFrame, limit: int = 10) -> DataFrame:
    counted = files.groupBy(first_segment(F.col("path")).alias("directory")).agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), "directory").limit(limit)


def header_previews(chunks: DataFrame, first: int = 5) -> DataFrame:
    """Per path the first header lines of its first chunks by line, as ``[symbol] line`` each.

    Chunks without a header count; their line is empty. Ties of line_start break by id. The window
    keeps ``first`` rows a path (Spark prunes groups before the shuffle), so the list is bounded.
    """
    order = W.partitionBy("path").orderBy("line_start", "id")
    line = F.split(F.coalesce("header", F.lit("")), "\n")[0]
    text = F.when(F.col("symbol").isNull(), line).otherwise(F.concat(F.lit("["), "symbol", F.lit("] "), line))
    kept = chunks.select("path", "line_start", "id", text.alias("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    listed = F.array_sort(F.collect_list(F.struct("n", "text")))
    return kept.groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("preview"))


def architecture(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """The overview as one row: totals and arrays of languages, directories, entry points and key symbols."""
    from .graph import entry_points, key_symbols

    def gathered(df: DataFrame, name: str, keys: list) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*keys))).alias(name))

    down = lambda c: (-F.col(c)).alias("rank")
    out = files.agg(F.count("*").alias("total_files")).join(symbols.agg(F.count("*").alias("total_symbols")))
    out = out.join(gathered(language_histogram(files), "languages", [down("files"), "language", "files"]))
    out = out.join(gathered(top_directories(files), "directories", [down("files"), "directory", "files"]))
    out = out.join(gathered(key_symbols(symbols, deps), "key_symbols", [down("calls"), "name", "kind", "path", "calls"]))
    return out.join(entry_points(symbols).agg(F.count("*").alias("entry_points")))
