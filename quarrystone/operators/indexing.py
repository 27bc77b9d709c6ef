"""Incremental indexing: what changed, what can be reused, what has to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import split_lines

CHUNKED_KINDS = ("function", "method", "struct", "class", "trait", "interface", "enum", "type")


def unchanged(stored: Column, current: Column) -> Column:
    """True only where a hash is stored, not empty (a partly indexed file) and equal."""
    return F.coalesce((stored != "") & (stored == current), F.lit(False))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(path, source, sha256): the text of every path that has chunks (id, path, symbol, kind, parent, line_start, source).

    The whole-file chunk where there is one (of several the one with the least id), else the chunks in
    order of line and id, without methods whose class has a chunk of its own. ``sha256`` is the kept hash
    of a whole-file chunk, else that of the text. Each id counts once, chunks without text not at all. What
    is gathered per path is one file, which the size limit of the scan bounds.
    """
    known = chunks.where("path is not null and source is not null and id is not null")
    once = known.groupBy("path", "id").agg(F.max(F.struct("kind", "line_start", "symbol", "parent", "source", "body_sha256")).alias("c"))
    whole = F.min_by(F.when(F.col("c.kind") == "file", F.struct("c.source", "c.body_sha256")), F.when(F.col("c.kind") == "file", F.col("id")))
    classes = F.collect_set(F.when(F.col("c.kind") != "method", F.col("c.symbol")))
    parts = F.collect_list(F.when(F.col("c.kind") != "file", F.struct("c.line_start", "id", "c.kind", "c.parent", "c.source")))
    grouped = once.groupBy("path").agg(whole.alias("w"), classes.alias("classes"), parts.alias("parts"))
    outer = F.filter(F.array_sort("parts"), lambda p: (p["kind"] != "method") | p["parent"].isNull() | ~F.array_contains("classes", p["parent"]))
    joined = F.array_join(F.transform(outer, lambda p: p["source"]), "\n")
    text = F.when(F.col("w").isNotNull(), F.col("w.source")).otherwise(joined)
    return grouped.select("path", text.alias("source"), F.col("w.body_sha256").alias("kept")).select("path", "source", F.coalesce("kept", F.sha2("source", 256)).alias("sha256"))


def plan_files(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Per path of either side (path, sha256) an action: skip, index or delete."""
    a = scanned.where("path is not null").select("path", F.col("sha256").alias("now"), F.lit(True).alias("on_disk"))
    b = files.where("path is not null").select("path", F.col("sha256").alias("stored"))
    action = F.when(F.col("on_disk").isNull(), "delete").when(unchanged(F.col("stored"), F.col("now")), "skip").otherwise("index")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def chunk_slices(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """One chunk per symbol of a chunked kind with the lines of its span, and the whole text as kind
    ``file`` for a path without such symbols, in order of path and line.

    ``texts`` has path and source. Line numbers are clamped to the text; CRLF becomes \\n inside a
    slice. Symbols of paths without text and texts that are null give no chunk. The symbol's lines
    are cut on the JVM side; the text moves once, to the tasks of its path, and is split once (the
    symbols of a file come to it as one list).
    """
    listed = F.collect_list(F.struct("name", "kind", "line_start", "line_end", "parent")).alias("symbols")
    kept = symbols.where(F.col("kind").isin(*CHUNKED_KINDS)).groupBy("path").agg(listed)
    joined = texts.where("source is not null").select("path", "source", split_lines(F.col("source")).alias("lines")).join(kept, "path", "left")
    joined = joined.withColumn("s", F.explode_outer("symbols"))
    lines = F.col("lines")
    start = F.least(F.greatest(F.col("s.line_start"), F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    stop = F.least(F.greatest(F.col("s.line_end"), start), F.greatest(F.size(lines), start))
    cut = F.array_join(F.slice(lines, start, stop - start + 1), "\n")
    whole = F.col("s").isNull()
    body = F.when(whole, F.col("source")).otherwise(cut)
    return joined.select(
        "path", F.col("s.name").alias("symbol"), F.coalesce("s.kind", F.lit("file")).alias("kind"),
        F.when(whole, 1).otherwise(start).alias("line_start"),
        F.when(whole, F.greatest(F.size(lines), F.lit(1))).otherwise(stop).alias("line_end"),
        body.alias("source"), F.col("s.parent").alias("parent"),
    ).withColumn("body_sha256", F.sha2("source", 256)).orderBy("path", "line_start", "symbol")


def reuse_counts(pending: DataFrame) -> DataFrame:
    """(kind, pending, reused): chunks per kind, and those for which ``reusable`` found a header; the rest is work to do."""
    return pending.groupBy("kind").agg(F.count("*").alias("pending"), F.count("header").alias("reused"))


def reusable(pending: DataFrame, stored: DataFrame) -> DataFrame:
    """Pending chunks with the header of a stored chunk of the same path, symbol and body hash.

    Null symbols are equal to each other, empty hashes match nothing; of several stored rows the one
    with the greatest id counts. Chunks without a match keep a null header. Where ``stored`` has an
    ``embedding``, the vector of that row comes along.
    """
    keys = ["path", "symbol", "body_sha256"]
    taken = ["header", *(["embedding"] if "embedding" in stored.columns else [])]
    old = stored.where("body_sha256 != ''").groupBy(*keys).agg(*[F.max_by(c, "id").alias(c) for c in taken])
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    left = pending.drop(*taken)
    return left.alias("p").join(old.alias("o"), same, "left").select(*[F.col(f"p.{c}") for c in left.columns], *[F.col(f"o.{c}").alias(c) for c in taken])


def with_fresh_ids(base: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ids above those of ``base``: unique and ascending per partition, with gaps; nothing moves."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = new.drop("id").join(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.monotonically_increasing_id())
    return numbered.select("id", *[c for c in new.columns if c != "id"])


def replace_paths(base: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """The table after the rows of all paths in ``new`` and ``gone`` were replaced by ``new`` (see ``with_fresh_ids``)."""
    drop = new.select("path").unionByName(gone.select("path")).distinct()
    return base.join(drop, "path", "left_anti").unionByName(new)


def index_counters(plan: DataFrame, unreadable: DataFrame | None = None, reused: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """One row: files found, unchanged, to index, deleted, errors, chunks in all, with a reused header and still without one.

    ``unreadable`` has the paths that could not be read, ``reused`` is the result of ``reusable`` and
    ``failed`` the chunks (any columns) for which no header could be made; what is not given counts 0.
    """
    count = lambda a: F.count_if(F.col("action") == a)
    none = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    out = plan.agg(F.count_if(F.col("action") != "delete").alias("found"), count("skip").alias("unchanged"), count("index").alias("to_index"), count("delete").alias("deleted"))
    out = out.join(unreadable.agg(F.count("*").alias("errors"))) if unreadable is not None else out.select("*", *none("errors"))
    out = out.join(reused.agg(F.count("*").alias("chunks"), F.count("header").alias("reused"))) if reused is not None else out.select("*", *none("chunks", "reused"))
    return out.join(failed.agg(F.count("*").alias("failed"))) if failed is not None else out.select("*", *none("failed"))


def staleness(changes: DataFrame, disk: DataFrame, files: DataFrame, previews: DataFrame | None = None) -> DataFrame:
    """(path, status[, header]): reported changes, then indexed paths that are gone or whose hash differs.

    ``changes`` has path and status and wins over the hash check. A null hash on disk could not be
    read and is no mismatch; an empty stored hash always is one.
    """
    indexed = files.where("path is not null").join(changes.select("path"), "path", "left_anti")
    found = indexed.select("path", "sha256").join(disk.select("path", F.col("sha256").alias("now"), F.lit(True).alias("there")), "path", "left")
    status = F.when(F.col("there").isNull(), "deleted").when(F.col("now") != F.coalesce("sha256", F.lit("")), "hash-mismatch")
    out = changes.select("path", "status").unionByName(found.select("path", status.alias("status")).where("status is not null"))
    return out if previews is None else out.join(previews.select("path", F.col("preview").alias("header")), "path", "left")


def newest_change(changes: DataFrame) -> DataFrame:
    """The last change of each path (by changed_at, then change_id), replayed rows counted once."""
    last = F.max(F.struct("changed_at", "change_id", "status")).alias("v")
    return changes.where("path is not null").groupBy("path").agg(last).select("path", F.col("v.status").alias("status"), F.col("v.changed_at").alias("changed_at"))


def retrieval_metrics(expected: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """One row of hit@1, hit@3, hit@5 (percent), mrr and misses.

    ``expected`` has query_id, expected_path, expected_symbol (null: any symbol of the path);
    ``hits`` has query_id, rank, path, symbol. Only the first ``depth`` ranks count; a query
    without a match adds 0 and stays in the divisor. Without queries the metrics are null.
    """
    first = first_matches(expected, hits, depth)
    at = lambda k: (F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)) * 100).alias(f"hit_at_{k}")
    return first.agg(at(1), at(3), at(5), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("first").isNull()).alias("misses"))


def first_matches(expected: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, first): the rank of each query's first match, null for a miss; the rows without one are the list of misses."""
    e, h = expected.alias("e"), hits.where(F.col("rank") <= depth).alias("h")
    match = (F.col("e.query_id") == F.col("h.query_id")) & (F.col("e.expected_path") == F.col("h.path"))
    match = match & (F.col("e.expected_symbol").isNull() | (F.col("e.expected_symbol") == F.col("h.symbol")))
    return e.join(h, match, "left").groupBy(F.col("e.query_id").alias("query_id")).agg(F.min("h.rank").alias("first"))


def ranked(hits: DataFrame, partition: list[str], order: list[Column], depth: int) -> DataFrame:
    window = W.partitionBy(*partition).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= depth)
