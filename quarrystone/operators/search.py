"""BM25, brute-force nearest vectors and the fusion of both with exact symbol names."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import cap_bytes, query_tokens, query_words, terms

K1, B = 1.2, 0.75  # Fixed values: the usual BM25 parameters
WEIGHTS = {"vector": 0.55, "text": 0.30, "symbol": 0.15}  # Fixed values: shares of the fused score
TEXT_POOL = 50
INDEXED = ("path", "header", "symbol")


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the terms of ``phrase`` stand next to each other in an array of terms."""

    def here(x: Column, i: Column) -> Column:
        tests = [x == phrase[0]] + [F.get(tokens, i + k) == word for k, word in enumerate(phrase) if k]
        return reduce(lambda p, q: p & q, tests)

    return F.size(F.filter(tokens, here))


def bm25(chunks: DataFrame, text: str, all_words: bool = True) -> DataFrame:
    """(id, path, rank) of the chunks that hold all words of ``text`` (or any); lower ranks are better.

    The index covers path, header and symbol (null as empty). A text without words, or an empty
    table, gives no rows. Query words are literals, so a row's term counts are made where the row
    is read and only corpus sums leave the scan: no postings are shuffled.
    """
    phrases = query_words(text)
    schema = "id bigint, path string, rank double"
    if not phrases:
        return chunks.sparkSession.createDataFrame([], schema)
    columns = [terms(F.col(c)) for c in INDEXED]
    split = chunks.select("id", "path", *[c.alias(f"t{k}") for k, c in enumerate(columns)])
    tf = [sum((_occurrences(F.col(f"t{k}"), p) for k in range(1, len(INDEXED))), _occurrences(F.col("t0"), p)).alias(f"tf{n}") for n, p in enumerate(phrases)]
    length = sum((F.size(f"t{k}") for k in range(1, len(INDEXED))), F.size("t0"))
    counted = split.select("id", "path", length.alias("len"), *tf)
    stats = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"), *_df(len(phrases)))
    return _ranked(counted, stats, len(phrases), all_words)


def _df(n: int) -> list[Column]:
    return [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(n)]


def _ranked(counted: DataFrame, stats: DataFrame, words: int, all_words: bool) -> DataFrame:
    """(id, path, rank) from counts (id, path, len, tf0, ...) and one row of corpus sums (docs, avg_len, df0, ...)."""
    score = F.lit(0.0)
    for n in range(words):
        df, f = F.col(f"df{n}"), F.col(f"tf{n}")
        idf = F.greatest(F.log((F.col("docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    tests = [F.col(f"tf{n}") > 0 for n in range(words)]
    hit = reduce((lambda p, q: p & q) if all_words else (lambda p, q: p | q), tests)
    return counted.where(hit).join(F.broadcast(stats)).select("id", "path", (-score).alias("rank"))


def text_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index of chunks (id, path, header, symbol): postings and corpus sums.

    Postings are (term, id, path, len, at): one row per chunk and term, ``at`` its positions, ``len`` the
    chunk's number of terms. The sums are one row (docs, avg_len). Chunks count once per id; null ids are left out.
    """
    once = one_per_id(chunks, list(INDEXED))
    parts = [terms(F.col(c)) for c in INDEXED]
    gap = F.array(F.lit(""))  # keeps phrases within a column
    tokens = F.concat(parts[0], *[x for p in parts[1:] for x in (gap, p)])
    split = once.select("id", "path", tokens.alias("t")).withColumn("len", F.size("t") - (len(INDEXED) - 1))
    places = lambda term: F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get(F.col("t"), i) == term)
    listed = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), places(w).alias("at")))
    postings = split.select("id", "path", "len", F.explode(listed).alias("p")).where("p.term != ''")
    return postings.select("p.term", "id", "path", "len", "p.at"), split.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))


def write_text_index(chunks: DataFrame, folder: str) -> None:
    """Keep the index of a version of the chunks: postings lie sorted by term, so a search reads the row groups of
    its words only; a term that every chunk holds is spread over files by id."""
    postings, sums = text_index(chunks)
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    sums.write.mode("overwrite").parquet(f"{folder}/sums")


def bm25_kept(postings: DataFrame, sums: DataFrame, text: str, all_words: bool = True) -> DataFrame:
    """``bm25`` from a kept index: the same rows, read from the postings of the query's words alone."""
    phrases = query_words(text)
    if not phrases:
        return postings.sparkSession.createDataFrame([], "id bigint, path string, rank double")
    words = sorted({w for p in phrases for w in p})
    at = {w: F.col(f"a{k}") for k, w in enumerate(words)}
    lists = [F.max(F.when(F.col("term") == w, F.col("at"))).alias(f"a{k}") for k, w in enumerate(words)]
    held = postings.where(F.col("term").isin(words)).groupBy("id").agg(F.first("path").alias("path"), F.first("len").alias("len"), *lists)

    def count(p: list[str]) -> Column:
        def together(x: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(at[w], x + k), F.lit(False)) for k, w in enumerate(p) if k], F.lit(True))

        return F.coalesce(F.size(F.filter(at[p[0]], together)), F.lit(0))

    counted = held.select("id", "path", "len", *[F.when(at[p[0]].isNull(), 0).otherwise(count(p)).alias(f"tf{n}") for n, p in enumerate(phrases)])
    stats = counted.agg(*_df(len(phrases))).join(F.broadcast(sums))  # two single rows
    return _ranked(counted, stats, len(phrases), all_words)


def one_per_id(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(id, *columns) with one row per id, of unlike ones the greatest; null ids are left out."""
    last = F.max(F.struct(*columns)).alias("v")
    return chunks.where("id is not null").groupBy("id").agg(last).select("id", *[F.col(f"v.{c}").alias(c) for c in columns])


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (id, ...) with the vector of vectors (chunk_id, embedding), each id once; chunks without one drop out."""
    columns = [c for c in chunks.columns if c not in ("id", "embedding")]
    return one_per_id(chunks, columns).join(vectors.select(F.col("chunk_id").alias("id"), "embedding"), "id")


def exact_symbols(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """(id, symbol) of the chunks whose symbol is exactly one of the tokens, each once."""
    return chunks.where(F.col("symbol").isin(tokens)).select("id", "symbol").distinct()


def best_per_file(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of each path among the best 4 k hits, at most k paths. Ties break by id."""
    pool = hits.orderBy("rank", "id").limit(4 * k)
    first = W.partitionBy("path").orderBy("rank", "id")
    return pool.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("rank", "id").limit(k)


def _packed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r[0] for r in rows], np.int64)
    m = np.array([r[1] for r in rows], np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return ids, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048, per_scan: int = 16) -> DataFrame:
    """(query_id, vec_id, score, n): the k vectors of greatest cosine for each query, ties by vec_id.

    ``vectors`` and ``queries`` have an id and an array column, in this order. Exact. Queries go
    through in blocks of at most ``block`` rows, of which a scan of the vectors takes ``per_scan``, so
    what the driver and a task hold is bounded whatever their number; each task scores its batches with
    one matrix product a block and keeps k rows a query, which a window then merges. Null, empty and zero vectors and those of another length score 0.
    """
    vid, vec = vectors.columns[:2]
    qid, qvec = queries.columns[:2]
    numbered = queries.where(F.col(qvec).isNotNull() & F.col(qid).isNotNull()).select(qid, qvec)
    parts, last = [], None
    while True:  # key-set paging: the queries of one scan at a time are on the driver
        page = numbered if last is None else numbered.where(F.col(qid) > last)
        rows = page.orderBy(qid).limit(block * per_scan).collect()
        if not rows:
            break
        last = rows[-1][0]
        for dim in sorted({len(r[1]) for r in rows}):
            ids, m = _packed([r for r in rows if len(r[1]) == dim])
            parts.append(_scored(vectors.select(vid, vec), ids, m, k, block))
    schema = "query_id bigint, vec_id bigint, score double, n int"
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.unionAll, parts)
    return merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _scored(vectors: DataFrame, ids: np.ndarray, m: np.ndarray, k: int, block: int) -> DataFrame:
    dim = m.shape[1]
    cuts = [slice(a, a + block) for a in range(0, len(ids), block)]

    def run(batches):
        best = [(np.full((len(ids[c]), 0), -np.inf), np.zeros((len(ids[c]), 0), np.int64)) for c in cuts]
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            vids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.zeros((len(vids), dim))
            fits = lengths == dim
            if dim and fits.any():
                flat[fits] = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            norm = np.linalg.norm(flat, axis=1, keepdims=True)
            unit = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
            for at, c in enumerate(cuts):
                s = np.concatenate([best[at][0], m[c] @ unit.T], axis=1)
                i = np.concatenate([best[at][1], np.broadcast_to(vids, (len(s), len(vids)))], axis=1)
                order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                best[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        for c, (s, i) in zip(cuts, best, strict=True):
            if s.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[c], s.shape[1])), pa.array(i.ravel()), pa.array(s.ravel())], names=["query_id", "vec_id", "score"])

    return vectors.where(F.col(vectors.columns[0]).isNotNull()).mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def min_max(score: Column, over: W = None) -> Column:
    """(s - lo) / max(hi - lo, 1e-6) over a pool. A pool of equal scores, even of one hit, gives 0."""
    lo, hi = (F.min(score), F.max(score)) if over is None else (F.min(score).over(over), F.max(score).over(over))
    return (score - lo) / F.greatest(hi - lo, F.lit(1e-6))


def _normalised(pool: DataFrame) -> DataFrame:
    """min_max over the whole pool; the bounds are one aggregated row, so no pool moves to one task."""
    bounds = pool.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return pool.join(F.broadcast(bounds)).select("id", scaled.alias("score"))


def fused(chunks: DataFrame, vectors: DataFrame | None, text: str, query_vector: list[float] | None, k: int = 5, include_source: bool = True, max_bytes: int = 2400, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best chunks by weighted vector, text and exact-symbol score (path, symbol, ..., score).

    Without a query vector the vector share is 0 and the weights stay as they are. A signal that
    does not know a chunk counts 0. Every chunk with a vector is a candidate; sources are fetched
    only for the k rows that remain. ``vectors`` has chunk_id and embedding. A re-delivered chunk or
    vector counts once (of unlike vectors of a chunk the nearest), a vector that holds a NaN scores 0.
    ``index`` is a kept text index (postings, sums); without one the chunks are scanned.
    """
    from ..functions.vectors import cosine

    base = one_per_id(chunks, list(INDEXED))
    hits = bm25_kept(*index, text) if index else bm25(base, text)
    pool = hits.orderBy("rank", "id").limit(TEXT_POOL).select("id", (-F.col("rank")).alias("score"))
    signals = [_normalised(pool).withColumn("score", F.col("score") * WEIGHTS["text"])]
    if query_vector is not None and vectors is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        known = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        scored = known.groupBy(F.col("chunk_id").alias("id")).agg(F.max(cosine(F.col("embedding"), q)).alias("score"))
        signals.append(_normalised(scored).withColumn("score", F.col("score") * WEIGHTS["vector"]))
    if tokens := query_tokens(text):
        exact = exact_symbols(chunks, tokens).select("id").distinct()
        signals.append(exact.withColumn("score", F.lit(WEIGHTS["symbol"])))
    top = reduce(DataFrame.unionByName, signals).groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)
    columns = ["id", "path", "symbol", "kind", "line_start", "line_end", "header"]
    source = [cap_bytes(F.col("source"), max_bytes).alias("source"), (F.octet_length("source") > max_bytes).alias("truncated")] if include_source else [F.lit(False).alias("truncated")]
    fetched = chunks.join(F.broadcast(top), "id").dropDuplicates(["id"])  # k rows; re-deliveries go after the join
    return fetched.select(*columns, *source, "score").orderBy(F.desc("score"), "id")
