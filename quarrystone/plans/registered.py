"""The registered queries of the core: name -> function of (session, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..extract.extractors import extract_deps, extract_symbols
from ..functions.text import cap_bytes, contains_like, first_segment, glob_words, parsed_language
from ..functions.vectors import cosine, decode_vector, encode_vector
from ..operators import graph, indexing, references, reports, search, store
from ..sources.scan import WATCH_IGNORED_PARTS, indexable_path, porcelain_status
from ..sources.tables import current_files, live_symbols, read
from ..streaming.changes import change_rates
from ..streaming.debounce import debounce, watched

QUERIES: dict = {}
SEARCH_TEXT = "node window"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(s: SparkSession, d: str) -> DataFrame:
    return indexing.file_texts(read(s, d, "chunks"))


# -- symbol graph ---------------------------------------------------------------------------------


@query
def find_symbols_like(s: SparkSession, d: str) -> DataFrame:
    return graph.find_symbols(live_symbols(s, d), "t_ken", "method").select("id", "name", "kind", "path", "line_start")


@query
def callers(s: SparkSession, d: str) -> DataFrame:
    return graph.callers(read(s, d, "deps"), "trace_span").select("id", "source_path", "source_symbol", "target_symbol")


@query
def callees(s: SparkSession, d: str) -> DataFrame:
    return graph.callees(read(s, d, "deps"), "run").select("id", "source_path", "source_symbol", "target_symbol")


@query
def imports_per_file(s: SparkSession, d: str) -> DataFrame:
    return graph.imports_per_file(read(s, d, "deps"))


@query
def imports_of_path(s: SparkSession, d: str) -> DataFrame:
    return graph.imports(read(s, d, "deps"), "corelane/pkg/tepifa/telemetry.py").select("id", "target_path", "target_symbol")


@query
def importers(s: SparkSession, d: str) -> DataFrame:
    return graph.importers(read(s, d, "deps"), "stavework").select("id", "source_path", "target_symbol")


@query
def chunk_for_symbol(s: SparkSession, d: str) -> DataFrame:
    return graph.chunk_for_symbol(read(s, d, "chunks"), "reset").select("id", "path", "kind", "line_start", "line_end")


@query
def suggestions(s: SparkSession, d: str) -> DataFrame:
    return graph.suggestions(live_symbols(s, d), "lease")


@query
def pattern_nodes_contains(s: SparkSession, d: str) -> DataFrame:
    return graph.match_nodes(live_symbols(s, d), "Class", [("name", "contains", "buffer")]).select("id", "name", "path")


@query
def pattern_nodes_line_number(s: SparkSession, d: str) -> DataFrame:
    return graph.match_nodes(live_symbols(s, d), None, [("line_start", "=", " 05"), ("kind", "=", "function")]).select("id", "name", "path")


def _edges(s: SparkSession, d: str, *args) -> DataFrame:
    pairs = graph.match_edges(live_symbols(s, d), read(s, d, "deps"), *args)
    return pairs.select(F.col("a.name").alias("a_name"), F.col("a.path").alias("a_path"), F.col("b.name").alias("b_name"), F.col("b.path").alias("b_path"))


@query
def pattern_edges_calls(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d, "CALLS", ("Function", []), ("Function", []))


@query
def pattern_edges_called_by(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d, "calls", ("method", []), ("class", [("name", "contains", "pool")]))


@query
def pattern_edges_imports(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d, "Imports", ("class", []), ("function", [("path", "contains", "core")]))


@query
def pattern_rows_json(s: SparkSession, d: str) -> DataFrame:
    found = graph.match_nodes(live_symbols(s, d), "struct", [])
    return graph.nested_json(found.select(F.struct("name", "path", "parent").alias("a")))


@query
def key_symbols_top10(s: SparkSession, d: str) -> DataFrame:
    return graph.key_symbols(live_symbols(s, d), read(s, d, "deps"))


@query
def dead_code(s: SparkSession, d: str) -> DataFrame:
    return graph.dead_code(live_symbols(s, d), read(s, d, "deps")).select("id", "name", "kind", "path", "line_start")


@query
def entry_points(s: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(live_symbols(s, d), "run", ("init", "entry", "start"))


@query
def dead_code_count(s: SparkSession, d: str) -> DataFrame:
    return graph.dead_code_count(live_symbols(s, d), read(s, d, "deps"))


@query
def pattern_returned(s: SparkSession, d: str) -> DataFrame:
    rows = graph.match_edges(live_symbols(s, d), read(s, d, "deps"), "calls", ("method", []), ("class", []))
    out = graph.returned(rows, ["a.name", "b.path", "b.line_start", "a.name"])
    return out.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in out.columns])


@query
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_nodes(live_symbols(s, d))


@query
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_edges(read(s, d, "deps"))


@query
def edges_between_names(s: SparkSession, d: str) -> DataFrame:
    nodes = live_symbols(s, d).select(F.col("name").alias("node_id"))
    return graph.edges_between(graph.graph_edges(read(s, d, "deps")), nodes)


# -- reports --------------------------------------------------------------------------------------


@query
def index_stats(s: SparkSession, d: str) -> DataFrame:
    return reports.index_stats(read(s, d, "files"), read(s, d, "chunks"))


@query
def language_histogram(s: SparkSession, d: str) -> DataFrame:
    return reports.language_histogram(current_files(read(s, d, "files")))


@query
def top_directories(s: SparkSession, d: str) -> DataFrame:
    return reports.top_directories(current_files(read(s, d, "files")))


@query
def header_previews(s: SparkSession, d: str) -> DataFrame:
    return reports.header_previews(read(s, d, "chunks").select("id", "path", "symbol", "line_start", "header").distinct())


@query
def architecture_totals(s: SparkSession, d: str) -> DataFrame:
    out = reports.architecture(current_files(read(s, d, "files")), live_symbols(s, d), read(s, d, "deps"))
    return out.select("total_files", "total_symbols", "entry_points", F.size("languages").alias("n_languages"), F.col("key_symbols")[0]["name"].alias("top_symbol"), F.col("directories")[0]["directory"].alias("top_directory"))


@query
def current_file_rows(s: SparkSession, d: str) -> DataFrame:
    return current_files(read(s, d, "files"))


@query
def parsed_languages(s: SparkSession, d: str) -> DataFrame:
    files = read(s, d, "files").groupBy(parsed_language(F.col("path")).alias("language"))
    return files.agg(F.countDistinct("path").alias("n_paths"))


@query
def indexable_paths(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "files").where(indexable_path(F.col("path"))).select("path").distinct()


# -- search ---------------------------------------------------------------------------------------


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").select("id", "path", "symbol", "header").distinct()


@query
def bm25_all_words(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(_chunks(s, d), SEARCH_TEXT).select("id", "path", F.round("rank", 6).alias("score"))


@query
def bm25_any_word(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(_chunks(s, d), "lease quota", all_words=False).select("id", F.round("rank", 6).alias("score"))


@query
def bm25_phrase(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(_chunks(s, d), "trace_span py").select("id", F.round("rank", 6).alias("score"))


@query
def bm25_kept_index(s: SparkSession, d: str) -> DataFrame:
    index = search.text_index(_chunks(s, d))
    return search.bm25_kept(*index, "to_text ledger", all_words=False).select("id", "path", F.round("rank", 6).alias("score"))


@query
def index_terms(s: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of every term of the text index."""
    postings, _ = search.text_index(_chunks(s, d))
    return postings.groupBy("term").agg(F.count("*").alias("chunks"), F.sum(F.size("at")).alias("occurrences"))


@query
def bm25_best_per_file(s: SparkSession, d: str) -> DataFrame:
    hits = search.bm25(_chunks(s, d), SEARCH_TEXT).withColumn("rank", F.round("rank", 6))
    return search.best_per_file(hits, 10).select("id", "path", F.col("rank").alias("score"))


@query
def minmax_scores(s: SparkSession, d: str) -> DataFrame:
    hits = search.bm25(_chunks(s, d), SEARCH_TEXT).select("id", (-F.col("rank")).alias("score"))
    return search._normalised(hits).select("id", F.round("score", 5).alias("score"))


@query
def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select("vec_id", "embedding")
    found = search.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "n")


@query
def chunks_with_vectors(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = search.with_vectors(read(s, d, "chunks").select("id", "path", "symbol"), vectors)
    return found.select("id", "path", "symbol", F.size("embedding").alias("dim"))


@query
def cosine_to_label_centre(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings")
    centre = vectors.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("centre"))
    return vectors.join(centre, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centre")), 4).alias("score"))


@query
def vector_codec(s: SparkSession, d: str) -> DataFrame:
    back = decode_vector(encode_vector(F.col("embedding")))
    return read(s, d, "embeddings").select("vec_id", F.octet_length(encode_vector(F.col("embedding"))).alias("n_bytes"), (back == F.col("embedding")).alias("same"))


@query
def fused_search(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    first = vectors.orderBy("chunk_id").limit(1).collect()
    chunks = read(s, d, "chunks").select("id", "path", "symbol", "kind", "line_start", "line_end", "header", "source")
    found = search.fused(chunks, vectors, "lease window reset", first[0]["embedding"] if first else None, k=20)
    return found.select("id", "path", "truncated", F.round("score", 4).alias("score"))


@query
def exact_symbol_hits(s: SparkSession, d: str) -> DataFrame:
    return search.exact_symbols(read(s, d, "chunks"), ["reset", "run", "Parse"])


@query
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    symbols = live_symbols(s, d).select("id", "path", "name")
    expected = symbols.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("path").alias("expected_path"), F.col("name").alias("expected_symbol"))
    wanted = expected.select("query_id", F.col("expected_symbol").alias("name"))
    hits = indexing.ranked(wanted.join(symbols, "name"), ["query_id"], [F.col("path"), F.col("id")], 10).select("query_id", "rank", "path", F.col("name").alias("symbol"))
    out = indexing.retrieval_metrics(expected, hits)
    return out.select(*[F.round(c, 4).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr")], "misses")


# -- incremental indexing -------------------------------------------------------------------------


@query
def chunk_slices(s: SparkSession, d: str) -> DataFrame:
    return indexing.chunk_slices(_texts(s, d), live_symbols(s, d)).select("path", "symbol", "kind", "line_start", "line_end", "body_sha256")


@query
def body_hashes(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").select("id", F.sha2("source", 256).alias("body_hash"))


@query
def file_plan(s: SparkSession, d: str) -> DataFrame:
    return indexing.plan_files(_texts(s, d), current_files(read(s, d, "files")))


@query
def file_plan_counters(s: SparkSession, d: str) -> DataFrame:
    chunks = read(s, d, "chunks").select("id", "path", "symbol", "kind", "header", "body_sha256")
    reused = indexing.reusable(chunks, chunks.where("header != ''"))
    unreadable = read(s, d, "chunks").where("source is null").select("path").distinct()
    return indexing.index_counters(file_plan(s, d), unreadable, reused, reused.where("header is null"))


@query
def chunk_reuse(s: SparkSession, d: str) -> DataFrame:
    chunks = read(s, d, "chunks").select("id", "path", "symbol", "kind", "header", "body_sha256")
    pending = chunks.withColumn("header", F.lit(None).cast("string"))
    found = indexing.reusable(pending, chunks.where("kind != 'method'"))
    return indexing.reuse_counts(found)


@query
def replaced_paths(s: SparkSession, d: str) -> DataFrame:
    base = read(s, d, "chunks").select("id", "path", "kind")
    newest = indexing.newest_change(read(s, d, "file_changes"))
    new = base.join(newest.where("status = 'modified'"), "path", "left_semi").withColumn("kind", F.lit("new"))
    return indexing.replace_paths(base, new, newest.where("status = 'deleted'"))


@query
def newest_changes(s: SparkSession, d: str) -> DataFrame:
    return indexing.newest_change(read(s, d, "file_changes")).select("path", "status")


@query
def staleness(s: SparkSession, d: str) -> DataFrame:
    changes = indexing.newest_change(read(s, d, "file_changes")).where("status = 'modified'")
    return indexing.staleness(changes, _texts(s, d), current_files(read(s, d, "files")))


@query
def status_lines(s: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("status") == "added", "??").when(F.col("status") == "deleted", " D").when(F.col("status") == "modified", " M").otherwise("R ")
    lines = read(s, d, "file_changes").select(F.concat(code, F.lit(" "), "path").alias("value"))
    return porcelain_status(lines).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


@query
def capped_sources(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").select("id", F.octet_length(cap_bytes(F.col("source"), 240, "")).alias("n_bytes"), (F.octet_length("source") > 240).alias("truncated"))


@query
def glob_queries(s: SparkSession, d: str) -> DataFrame:
    pattern = F.concat(F.lit("**/"), F.regexp_replace("path", "[^/]+$", "*"), F.regexp_extract("path", r"(\.[a-z]+)$", 1))
    return read(s, d, "files").select("path", glob_words(pattern).alias("words")).distinct()


@query
def extracted_symbols(s: SparkSession, d: str) -> DataFrame:
    found = extract_symbols(_texts(s, d))
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("line_start").alias("first_line"))


@query
def extracted_deps(s: SparkSession, d: str) -> DataFrame:
    return extract_deps(_texts(s, d)).groupBy("source_path", "kind", "target_symbol").agg(F.count("*").alias("n"))


# -- change stream --------------------------------------------------------------------------------


@query
def watched_changes(s: SparkSession, d: str) -> DataFrame:
    return watched(read(s, d, "file_changes"), ignored=(*WATCH_IGNORED_PARTS, "tests")).select("change_id", "path", "status").distinct()


@query
def debounced_events(s: SparkSession, d: str) -> DataFrame:
    events = read(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return debounce(events, "event_type", "ts", "event_id", quiet_ms=300_000).select("event_id", "event_type")


# -- problem 3: references to records that do not exist -------------------------------------------


def _reference_tables(s: SparkSession, d: str) -> list[DataFrame]:
    return [read(s, d, n) for n in ("deps", "symbols", "file_changes", "externals")]


@query
def p3_found(s: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_reference_tables(s, d)).select("ref_table", "dep_id").distinct()


@query
def p3_report(s: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(references.orphan_references(*_reference_tables(s, d)))


@query
def p3_current_orphans(s: SparkSession, d: str) -> DataFrame:
    found = references.current_orphans(*_reference_tables(s, d))
    return found.select("ref_table", F.regexp_replace("key", references.SEPARATOR, "|").alias("ref_key"), "refs")


@query
def like_matches(s: SparkSession, d: str) -> DataFrame:
    found = read(s, d, "deps").where(contains_like(F.col("target_symbol"), "TRACE_s%n"))
    return found.groupBy(first_segment(F.col("source_path")).alias("repo")).agg(F.count("*").alias("n"))


# -- key/value rows, kept results, shown text -----------------------------------------------------


@query
def hit_json(s: SparkSession, d: str) -> DataFrame:
    """Hits as JSON, with a source only where it is shown."""
    chunks = read(s, d, "chunks").select("id", "path", "symbol", F.when(F.col("kind") == "struct", F.col("parent")).alias("source"))
    return chunks.select("id", store.hit_json(["path", "symbol", "source"]).alias("hit")).distinct()


@query
def meta_after_put(s: SparkSession, d: str) -> DataFrame:
    meta = read(s, d, "meta")
    counts = read(s, d, "files").groupBy(F.concat(F.lit("files."), first_segment(F.col("path"))).alias("key")).agg(F.count("*").cast("string").alias("value"))
    again = meta.where("key = 'schema_version'").select("key", F.lit("4").alias("value"))
    return store.put(meta, counts.unionByName(again))


@query
def cached_results(s: SparkSession, d: str) -> DataFrame:
    """Results of the text search, kept in the key/value table and read back before they expire."""
    found = search.bm25(_chunks(s, d), SEARCH_TEXT)
    hits = found.orderBy("rank", "id").limit(10).select(F.row_number().over(W.orderBy("rank", "id")).alias("rank"), "id", F.round(-F.col("rank"), 3).alias("score"))
    key = store.cache_key(SEARCH_TEXT, 10, False)
    meta = store.put(read(s, d, "meta"), store.cache_row(hits, key, 1000))
    return store.cached_hits(meta, read(s, d, "chunks"), key, 1299).select("rank", "id", "path", F.round(F.col("score").cast("double"), 2).alias("score"))


@query
def hit_lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").where("kind != 'file'").select("id", store.hit_line().alias("line")).distinct()


@query
def tool_queries(s: SparkSession, d: str) -> DataFrame:
    """Search texts of tool calls that come as JSON."""
    tool = F.when(F.col("kind") == "class", "Grep").when(F.col("kind") == "method", "Glob").otherwise("Read")
    call = F.to_json(F.struct(tool.alias("toolName"), F.struct(F.concat(F.lit("**/"), "path").alias("pattern")).alias("toolInput")))
    parsed = live_symbols(s, d).select("id", F.from_json(call, "toolName string, toolInput struct<pattern:string>").alias("c"))
    return parsed.select("id", store.tool_query(F.col("c.toolName"), F.col("c.toolInput.pattern")).alias("search"))


@query
def change_rates_daily(s: SparkSession, d: str) -> DataFrame:
    rates = change_rates(read(s, d, "file_changes").where("path is not null"))
    return rates.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "repo", "status", "n")
