"""Kept text index, re-delivered chunks, unusable vectors, rebuilt texts and the small write operators."""

import pytest
from pyspark.sql import functions as F

from quarrystone import schema
from quarrystone.operators import graph, indexing, search, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def some(spark):
    data = [(k, f"r/f{k % 7}.py", ["load_row", "load", "row_set", None][k % 4], "function", 1, 2, ["loads the row", "the set of rows load", "", None][k % 4], "src", None, "h") for k in range(40)]
    return spark.createDataFrame(data, schema.CHUNKS).cache()


@pytest.mark.parametrize("text,every", [("load row", True), ("load_row", True), ("set rows", False), ("none here", True), ("", True)])
def test_kept_index_gives_the_same_ranks(spark, some, tmp_path, text, every):
    search.write_text_index(some.unionByName(some.limit(5)), str(tmp_path / "ix"))
    index = [spark.read.parquet(str(tmp_path / "ix" / n)) for n in ("postings", "sums")]
    short = lambda df: [(r[0], r[1], round(r[2], 9)) for r in rows(df)]
    assert short(search.bm25_kept(*index, text, every)) == short(search.bm25(some, text, every))


def test_fused_counts_repeats_once_and_nan_as_nothing(spark, some):
    nan = float("nan")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(10)] + [(10, [nan, 1.0]), (11, [float("inf"), 1.0])], "chunk_id long, embedding array<double>")
    once = search.fused(some, vectors, "load_row", [1.0, 0.5], k=30).select("id", F.round("score", 9)).collect()
    again = search.fused(some.unionByName(some.where("id % 3 = 0")), vectors.unionByName(vectors.where("chunk_id % 2 = 0")), "load_row", [1.0, 0.5], k=30)
    assert once == again.select("id", F.round("score", 9)).collect()
    kept = search.fused(some, vectors, "load_row", [1.0, 0.5], k=30, index=search.text_index(some))
    assert once == kept.select("id", F.round("score", 9)).collect()
    scores = {r[0]: r[1] for r in once}
    assert all(s == s for s in scores.values()) and max(scores.values()) <= 1.0
    assert scores[2] > scores[10] and once[0][0] == 0


def test_file_texts(spark):
    chunk = lambda i, p, s, k, a, src, parent=None: (i, p, s, k, a, a, "", src, parent, f"h{i}")
    data = [
        chunk(1, "a.py", "C", "class", 1, "class C:\n m"), chunk(2, "a.py", "m", "method", 2, " m", "C"), chunk(3, "a.py", "g", "function", 9, "g"), chunk(3, "a.py", "g", "function", 9, "g"),
        chunk(4, "a.py", "x", "method", 5, "x", "Gone"), chunk(5, "b.py", None, "file", 1, "whole"), chunk(6, "b.py", "f", "function", 1, "f"), chunk(7, "b.py", None, "file", 1, "later"),
        chunk(8, None, None, "file", 1, "z"), chunk(9, "c.py", None, "file", 1, None), chunk(10, "d.py", None, "file", 1, ""),
    ]
    got = {r["path"]: (r["source"], r["sha256"][:3]) for r in indexing.file_texts(spark.createDataFrame(data, schema.CHUNKS)).collect()}
    assert {p: s for p, (s, _) in got.items()} == {"a.py": "class C:\n m\nx\ng", "b.py": "whole", "d.py": ""}
    assert got["b.py"][1] == "h5" and len(got["a.py"][1]) == 3
    assert indexing.file_texts(spark.createDataFrame([], schema.CHUNKS)).count() == 0


def test_counters_fresh_ids_and_reused_vectors(spark):
    plan = spark.createDataFrame([("a", "skip"), ("b", "index"), ("c", "delete")], "path string, action string")
    stored = spark.createDataFrame([(1, "b", "f", "x", "head", [1.0])], "id long, path string, symbol string, body_sha256 string, header string, embedding array<double>")
    pending = spark.createDataFrame([("b", "f", "x"), ("b", "g", "y")], "path string, symbol string, body_sha256 string").withColumn("header", F.lit(None).cast("string"))
    reused = indexing.reusable(pending, stored)
    assert rows(reused) == [("b", "f", "x", "head", [1.0]), ("b", "g", "y", None, None)]
    assert indexing.index_counters(plan, plan.where("action = 'index'"), reused, reused.where("header is null")).collect()[0].asDict() == {
        "found": 2, "unchanged": 1, "to_index": 1, "deleted": 1, "errors": 1, "chunks": 2, "reused": 1, "failed": 1,
    }
    assert tuple(indexing.index_counters(plan).collect()[0]) == (2, 1, 1, 1, 0, 0, 0, 0)
    new = indexing.with_fresh_ids(stored, pending)
    assert new.columns == ["id", *pending.columns] and sorted(r["id"] for r in new.collect())[0] > 1 and new.select("id").distinct().count() == 2


def test_records_expired_results_and_json(spark):
    adrs = spark.createDataFrame([(4, "a", "x", 5)], schema.ADRS)
    assert rows(store.add_record(adrs, "b", "y", "6")) == [(4, "a", "x", "5"), (5, "b", "y", "6")]
    assert rows(store.add_record(adrs.where("false"), "b", "y", "6")) == [(1, "b", "y", "6")]
    with pytest.raises(ValueError):
        store.add_record(adrs, " ", "y", "6")
    meta = spark.createDataFrame([("a", "1"), ("cache:new", '{"ts":900,"hits":[]}'), ("cache:old", '{"ts":1,"hits":[]}'), ("cache:bad", "x")], "key string, value string")
    assert [r[0] for r in rows(store.without_expired(meta, 1000))] == ["a", "cache:new"]
    hits = spark.createDataFrame([("p", None, None), ("p", None, "s")], "path string, symbol string, source string")
    assert [r[0] for r in hits.select(store.hit_json(["path", "symbol", "source"])).collect()] == ['{"path":"p","symbol":null}', '{"path":"p","symbol":null,"source":"s"}']


def test_returned_items_and_limits(spark):
    symbols = spark.createDataFrame([(1, "r/a", "f", "function", 1, 2, "", None, None, None), (2, "r/b", "g", "function", 1, 2, "", None, None, None)], schema.SYMBOLS)
    deps = spark.createDataFrame([(1, "r/a", "f", None, "g", "calls", None, None), (2, "r/a", None, "r/b", "g", "calls", None, None)], schema.DEPS)
    pairs = graph.match_edges(symbols, deps, "calls")
    assert rows(graph.returned(pairs, ["a.name", "b.path", "a.name"])) == [("f", "r/b"), ("f", "r/b")]
    assert graph.returned(pairs, ["a"], 1).collect()[0]["a"]["name"] == "f"
    assert graph.match_edges(symbols, deps, "calls", limit=1).count() == 1 and graph.match_nodes(symbols, limit=1).count() == 1
    for wrong in ("c", "a.secret", "a.name; drop"):
        with pytest.raises(ValueError):
            graph.returned(pairs, [wrong])
