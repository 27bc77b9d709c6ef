import pytest
from pyspark.sql import functions as F

from quarrystone import schema
from quarrystone.operators import store
from quarrystone.streaming.changes import change_rates, debounced_changes

META = "key string, value string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_put_and_drop(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "x"), ("cache:1", "{}")], META)
    new = spark.createDataFrame([("b", "3"), ("b", "3"), ("c", None), (None, "y")], META)
    assert rows(store.put(meta, new)) == [("a", "1"), ("b", "3"), ("c", None), ("cache:1", "{}"), (None, "x")]
    assert rows(store.drop_prefix(meta)) == [("a", "1"), ("b", "2"), (None, "x")]


def test_cache_keys_differ():
    keys = {store.cache_key(q, k, m) for q in ("hello", "hullo") for k in (5, 6) for m in (True, False)}
    assert len(keys) == 8 and all(k.startswith("cache:") for k in keys)


def test_cache_round_trip_expiry_and_gone_chunks(spark):
    hits = spark.createDataFrame([(1, 7, 0.5), (2, 3, 0.25), (3, 99, 0.1)], "rank int, id long, score double")
    chunks = spark.createDataFrame([(7, "a", "f", "x"), (3, "b", None, "y")], "id long, path string, symbol string, score string")
    meta = store.put(spark.createDataFrame([], META), store.cache_row(hits, "cache:k", 100))
    assert rows(store.cached_hits(meta, chunks.drop("score"), "cache:k", 399)) == [(0, 7, 0.5, "a", "f"), (1, 3, 0.25, "b", None)]
    assert store.cached_hits(meta, chunks, "cache:k", 400).count() == 0
    assert store.cached_hits(meta, chunks, "cache:other", 100).count() == 0
    assert store.cache_row(hits.where("false"), "cache:k", 1).count() == 0
    broken = spark.createDataFrame([("cache:x", "not json"), ("cache:y", None)], META)
    assert [r["fresh"] for r in store.cached_entries(broken, 1).collect()] == [False, False]


def test_newest_first(spark):
    adrs = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 9), (3, "c", "z", 9)], schema.ADRS)
    assert [(r["id"], r["created_at"]) for r in store.newest_records(adrs).collect()] == [(3, "9"), (2, "9"), (1, "5")]


def test_artifact_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "1", 2), (None, None, None)], schema.FILES)
    store.export_tables({"files": files}, str(tmp_path / "out"))
    assert rows(store.import_tables(spark, str(tmp_path / "out"), {"files": schema.FILES})["files"]) == rows(files)
    with pytest.raises(ValueError, match="sha256"):
        store.export_tables({"files": files.drop("sha256")}, str(tmp_path / "bad"))
        store.import_tables(spark, str(tmp_path / "bad"), {"files": schema.FILES})


def test_lines_and_tool_queries(spark):
    df = spark.createDataFrame([("a.rs", 1, 9, "f", 0.12345), ("b.rs", 2, 3, None, 1.0)], "path string, line_start int, line_end int, symbol string, score double")
    assert [r[0] for r in df.select(store.hit_line(True)).collect()] == ["a.rs:1-9 f  0.1235", "b.rs:2-3   1.0000"]
    calls = spark.createDataFrame([("Grep", "a*b"), ("Glob", "**/x.rs"), ("Glob", "**"), ("Read", "x"), (None, None)], "t string, p string")
    assert [r[0] for r in calls.select(store.tool_query(F.col("t"), F.col("p"))).collect()] == ["a*b", "x rs", None, None, None]


def test_change_stream(spark, tmp_path):
    from datetime import datetime

    data = [(1, "r/a", "added", datetime(2025, 1, 1, 0, 0, 0)), (2, "r/a", "modified", datetime(2025, 1, 1, 0, 0, 0, 400_000)), (3, "r/a", "deleted", datetime(2025, 1, 1, 0, 0, 1)), (4, "build/x", "added", datetime(2025, 1, 1))]
    df = spark.createDataFrame([(*d, d[3]) for d in data], schema.FILE_CHANGES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = debounced_changes(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.sql("select event_id from changed").collect()) == [1, 3]
    assert rows(change_rates(df).select("repo", "status", "n")) == [("build", "added", 1), ("r", "added", 1), ("r", "deleted", 1), ("r", "modified", 1)]


def test_value_of_a_key(spark):
    meta = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), (None, "x")], META)
    assert (store.value_of(meta, "a"), store.value_of(meta, "b", "d"), store.value_of(meta, "c"), store.value_of(meta.where("false"), "a", "z")) == ("1", "d", None, "z")
