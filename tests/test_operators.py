import random
import sqlite3
import string
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone import schema
from quarrystone.functions.text import cap_bytes, contains_like, glob_words, query_tokens, query_words, split_lines
from quarrystone.functions.vectors import cosine, decode_vector
from quarrystone.operators import graph, indexing, reports, search
from quarrystone.operators.timeline import previous_value, running_sum
from quarrystone.sources.scan import indexable_path, porcelain_status, scan_tree
from quarrystone.sources.tables import current_files
from quarrystone.streaming.debounce import debounce, debounce_stream, watched


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def chunks(spark, items):
    full = [dict(zip(("id", "path", "symbol", "header"), x, strict=True)) for x in items]
    return spark.createDataFrame([(c["id"], c["path"], c["symbol"], "function", 1, 2, c["header"], "src", None, "h") for c in full], schema.CHUNKS)


# -- text functions


@pytest.mark.parametrize("pattern,text,hit", [("a_b", "xaXbx", True), ("a%b", "A...B", True), ("É", "é", False), ("a.b", "axb", False), ("", "x", True), ("x\\", "x\\y", True)])
def test_like(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,), (None,)], "t string").select(contains_like(F.col("t"), pattern).alias("m"))
    assert [r[0] for r in df.collect()] == [hit, None]


def test_cap_bytes_keeps_characters(spark):
    texts = ["", "short", "é" * 10, "a" * 11, "aé€😀" * 3, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cap_bytes(F.col("t"), 10, "|")).collect()]
    for text, cut in zip(texts, got, strict=True):
        if text is None:
            assert cut is None
        elif len(text.encode()) <= 10:
            assert cut == text
        else:
            assert cut.endswith("|") and text.startswith(cut[:-1]) and len(cut[:-1].encode()) <= 10 and len(cut[:-1].encode()) > 6


def test_split_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\n\n", "\n"]
    got = [list(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(split_lines(F.col("t"))).collect()]
    assert got == [[""], ["a"], ["a"], ["a", "b", ""], [""]]


def test_glob_words(spark):
    df = spark.createDataFrame([("**/src/*.rs",), ("**",), (None,)], "t string")
    assert [r[0] for r in df.select(glob_words(F.col("t"))).collect()] == ["src   rs", None, None]


def test_query_words():
    assert query_words("Foo, a_b! élan") == [["foo"], ["a", "b"], ["elan"]]
    assert query_words("?!") == []
    assert query_tokens("ab abc Éa x_1") == ["abc", "Éa", "x_1"]


# -- graph


@pytest.fixture(scope="module")
def small_graph(spark):
    s = [("main", "function", "a.py"), ("run", "function", "a.py"), ("run", "function", "b.py"), ("Pool", "class", "b.py"), ("x", "method", "Test/c.py")]
    symbols = spark.createDataFrame([(i, p, n, k, i, i + 1, "", None, None, None) for i, (n, k, p) in enumerate(s)], schema.SYMBOLS)
    d = [("a.py", "main", None, "run", "calls"), ("a.py", None, "b.py", "Pool", "imports"), ("a.py", None, None, "run", "calls"), ("b.py", "run", None, "self.x", "calls"), ("a.py", "main", None, "run", "calls")]
    deps = spark.createDataFrame([(i, a, b, c, t, k, None, None) for i, (a, b, c, t, k) in enumerate(d)], schema.DEPS)
    return symbols, deps, s, d


def test_edges_match_brute_force(small_graph):
    symbols, deps, s, d = small_graph
    for kind in ("calls", "imports"):
        want = sorted((a[0], a[2], b[0], b[2]) for sp, ss, tp, ts, k in d for a in s for b in s if k == kind and a[2] == sp and ss in (None, a[0]) and b[0] == ts and tp in (None, b[2]))
        got = graph.match_edges(symbols, deps, kind.upper()).select("a.name", "a.path", "b.name", "b.path")
        assert rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("per_slice", [7, 4096])
def test_pairs_of_a_common_name_are_not_shuffled(spark, monkeypatch, per_slice):
    monkeypatch.setattr(graph, "SLICE_EDGES", per_slice)
    s = [(f"f{i}", "function", f"{i}.py") for i in range(30)] + [("run", "function", f"{i}.py") for i in range(20)] * 2
    symbols = spark.createDataFrame([(i, p, n, k, i, i + 1, "", None, None, None) for i, (n, k, p) in enumerate(s)], schema.SYMBOLS)
    d = [(f"{i}.py", None if i % 5 == 0 else f"f{i}", "3.py" if i % 7 == 0 else None, t) for i in range(30) for t in ("run", "run", f"f{i // 2}", "print")]
    deps = spark.createDataFrame([(i, p, n, c, t, "calls", None, None) for i, (p, n, c, t) in enumerate(d)], schema.DEPS)
    want = [(a[0], a[2], b[0], b[2]) for sp, ss, tp, ts in d for a in s for b in s if a[2] == sp and ss in (None, a[0]) and b[0] == ts and tp in (None, b[2])]
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = graph.match_edges(symbols, deps, "calls").select("a.name", "a.path", "b.name", "b.path", F.spark_partition_id())
        found = got.collect()
        plans, written = [got._jdf.queryExecution().executedPlan()], []
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if plan.nodeName() == "Exchange":
                written.append(plan.metrics().apply("shuffleRecordsWritten").value())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r)[:4] for r in found) == sorted(want) and len(want) > 2000
    assert written and max(written) < 400  # the larger table or the sources of its edges, never their pairs
    runs = [r[4] for r in found if r[2] == "run"]
    assert per_slice > len(d) or max(map(runs.count, set(runs))) < 0.7 * len(runs)


def test_pattern_errors_and_conditions(small_graph):
    symbols, deps, *_ = small_graph
    with pytest.raises(ValueError, match="unknown property"):
        graph.match_nodes(symbols, None, [("colour", "=", "x")])
    with pytest.raises(ValueError, match="unknown edge"):
        graph.match_edges(symbols, deps, "OWNS")
    assert graph.match_nodes(symbols, "CLASS").count() == 1
    assert graph.match_nodes(symbols, None, [("line_start", "=", "03.0")]).count() == 1
    assert graph.match_nodes(symbols, None, [("line_start", "=", "abc")]).count() == 0
    assert graph.match_nodes(symbols, "nothing").count() == 0


def test_dead_code_and_key_symbols(small_graph):
    symbols, deps, *_ = small_graph
    assert rows(graph.dead_code(symbols, deps).select("name", "path")) == []  # run is called, main excluded, x hidden by its path
    assert rows(graph.key_symbols(symbols, deps).select("name", "path", "calls")) == [("run", "a.py", 3), ("run", "b.py", 3)]
    assert rows(graph.edges_between(graph.graph_edges(deps), graph.graph_nodes(symbols))) == []


def test_graph_on_empty_tables(spark):
    symbols, deps = spark.createDataFrame([], schema.SYMBOLS), spark.createDataFrame([], schema.DEPS)
    assert graph.match_edges(symbols, deps, "calls").count() == 0
    assert graph.dead_code(symbols, deps).count() == 0 and graph.key_symbols(symbols, deps).count() == 0


# -- search


@pytest.mark.parametrize("seed", range(2))
def test_bm25_equals_a_full_text_engine(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "a_b", "Élan", "x1"])
    data = [(i, "/".join(word() for _ in range(2)), word() if i % 3 else None, " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, path, header, symbol)")
    db.executemany("insert into f values (?, ?, ?, ?)", [(i, p, h, s or "") for i, p, s, h in data])
    for text in ("alpha beta", "a_b", "elan", "gamma", "missing alpha"):
        match = " ".join(f'"{w}"' for w in text.split())
        want = {r[0]: r[1] for r in db.execute("select id, rank from f where f match ?", [match])}
        got = {r[0]: r[2] for r in search.bm25(chunks(spark, data), text).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_bm25_edge_cases(spark):
    assert search.bm25(chunks(spark, []), "x").count() == 0
    assert search.bm25(chunks(spark, [(1, None, None, None)]), "x").count() == 0
    assert search.bm25(chunks(spark, [(1, "a", None, "x")]), "?!").count() == 0
    lone = search._normalised(search.bm25(chunks(spark, [(1, "a", None, "x"), (2, "b", None, "y")]), "x").withColumnRenamed("rank", "score"))
    assert rows(lone) == [(1, 0.0)]


def test_best_per_file(spark):
    hits = spark.createDataFrame([(1, "a", -3.0), (2, "a", -5.0), (3, "b", -5.0), (4, None, -1.0)], "id long, path string, rank double")
    assert [r["id"] for r in search.best_per_file(hits, 2).collect()] == [2, 3]


@pytest.mark.parametrize("block", [3, 100])
def test_nearest_is_exact(spark, block):
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200, [0.0] * 8), (201, None), (202, [1.0]), (203, [])]
    v += [(300, v[0][1])]  # a tie
    df = spark.createDataFrame(v, "id long, e array<float>").repartition(5)
    got = rows(search.nearest(df, df.where("id % 40 = 0 or id = 202"), 5, block).select("query_id", "vec_id", "n"))
    full = {i: np.float32(e).astype(float) if e else np.zeros(0) for i, e in v}

    def score(a, b):
        if len(a) != len(b) or not len(a) or not np.any(a) or not np.any(b):
            return 0.0
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    want = []
    for q in [i for i in full if i % 40 == 0 or i == 202]:
        best = sorted(full, key=lambda i: (-round(score(full[q], full[i]), 12), i))[:5]
        want += [(q, i, n + 1) for n, i in enumerate(best)]
    assert got == sorted(want, key=str)
    assert search.nearest(df, df.where("false"), 5).count() == 0


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    blob = spark.createDataFrame([(b"\x00\x00\x80?zz",), (None,)], "x binary").select(decode_vector("x").alias("v"))
    assert [r[0] for r in blob.collect()] == [[1.0], None]


def test_fused_search(spark):
    data = chunks(spark, [(1, "auth.rs", "login", "login the user"), (2, "db.rs", "open", "open a file"), (3, "x.rs", None, None)])
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    found = search.fused(data, vecs, "login", [1.0, 0.0], k=5).select("id", F.round("score", 3)).collect()
    assert [tuple(r) for r in found] == [(1, 0.7), (2, 0.0)]  # .55 + .15; a lone text hit normalises to 0
    assert search.fused(data, None, "login", None, include_source=False).select("id", "score").collect()[0]["score"] == 0.15


# -- indexing


def test_file_plan(spark):
    disk = spark.createDataFrame([("new", "1"), ("same", "2"), ("diff", "3"), ("part", "4"), (None, "5")], "path string, sha256 string")
    files = spark.createDataFrame([("same", "2", 1), ("diff", "x", 1), ("part", "", 1), ("gone", "9", 1), (None, "5", 1)], schema.FILES)
    assert rows(indexing.plan_files(disk, files)) == [("diff", "index"), ("gone", "delete"), ("new", "index"), ("part", "index"), ("same", "skip")]


def test_current_files_breaks_ties(spark):
    files = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 2), ("a", "z", 2), ("b", "q", None), (None, "q", 1)], schema.FILES)
    assert rows(current_files(files)) == [("a", "z", 2), ("b", "q", None)]


def test_slices_and_fallback(spark):
    texts = spark.createDataFrame([("a", "l1\r\nl2\nl3\n"), ("b", "x\ny"), ("c", None), ("d", "")], "path string, source string")
    symbols = spark.createDataFrame([(1, "a", "f", "function", 2, 99, "", None, None, None), (2, "a", "I", "impl", 1, 1, "", None, None, None), (3, "q", "f", "function", 1, 1, "", None, None, None)], schema.SYMBOLS)
    got = rows(indexing.chunk_slices(texts, symbols).select("path", "symbol", "kind", "line_start", "line_end", "source"))
    assert got == [("a", "f", "function", 2, 3, "l2\nl3"), ("b", None, "file", 1, 2, "x\ny"), ("d", None, "file", 1, 1, "")]


def test_reuse_matches_null_symbols(spark):
    stored = spark.createDataFrame([(1, "a", None, "file", 1, 1, "old", "", None, "h"), (2, "a", None, "file", 1, 1, "newer", "", None, "h"), (3, "a", "f", "function", 1, 1, "empty", "", None, "")], schema.CHUNKS)
    pending = spark.createDataFrame([(7, "a", None, "file", 1, 1, None, "", None, "h"), (8, "a", "f", "function", 1, 1, None, "", None, ""), (9, "b", None, "file", 1, 1, None, "", None, "h")], schema.CHUNKS)
    assert rows(indexing.reusable(pending, stored).select("id", "header")) == [(7, "newer"), (8, None), (9, None)]


def test_incremental_equals_rebuild(spark):
    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, path string")
    new = spark.createDataFrame([(5, "a"), (6, "d")], "id long, path string")
    gone = spark.createDataFrame([("c",)], "path string")
    assert rows(indexing.replace_paths(base, new, gone).select("id", "path")) == [(3, "b"), (5, "a"), (6, "d")]


def test_staleness(spark):
    changes = spark.createDataFrame([("m", "modified")], "path string, status string")
    disk = spark.createDataFrame([("m", "1"), ("same", "2"), ("diff", "3"), ("unread", None), ("part", "4")], "path string, sha256 string")
    files = spark.createDataFrame([("m", "0", 1), ("same", "2", 1), ("diff", "x", 1), ("unread", "x", 1), ("gone", "x", 1), ("part", "", 1)], schema.FILES)
    assert rows(indexing.staleness(changes, disk, files)) == [("diff", "hash-mismatch"), ("gone", "deleted"), ("m", "modified"), ("part", "hash-mismatch")]


def test_metrics(spark):
    expected = spark.createDataFrame([(1, "a", None), (2, "b", "f"), (3, "c", "g")], "query_id long, expected_path string, expected_symbol string")
    hits = spark.createDataFrame([(1, 2, "a", "x"), (2, 1, "b", "f"), (3, 1, "c", "other"), (3, 99, "c", "g")], "query_id long, rank int, path string, symbol string")
    assert tuple(round(x, 3) for x in indexing.retrieval_metrics(expected, hits).collect()[0]) == (33.333, 66.667, 66.667, 0.5, 1)


def test_previews(spark):
    data = [(i, "a", None if i == 2 else f"s{i}", f"h{i}\nmore") for i in range(1, 8)] + [(9, "b", None, None)]
    got = dict(rows(reports.header_previews(chunks(spark, data))))
    assert got == {"a": "[s1] h1\nh2\n[s3] h3\n[s4] h4\n[s5] h5", "b": ""}


# -- scan


def test_scan(spark, tmp_path):
    for name, content in {"a.py": b"x", ".hidden/b.rs": b"y", "node_modules/c.js": b"z", "d.min.js": b"q", "e.png": b"p", "yarn.lock": b"", "bin.txt": b"a\0b", "bad.txt": b"\xff\xfe", "big.txt": b"a" * 100_001, "edge.txt": b"a" * 100_000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: r["readable"] for r in scan_tree(spark, str(tmp_path), (".hidden",)).collect()}
    assert got == {"a.py": True, ".hidden/b.rs": True, "bad.txt": False, "edge.txt": True}
    paths = spark.createDataFrame([("x/env",), ("ok.PNG",), (None,)], "p string")
    assert [r[0] for r in paths.select(indexable_path(F.col("p"))).collect()] == [False, True, False]


def test_status_lines(spark):
    lines = spark.createDataFrame([(" M a.py",), ("?? new file",), ("D  x",), ("R  a -> b",), ("??",), (None,)], "value string")
    assert rows(porcelain_status(lines)) == [("a -> b", "modified"), ("a.py", "modified"), ("new file", "added"), ("x", "deleted")]


# -- time lines and debounce


@pytest.mark.parametrize("seed", range(2))
def test_running_sum_and_previous(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2025, 1, 1)
    data = [(i, rng.choice("abc"), t0 + timedelta(minutes=rng.choice([1, 1, 70, 500, 3000]) * rng.randint(0, 9)), rng.choice([-1, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k string, at timestamp, d long")
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], "at", "d", "s", 3600).collect()}
    assert got == {i: sum(e[3] for e in data if e[1] == k and e[2] <= t) for i, k, t, _ in data}
    prev = {r["id"]: r["p"] for r in previous_value(df, ["k"], ["at", "id"], "at", "id", "p", 3600).collect()}
    order = {k: sorted((e[2], e[0]) for e in data if e[1] == k) for k in "abc"}
    assert prev == {i: ([None] + [x[1] for x in order[k]])[order[k].index((t, i))] for i, k, t, _ in data}


def brute_debounce(data, quiet):
    last, out = {}, set()
    for t, i, k in sorted((t, i, k) for i, k, t in data if k is not None and t is not None):
        if k not in last or (t - last[k]).total_seconds() * 1000 >= quiet:
            out.add(i)
            last[k] = t
    return out


def events(seed):
    rng = random.Random(seed)
    t0 = datetime(2025, 1, 1)
    return [(i, rng.choice(["a", "b", None]), t0 + timedelta(milliseconds=100 * rng.randint(0, 300))) for i in range(150)] + [(999, "a", None)]


def test_debounce_batch(spark):
    for seed in range(2):
        df = spark.createDataFrame(events(seed), "id long, k string, t timestamp")
        assert {r["id"] for r in debounce(df, "k", "t", "id", 500, 2).collect()} == brute_debounce(events(seed), 500)
        assert {r["id"] for r in debounce(df, "k", "t", "id", 500, 86_400).collect()} == brute_debounce(events(seed), 500)
    assert debounce(df.where("false"), "k", "t", "id").count() == 0
    assert {r["id"] for r in debounce(df, "k", "t", "id", 0).collect()} == brute_debounce(events(1), 0)


def test_debounce_stream_equals_batch(spark, tmp_path):
    data = events(5)
    spark.createDataFrame(data, "id long, k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, t timestamp").parquet(str(tmp_path / "in"))
    q = debounce_stream(stream, "k", "t", "id").writeStream.format("memory").queryName("emitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"] for r in spark.sql("select event_id from emitted").collect()} == brute_debounce(data, 500)


def test_watch_filter(spark):
    df = spark.createDataFrame([("a/target/x",), ("a/b",), (None,)], "path string")
    assert rows(watched(df)) == [("a/b",)]


def test_random_texts_do_not_crash(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(string.printable) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["x" * 300_000, "", None]
    df = chunks(spark, [(i, t, t, t) for i, t in enumerate(texts)])
    search.bm25(df, "x a_b").count()
    assert graph.suggestions(spark.createDataFrame([], schema.SYMBOLS), "x").count() == 0
