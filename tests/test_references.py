import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone import schema
from quarrystone.operators import references as R

T0 = datetime(2025, 3, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def tables(spark, deps, symbols, changes, externals=()):
    return [
        spark.createDataFrame([(i, sp, None, tp, ts, "calls", at(t), at(t)) for i, sp, tp, ts, t in deps], schema.DEPS),
        spark.createDataFrame([(i, p, n, "function", 1, 2, "", None, at(a), at(b)) for i, (p, n, a, b) in enumerate(symbols)], schema.SYMBOLS),
        spark.createDataFrame([(i, p, s, at(t), at(t)) for i, p, s, t in changes], schema.FILE_CHANGES),
        spark.createDataFrame(list(externals), "name string, kind string"),
    ]


def brute(deps, symbols, changes, externals):
    packages = {n for n, k in externals if k == "package"}
    builtins = {n for n, k in externals if k == "builtin"}
    out = set()
    for i, sp, tp, ts, t in deps:
        if t is None or (tp is not None and tp in packages) or (tp is None and ts in builtins):
            continue
        name = None
        if ts is not None:
            cut = max([ts.rfind(s) + len(s) for s in (".", "::", "->") if s in ts], default=0)
            name = ts[cut:]
        live = [(p, n) for p, n, a, b in symbols if p is not None and a is not None and a <= t and (b is None or b > t)]
        if tp is not None:
            told = [(c, cid, s) for cid, p, s, c in changes if p == tp and c is not None and c <= t and s not in (None, "hash-mismatch")]
            if not told or max(told)[2] == "deleted":
                out.add(("files", i))
            if ts is not None and ts != "*" and (tp, name) not in live:
                out.add(("symbols", i))
        elif ts is not None and sp is not None and not any(p.split("/")[0] == sp.split("/")[0] and n == name for p, n in live):
            out.add(("symbols", i))
    return out


def found(spark, *args):
    return {(r[0], r[1]) for r in R.orphan_references(*tables(spark, *args)).select("ref_table", "dep_id").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    path = lambda: rng.choice(["r/a.py", "r/b.py", "s/a.py", "s/c.py", None])
    name = lambda: rng.choice(["f", "g", "h"])
    hour = lambda: rng.choice([None, *range(0, 2000, 37), 5, 5, 5])
    deps = [(i, path(), rng.choice([path(), "pkg"]), rng.choice(["f", "x.f", "a::g", "p->h", "a.b::g", "*", "len", None]), hour()) for i in range(300)]
    symbols = [(path(), name(), hour(), hour()) for _ in range(60)]
    changes = [(i, path(), rng.choice(["added", "modified", "deleted", "hash-mismatch"]), hour()) for i in range(80)]
    changes += changes[:10]  # replayed
    externals = [("pkg", "package"), ("len", "builtin")]
    want = brute(deps, symbols, changes, externals)
    assert want and found(spark, deps, symbols, changes, externals) == want


def test_empty_tables(spark):
    deps = [(1, "r/a.py", "r/b.py", "f", 3)]
    assert found(spark, [], [], []) == set()
    assert found(spark, deps, [], []) == {("files", 1), ("symbols", 1)}


def test_inclusive_start_and_exclusive_end(spark):
    deps = [(k, "r/a.py", "r/b.py", "f", h) for k, h in enumerate([9, 10, 19, 20])]
    assert {k for t, k in found(spark, deps, [("r/b.py", "f", 10, 20)], [(1, "r/b.py", "added", 0)]) if t == "symbols"} == {0, 3}


def test_extra_and_clashing_columns(spark):
    frames = tables(spark, [(1, "r/a.py", "r/b.py", "f", 3)], [("r/b.py", "f", 1, None)], [(1, "r/b.py", "added", 0)], [("p", "package")])
    frames = [f.withColumn("existing", F.lit(1)).withColumn("total", F.lit(5)).withColumn("ref_table", F.lit("x")) for f in frames]
    assert R.orphan_references(*frames).count() == 0


def test_state_of_two_batches_is_that_of_one(spark):
    deps = [(k, "r/a.py", "r/b.py", n, 5) for k, n in enumerate("fgh")]
    symbols = [("r/b.py", "f", 1, None), ("r/b.py", "g", 1, 4)]
    d, s, c, e = tables(spark, deps, symbols, [(1, "r/b.py", "added", 0), (2, "r/b.py", "deleted", 9)])
    refs = R.reference_rows(d, e).withColumn("refs", F.lit(1)).drop("dep_id", "at")
    symbol, file = R.symbol_deltas(s), R.state_deltas(R.file_state(c))
    once = R.key_totals(refs, symbol, file)
    twice = R.key_totals(R.key_totals(refs, symbol), file)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    got = {(r[0], r[1].split(R.SEPARATOR)[-1]) for r in R.current_orphans(d, s, c, e).collect()}
    assert got == {("files", "r/b.py"), ("symbols", "g"), ("symbols", "h")}


def test_hot_key_is_cut_into_slices(spark):
    deps = [(k, "r/a.py", "r/b.py", "f", k) for k in range(0, 3000, 10)]
    symbols = [("r/b.py", "f", 100, 200), ("r/b.py", "f", 1500, None)]
    want = {k for k in range(0, 3000, 10) if not (100 <= k < 200 or k >= 1500)}
    assert {k for t, k in found(spark, deps, symbols, [(1, "r/b.py", "added", 0)]) if t == "symbols"} == want


@pytest.mark.parametrize("late", [False, True])
def test_totals_add_up_wherever_the_changes_are_divided(spark, late):
    changes = [(1, "r/a", "added", 0), (2, "r/b", "added", 1), (3, "r/a", "deleted", 2), (4, "r/b", "hash-mismatch", 3), (5, "r/a", "added", 4), (6, "r/b", "deleted", 5), (7, "r/c", "deleted", 6), (7, "r/c", "deleted", 6)]
    if late:  # old rows arrive after newer ones
        changes = changes[::-1]
    frame = lambda rows: tables(spark, [], [], rows)[2]
    for cut in range(len(changes) + 1):
        first = R.file_state(frame(changes[:cut]))
        second = R.file_state(frame(changes[cut:]), first)
        totals = R.key_totals(R.state_deltas(first), R.state_deltas(second, first)).where("existing != 0")
        assert [tuple(r) for r in totals.collect()] == [("files", "r/a", 0, 1)], cut
