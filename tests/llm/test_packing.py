import random

from quarrystone.llm import packing
from quarrystone.llm.tokens import setting, token_counts


def test_best_fit_takes_the_tightest_bin():
    fit = packing.BestFit(10, 3)
    assert [fit.put(s) for s in (6, 7, 3, 4, 10)] == [0, 1, 1, 0, 2]
    assert fit.open == 0


def test_fullest_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.put(s) for s in (6, 8, 7)] == [0, 1, 2]  # bin 1, the fuller, is closed
    assert fit.put(4) == 0 and fit.put(2) == 2


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(0)
    items = [(k, rng.choice([1, 5, 40, 100, 300, rng.randint(1, 900)])) for k in range(4000)] + [(5000, 5000), (5001, 2048), (5002, 0), (5003, None), (None, 4)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").repartition(7)
    packed = packing.pack(df, 2048, per_group=100)
    got = packed.collect()
    used, sizes, parts = {}, {}, {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append(r["part"])
    assert max(used.values()) <= 2048
    assert sizes == {k: n for k, n in items if k is not None and n}
    assert {k: sorted(v) for k, v in parts.items() if len(v) > 1} == {5000: [0, 1, 2]}
    assert 1 - sum(used.values()) / (2048 * len(used)) < 0.02
    again = {(r["container_id"], r["doc_id"], r["part"]) for r in packing.pack(df.repartition(3), 2048, per_group=100).collect()}
    assert again == {(r["container_id"], r["doc_id"], r["part"]) for r in got}
    report = packing.pack_report(packed, 2048).collect()[0]
    assert report["tokens"] == sum(sizes.values()) and report["least_containers"] <= report["containers"]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(none, 2048).count() == 0
    assert packing.pack_report(packing.pack(none, 2048), 2048).collect()[0]["containers"] == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Größe: a_b, 12.5 (x)"), (2, ""), (3, None), (4, "été..."), (4, "été...")], "doc_id long, text string")
    got = sorted(tuple(r) for r in token_counts(docs, ["doc_id"]).collect())
    assert got == [(1, 10), (2, 0), (3, 0), (4, 2), (4, 2)]
    assert sorted(tuple(r) for r in packing.sized(docs).collect()) == [(1, 10), (4, 2)]


def test_setting(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    assert (setting(meta, "a", "9"), setting(meta, "b", "9"), setting(meta, "c", "9")) == ("1", "9", "9")
