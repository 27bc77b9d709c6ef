import numpy as np
import pytest

from quarrystone.llm import mixing
from quarrystone.sources.tables import read

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 2)]


def docs(spark):
    rows = [(k, "alpha beta gamma " * 5, " A " if k % 2 else "a") for k in range(2000)]
    rows += [(10_000 + k, "delta epsilon zeta " * 5, "b") for k in range(300)]
    rows += [(20_000 + k, "eta theta iota " * 5, "c") for k in range(400)]
    rows += [(30_000 + k, "eta theta iota " * 5, None) for k in range(50)]
    rows += [(40_000, "x y", "unlisted"), (40_001, None, "a"), (40_002, "", "b"), (None, "q", "a"), (0, "alpha beta gamma " * 5, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shares_caps_and_budget(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(docs(spark), targets, 0.5)
    got = chosen.collect()
    caps = {s: c for s, _, c in TARGETS}
    assert len({r["doc_id"] for r in got}) == len(got)
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in got)
    assert not {40_000, 40_001, 40_002} & {r["doc_id"] for r in got}
    total = sum(r["repeats"] * r["n_tokens"] for r in got)
    assert abs(total - 0.5 * 15 * 2750) / total < 0.02
    share = {r["source"]: r["share"] for r in shares.collect()}
    assert share["none"] == 0.0
    for s, want, _ in TARGETS[:3]:  # the share of the source without documents goes to the others
        assert abs(share[s] - want / 0.9) < 0.02
    assert all(r["source"] == "c" for r in got if 30_000 <= r["doc_id"] < 30_050)


def test_source_that_is_too_small_gives_what_it_has(spark):
    d = spark.createDataFrame([(k, "a b c d", "big") for k in range(1000)] + [(5000 + k, "a b c d", "small") for k in range(10)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(d, targets, 0.5)
    out = {r["source"]: r["tokens"] for r in shares.collect()}
    assert out["small"] == 10 * 2 * 4 and abs(out["big"] + 80 - 0.5 * 4040) < 60


def test_memberships_are_soft_for_every_document(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    extra = spark.createDataFrame([(50_000 + k, "omega psi chi " * 5, "newsletter") for k in range(300)] + [(60_000 + k, "omega psi chi " * 5, None) for k in range(50)], "doc_id long, text string, source string")
    members, listed = mixing.memberships(docs(spark).unionByName(extra), targets)
    got = {r["doc_id"]: r for r in members.collect()}
    assert all(abs(sum(r["p"]) - 1) < 1e-6 and len(r["p"]) == len(TARGETS) + 1 for r in got.values())
    assert got[50_000]["p"][-1] > 0.9 and got[60_000]["p"][-1] > 0.5 and got[30_000]["p"][2] > 0.5
    fit = mixing.fit_rates(members, listed, 0.5)
    assert fit.converged and np.all(np.abs(fit.expected[:3] - fit.goal[:3]) <= 0.01 * fit.goal.sum())
    chosen, shares = mixing.mixture(docs(spark).unionByName(extra), targets, 0.5)
    assert not any(50_000 <= r["doc_id"] < 60_050 for r in chosen.collect())
    assert {(r["converged"], r["steps"] > 0) for r in shares.collect()} == {(True, True)}


def test_memberships_of_given_documents_are_no_labels(spark, data):
    members, _ = mixing.memberships(read(spark, data, "documents"), read(spark, data, "mix_targets"))
    top = [max(r["p"]) for r in members.collect()]
    assert np.mean([0.3 < t < 0.99999 for t in top]) > 0.3


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(docs(spark).where("false"), targets, 0.5)
    assert chosen.count() == 0 and {r["share"] for r in shares.collect()} == {0.0}


def test_reachable_targets():
    goal = mixing.reachable_targets(np.array([0.5, 0.3, 0.2]), np.array([10.0, 100.0, 100.0]), 100.0)
    assert np.isclose(goal.sum(), 100) and np.isclose(goal[0], 10) and np.isclose(goal[1] / goal[2], 1.5)
    assert np.allclose(mixing.reachable_targets(np.array([0.5, 0.5]), np.array([1.0, 2.0]), 100.0), [1, 2])


def test_held_out_accuracy(spark, data):
    """Trained on one half of the labels, far better than the most frequent source on the other."""
    folder = data.replace("sf0.001", "sf0.01")
    d = read(spark, folder, "documents")
    names = [r["source"] for r in read(spark, folder, "mix_targets").collect()]
    model = mixing.train_classifier(d, names, held_out=False)
    other = d.where(mixing.source_name(d["source"]).isin(names) & d["text"].isNotNull()).select("doc_id", "text", mixing.source_name(d["source"]).alias("s"))
    from pyspark.sql import functions as F

    test = other.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1).collect()
    p = model.posteriors([r["text"] for r in test])
    right = np.mean([model.classes[k] == r["s"] for k, r in zip(p.argmax(axis=1), test, strict=True)])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    most = max(np.mean([r["s"] == s for r in test]) for s in names)
    assert right > max(0.35, 2 * most), right


@pytest.mark.parametrize("text", [None, "", "é" * 100_000])
def test_bag_of_odd_texts(text):
    assert mixing.bag(text).shape == (mixing.FEATURES,)
