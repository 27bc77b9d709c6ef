import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import split


def check(data, limit, overlap):
    parts = split.cuts(data, limit, overlap)
    done = 0
    for a, b in parts:
        assert b - a <= limit and max(0, done - overlap) <= a <= done < b
        data[a:b].decode()
        done = b
    assert done == len(data)
    return parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é€\n\n;{} ", max_size=600), st.integers(60, 200), st.integers(0, 20))
def test_pieces_fit_and_rebuild(text, limit, overlap):
    data = text.encode()
    if data:
        check(data, limit, overlap)


def cost(data, limit, overlap, ends):
    places, penalty = split.boundaries(data, limit - overlap)
    price = dict(zip(places.tolist(), penalty, strict=True))
    mean = len(data) / -(-(len(data) - overlap) // (limit - overlap))
    total, start = 0.0, 0
    for e in ends:
        first = int(split.overlap_starts(data, np.array([start]), overlap)[0])
        if e - first > limit:
            return float("inf")
        total += price[e] + split.IMBALANCE * ((e - start - mean) / mean) ** 2
        start = e
    return total


def test_optimal_against_all_cuts():
    rng = random.Random(0)
    for _ in range(20):
        text = "".join(rng.choice(["def f():\n", "    x = 1\n", "\n", "        y()\n"]) for _ in range(11)).encode()
        limit, overlap = 60, 10
        if len(text) <= limit:
            continue
        places = split.boundaries(text, limit - overlap)[0].tolist()
        best = min(cost(text, limit, overlap, [*c, len(text)]) for r in range(len(places)) for c in itertools.combinations(places[:-1], r))
        ours = cost(text, limit, overlap, [b for _, b in split.cuts(text, limit, overlap)])
        assert np.isclose(best, ours)


def test_natural_boundary_is_preferred():
    block = "def f():\n" + "    x = 1\n" * 20 + "\n"
    data = (block * 6).encode()
    parts = check(data, 500, 0)
    assert all(data[b:].startswith(b"def") for _, b in parts[:-1])


def test_one_very_long_line_and_limits():
    check(("x" * 100_000).encode(), 6000, 240)
    check(("é" * 30_000).encode(), 6000, 240)
    check(("a,b;" * 20_000).encode(), 6000, 240)
    with pytest.raises(ValueError):
        split.cuts(b"x" * 100, 50, 30)


def test_long_lines_take_seconds_not_minutes():
    import time

    began = time.time()
    check(b'x1=f(a,"b c d");y=[1,2,3];' * 80_000, 6000, 240)
    check(b"a\n" * 500_000, 6000, 240)
    assert time.time() - began < 15


def test_operator(spark):
    text = "".join(f"line {k}\n" for k in range(100))
    rows = [(1, text, 10, 109), (1, text, 10, 109), (2, "short", 1, 1), (3, None, 1, 1), (4, "", None, None), (5, text, 50, 2), (6, text, None, None), (7, "x" * 300, 1, 1), (8, "x" * 301, 0, 0)]
    df = spark.createDataFrame(rows, "id long, source string, line_start int, line_end int")
    got = split.pieces(df, 300, 40)
    table = {}
    for r in got.orderBy("chunk_id", "piece_no").collect():
        table.setdefault(r["chunk_id"], []).append(r)
    assert table.keys() == {1, 5, 6, 8}
    for k, first in ((1, 10), (5, 2), (6, 1)):
        assert "".join(r["piece"].encode()[r["overlap_bytes"] :].decode() for r in table[k]) == text
        assert [r["piece_no"] for r in table[k]] == list(range(1, len(table[k]) + 1))
        assert table[k][0]["line_start"] == first and table[k][-1]["line_end"] == first + 99
        for r in table[k]:
            assert r["piece"].startswith(f"line {r['line_start'] - first}\n") and r["n_bytes"] <= 300 and r["overlap_bytes"] <= 40
    assert split.pieces(df.where("false"), 300, 40).count() == 0
