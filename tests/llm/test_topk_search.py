"""Top-k search against brute force, with ties, repeated vectors and bad rows."""

import math
import random

import numpy as np
import pytest

from ledgerlink.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>, score long, rank string"


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, e in good:
        if q % every == 0:
            all_scores = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(all_scores[:k])}
    return sorted(out)


def vectors(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            e = [0.5, -0.25, 0.125, 0.0]
        else:
            e = [rng.choice([rng.gauss(0, 1), 0.5, 1.0]) for _ in range(4)]
        rows.append((i, e, i, "r"))
    return rows + [(n, None, 0, ""), (n + 1, [0.1, None], 0, ""), (n + 2, [float("nan")], 0, ""), (n + 3, [float("inf"), 1.0], 0, ""), (None, [1.0, 1.0], 0, ""), (n + 4, [], 0, ""), (n + 5, [3.0], 0, None), (20, rows[20][1], 0, "")]


def test_search_equals_brute_force(spark, monkeypatch):
    rows = vectors(230)
    monkeypatch.setattr(ts, "TILE_ROWS", 16)
    monkeypatch.setattr(ts, "TILE_QUERIES", 5)
    monkeypatch.setattr(ts, "FIRST", 8)
    monkeypatch.setattr(ts, "PIVOTS", 6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ts.search(df, every=10, k=7).collect())) == brute(rows, 10, 7)






def test_large_components_keep_their_exact_scores(spark):
    rows = [(0, [2.2e6, 1.0]), (1, [3e6, 0.0]), (2, [3.5e6, 0.0]), (3, [3.5e6, 0.25]), (100, [-2.5e6, 700.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ts.search(df).collect())) == brute_double(rows, 100, 10)
    huge = spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        ts.search(huge).collect()


def brute_double(rows, every, k):
    good = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows]
    return sorted((q, r + 1, i, -s) for q, e in good if q % every == 0 for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q)[:k]))


def test_one_id_on_a_third_of_all_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(ts, "TILE_ROWS", 8)
    rows = [(7 if i % 3 == 0 else i, [float(i % 5), 1.0], 0, "") for i in range(240)]
    assert sorted(map(tuple, ts.search(spark.createDataFrame(rows, SCHEMA), every=10, k=4).collect())) == brute(rows, 10, 4)


def test_fewer_rows_than_k(spark):
    rows = [(i, [1.0 * i, -1.0], 0, "") for i in range(4)]
    assert sorted(map(tuple, ts.search(spark.createDataFrame(rows, SCHEMA), every=2, k=10).collect())) == brute(rows, 2, 10)
    assert ts.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ts.search(spark.createDataFrame([(0, [1.0], 0, "")], SCHEMA)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3000, (8, 16))
    x = np.round(centres[rng.integers(0, 8, 4000)] + rng.normal(0, 60, (4000, 16)))
    pivots = ts.pick_pivots(x[:500], 8)
    d = ts.distances(x, pivots)
    pivot = d.argmin(axis=1)
    near = d[np.arange(len(x)), pivot]
    ring = pivot * ts.RINGS + np.minimum(near // (near.max() / ts.RINGS + 1e-9), ts.RINGS - 1).astype(int)
    known = [{"ring": r, "near": near[ring == r].min(), "far": near[ring == r].max(), "norm2": (x[ring == r] ** 2).sum(axis=1).max(), "n": int((ring == r).sum())} for r in np.unique(ring)]
    rings = ts.Rings(pivots, known)
    q = x[:50]
    bound = rings.bounds(q)
    score = ts.products(q, x)
    for j, r in enumerate(rings.ring):
        assert (bound[:, j][:, None] >= score[:, ring == r]).all()
    tenth = np.sort(score, axis=1)[:, -10]
    assert (bound >= tenth[:, None]).mean() < 0.5


def test_large_components_stay_exact():
    q = np.array([[2.0**31 - 1, -(2.0**31)]])
    assert ts.products(q, q).tolist() == [[min((2**31 - 1) ** 2 + 2**62, 2**63 - 1)]]
