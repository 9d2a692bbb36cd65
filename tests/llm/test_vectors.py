"""Centroid clustering and hard negatives against plain loops over the same integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.llm import centroids, hard_negatives
from tesselar.llm.vectors import usable, whole

CLASH = ["key", "v", "cluster", "part", "moved", "near", "low", "rest", "upper", "id", "n", "distance"]


def clouds(seed, n, d, groups=5, spread=0.15):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(d)] for _ in range(groups)]
    return [[x + r.gauss(0, spread) for x in middles[r.randrange(groups)]] for _ in range(n)]


def brute_clusters(rows, k, rounds, scale, d, seed):
    kept = [(key, [math.floor(scale * x) for x in v]) for key, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        found = [nearest(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), f in zip(kept, found) if f == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((key, c := nearest(v), square(v, centres[c])) for key, v in kept), key=str), [tuple(c) for c in centres]


@pytest.mark.parametrize("seed, k, d, coarse", [(1, 8, 16, False), (2, 12, 3, True), (3, 2, 5, True), (4, 1, 4, False), (5, 40, 2, True)])
def test_clusters_brute(spark, seed, k, d, coarse):
    """coarse: few distinct values, so that distances tie and vectors repeat."""
    rows = list(enumerate(clouds(seed, 240, d)))
    if coarse:
        rows = [(i, [round(3 * x) / 3 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster_vectors(df, "vec_id", "embedding", k=k, rounds=6, scale=64, dimensions=d, seed=seed)
    want, centres = brute_clusters(rows, k, 6, 64, d, seed)
    assert sorted(map(tuple, got.rows.collect()), key=str) == want and got.centroids == centres
    assert all(sum(w) == len(rows) for w in got.work)
    if seed == 1:
        assert got.work[-1][2] < len(rows) / 2  # most need no full scan once centroids have settled


def test_clusters_odd_rows(spark):
    good = clouds(9, 12, 4)
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (None, good[5]), (20, None), (21, [1.0, 2.0]), (22, []), (23, [1.0, None, 0.0, 0.0]), (24, [float("nan"), 0.0, 0.0, 0.0]), (25, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASH})
    got = centroids.cluster_vectors(df, "vec_id", "embedding", k=3, rounds=4, scale=100, dimensions=4)
    want, centres = brute_clusters(rows, 3, 4, 100, 4, centroids.SEED)
    assert sorted(map(tuple, got.rows.collect()), key=str) == want and got.centroids == centres
    few = centroids.cluster_vectors(df.where("vec_id < 2"), "vec_id", "embedding", k=8, rounds=2, dimensions=4)
    assert [r["distance"] for r in few.rows.collect()] == [0, 0] and len(few.centroids) == 2
    assert centroids.cluster_vectors(df.where("vec_id = 20"), "vec_id", "embedding", dimensions=4).rows.count() == 0
    huge = spark.createDataFrame([(1, [3e9, 0.0]), (2, [-3e9, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        centroids.cluster_vectors(huge, "vec_id", "embedding", k=2, rounds=1, dimensions=2)


def test_bounds_never_lie():
    """Under random moves of centroids the bounds stay below, and clusters are always the nearest."""
    r = np.random.default_rng(4)
    x = r.integers(-500, 500, (300, 6))
    centres = r.integers(-500, 500, (10, 6))
    bounds = centroids.Bounds.none(len(x), 3)
    for step in range(12):
        bounds.assign(x, centres)
        exact = np.sqrt(((x[:, None, :] - centres) ** 2).sum(2))
        assert (bounds.cluster == exact.argmin(1)).all()
        assert (bounds.upper >= exact[np.arange(300), bounds.cluster]).all()
        assert (bounds.low <= np.take_along_axis(exact, bounds.near, 1)).all()
        rest = exact.copy()
        np.put_along_axis(rest, np.concatenate([bounds.cluster[:, None], bounds.near], 1), np.inf, 1)
        assert (bounds.rest <= rest.min(1)).all()
        if step == 6:
            bounds.drop_to(2)
        moved = centres + r.integers(-40, 40, centres.shape) // (step + 1)
        bounds.drift(centroids.raised(np.sqrt(((moved - centres) ** 2).sum(1))))
        centres = moved


def brute_negatives(rows, anchors, positives=5, negatives=3):
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        found = sorted((-score(va, v), i) for i, lb, v in rows if lb == la and i != a)[:positives]
        for p, pid in found:
            p = -p
            near = sorted((-score(va, v), i) for i, lb, v in rows if lb != la and 50 * p <= 100 * score(va, v) <= 95 * p)[:negatives]
            out += [(a, pid, n + 1, i, p, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("seed, d, size, scale", [(1, 64, 120, 40), (2, 3, 150, 4), (3, 70, 90, 200), (4, 1, 60, 2)])
def test_negatives_brute(spark, monkeypatch, seed, d, size, scale):
    """Small blocks, dimensions beyond a word, ties, all-zero vectors."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    r = random.Random(seed)
    rows = [(i, r.randrange(3), [math.floor(scale * x) for x in v]) for i, v in enumerate(clouds(seed, size, d, 2))]
    rows[4] = (4, 1, [0] * d)
    df = spark.createDataFrame(rows, "id long, label int, v array<long>").repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 4 == 0)
    want = brute_negatives(rows, {i for i, _, _ in rows if i % 4 == 0})
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_odd_rows(spark):
    rows = [(0, 1, [5, 5]), (1, 1, [4]), (2, 1, [4, 4]), (2, 1, [4, 4]), (2, 2, [9, 9]), (3, 2, [3, 3]), (4, 2, [3, 3]), (5, None, [1, 1]), (None, 1, [1, 1]), (6, 2, None), (7, 3, []), (8, 2, [3, 2])]
    df = spark.createDataFrame(rows, "id long, label int, v array<long>")
    once = [(0, 1, [5, 5]), (1, 1, [4, 0]), (2, 1, [4, 4]), (3, 2, [3, 3]), (4, 2, [3, 3]), (7, 3, [0, 0]), (8, 2, [3, 2])]
    clash = df.withColumns({c: F.lit("x") for c in ("anchor", "rank", "score", "nth", "part", "m")})
    got = sorted(map(tuple, hard_negatives.mine(clash, F.col("id") % 2 == 0).collect()))
    assert got and got == brute_negatives(once, {0, 2, 4, 8})
    assert hard_negatives.mine(df.limit(0), F.col("id") % 2 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("id") > 100).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_plane_products():
    r = np.random.default_rng(0)
    for d, top in ((5, 3), (64, 200), (130, 1000)):
        a, b = r.integers(-top, top, (20, d)), r.integers(-top, top, (20, d))
        left, right, rows = hard_negatives.Planes.of(a), hard_negatives.Planes.of(b), np.arange(20)
        total = sum(hard_negatives.plane_product(left, rows, right, rows, t) for t in range(len(right.words)))
        assert (total == (a * b).sum(1)).all()


def test_usable_and_whole(spark):
    rows = [([0.5, -0.001],), ([None],), ([float("nan")],), ([float("-inf")],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<float>").select(usable(F.col("e")).alias("u"), whole(F.col("e"), 256).alias("w")).collect()
    assert [r["u"] for r in got] == [True, False, False, False, False, True] and got[0]["w"] == [128, -1]
