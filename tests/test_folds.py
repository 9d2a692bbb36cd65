"""Stratified folds: the sequential rule against a plain restatement, evenness of dealt and settled folds."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import folds

ROWS = "image_id long, category_id int"


def one_after_the_other(rows, k):
    """The rule of greedy_folds with plain lists."""
    classes = sorted({c for _, c in rows})
    of = {i: [sum(1 for j, x in rows if j == i and x == c) for c in classes] for i in {i for i, _ in rows}}
    target = [sum(v[n] for v in of.values()) / len(rows) for n in range(len(classes))]
    freq, far, found = [[0] * len(classes) for _ in range(k)], [sum(t * t for t in target)] * k, {}
    for i in sorted(of, key=lambda i: (sum(of[i]), i), reverse=True):
        losses, wants = [], []
        for f in range(k):
            want = [a + b for a, b in zip(freq[f], of[i])]
            gap = sum((w / sum(want) - t) ** 2 for w, t in zip(want, target))
            total = sum(map(sum, freq))
            losses.append(round(sum(far) - far[f] + gap + (sum(freq[f]) / total if total else 0), folds.DIGITS))
            wants.append((want, gap))
        best = losses.index(min(losses))
        freq[best], far[best] = wants[best]
        found[i] = best
    return found


def test_worked_example(spark):
    labels, groups = [1, 1, 1, 1, 2, 2, 2, 3, 3], [1, 1, 3, 4, 2, 2, 7, 8, 8]
    found = dict(map(tuple, folds.greedy_folds(spark.createDataFrame(list(zip(groups, labels)), ROWS), 3).collect()))
    assert [[i for i, x in enumerate(groups) if found[x] == f] for f in range(3)] == [[0, 1, 7, 8], [3, 4, 5, 6], [2]]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_brute(spark, seed):
    r = random.Random(seed)
    rows = [(s, i + 100 * s, r.choice([1, 1, 2, 5, 9])) for s in range(3) for i in range(25) for _ in range(r.randrange(1, 6))]
    df = spark.createDataFrame(rows, "video_id long, " + ROWS)
    got = {(x.video_id, x.image_id): x.fold for x in folds.greedy_folds(df, 4, scope="video_id").collect()}
    assert got == {(s, i): f for s in range(3) for i, f in one_after_the_other([(i, c) for t, i, c in rows if t == s], 4).items()}
    with pytest.raises(ValueError, match="at most 10"):
        folds.greedy_folds(df, 4, scope="video_id", most=10)


def spread(rows, found, k):
    """For each class its images by fold."""
    return {c: [Counter(found[i] for i, x in set(rows) if x == c)[f] for f in range(k)] for c in {c for _, c in rows}}


@pytest.mark.parametrize("k, weights", [(3, 1.0), (5, 0.3)])
def test_rich_histograms_are_even(spark, k, weights):
    """Thousands of images that all have histograms of their own: each class is within one image of even."""
    r = random.Random(k)
    rows = [(i, c) for i in range(3000) for c in r.choices(range(30), [(c + 1) ** -weights for c in range(30)], k=12)]
    rows += [(r.randrange(3000), 77) for _ in range(9)]
    found = dict(map(tuple, folds.stratified_folds(spark.createDataFrame(rows, ROWS), k).collect()))
    assert len(found) == 3000 and set(found.values()) == set(range(k))
    for counts in spread(rows, found, k).values():
        assert max(abs(n - sum(counts) / k) for n in counts) <= 1


def test_dealt_folds(spark):
    """Without settling the rarest class of all is as even as can be, and folds depend on rows alone."""
    r = random.Random(4)
    rows = [(i, c) for i in range(400) for c in r.sample(range(6), r.randrange(1, 4))] + [(i, 9) for i in range(0, 400, 30)]
    df = spark.createDataFrame(rows, ROWS)
    found = dict(map(tuple, folds.stratified_folds(df, 3, swing=0).collect()))
    assert sorted(spread(rows, found, 3)[9]) == [4, 5, 5]
    assert found == dict(map(tuple, folds.stratified_folds(df.repartition(5).unionAll(df), 3, swing=0).collect()))
    few = dict(map(tuple, folds.stratified_folds(df, 3, swing=0, rounds=2).collect()))
    assert sorted(spread(rows, few, 3)[9]) == [4, 5, 5] and max(Counter(few.values()).values()) - min(Counter(few.values()).values()) <= 1


def test_odd_folds(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (2, 3), (3, None)], ROWS)
    assert folds.stratified_folds(df, 3).collect() == [(2, 0)] and folds.greedy_folds(df, 3).collect() == [(2, 0)]
    assert folds.stratified_folds(df.limit(0), 3).collect() == [] and folds.greedy_folds(df.limit(0), 3).collect() == []
    assert {r.split for r in folds.split_images(df).collect()} == {"test"}


def test_segments():
    for have in ([0, 0, 0], [4, 0, 2], [1, 5, 1, 0], [7]):
        counts, got = list(have), []
        for place in range(30):
            low, _, turn = next(s for s in folds.segments(have) if s[1] is None or place < s[1])
            got.append(turn[(place - low) % len(turn)])
            assert counts[got[-1]] == min(counts)
            counts[got[-1]] += 1


def test_settle_keeps_counts():
    r = np.random.default_rng(1)
    images = (r.random((200, 12)) < 0.3).astype(float)
    old = r.integers(0, 3, 200)
    counts = np.stack([images[old == f].sum(0) for f in range(3)])
    new = folds.settle(images, old, counts - counts.sum(0) / 3)
    after = np.stack([images[new == f].sum(0) for f in range(3)])
    assert np.abs(after - after.mean(0)).max() <= 1 < np.abs(counts - counts.mean(0)).max()


def test_bound_values_are_evaluated_once(spark):
    """A value that is used many times in nested lambdas is made once a row; folding one long scope takes no time beyond its length."""
    made = spark.range(50).select(folds.bound(F.expr("uuid()"), lambda v: F.array(v, v, v)).alias("a")).collect()
    assert all(len(set(r["a"])) == 1 for r in made) and len({r["a"][0] for r in made}) == 50
    rows = spark.range(600).select(F.expr("id div 3 AS image_id"), (F.col("id") * 7 % 11).cast("int").alias("category_id"))
    plan = folds.greedy_folds(rows, 3)._jdf.queryExecution().analyzed().toString()
    assert plan.count("round(") == 1
