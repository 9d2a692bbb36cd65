"""Array forms of the hierarchy operators against the column forms, and on trees that those can't plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselar.operators import hierarchy
from tesselar.operators import wide_hierarchy as wide

SHAPES = [(None,), (None, None, 0, 0, 2, 2, 2), (6, 6, 6, 5, 5, 9, 9, None, None, None), (1, 2, 3, None), (None, 0, 0, 1, 1, None, 5, 5, 5, 6)]


def energies(spark, n, rows=20, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(k, [r.gauss(0, 2) for _ in range(n)]) for k in range(rows)], "k long, e array<double>").cache()


@pytest.mark.parametrize("parent", SHAPES)
def test_same_as_columns(spark, parent):
    tree, df, e = hierarchy.Tree(parent), energies(spark, len(parent)), F.col("e")
    pairs = [(hierarchy.conditional_log_softmax, wide.conditional_log_softmax), (hierarchy.source_log_softmax, wide.source_log_softmax), (hierarchy.sink_log_softmax, wide.sink_log_softmax)]
    for narrow, arrays in pairs:
        for row in df.select(F.array(*narrow(e, tree)).alias("a"), arrays(e, parent).alias("b")).collect():
            assert row["b"] == pytest.approx(row["a"], abs=1e-9)
    p = df.select(wide.softmax(e, parent).alias("p")).cache()
    cols = [F.col("p")[i] for i in range(len(parent))]
    none, some = frozenset(), frozenset({2}) & frozenset(range(len(parent)))
    for how, thresh, ignore, always in (("gini", 0.05, none, none), ("gini", 0.3, some if len(tree.roots) > 1 else none, some), ("entropy", 0.05, none, some), ("prob", 0.0, none, none), ("prob", 0.2, none, none)):
        rules = {"ignore": ignore, "always": always}
        a, b = hierarchy.decision(cols, tree, thresh, how, **rules), wide.decision(F.col("p"), parent, thresh, how, **rules)
        for row in p.select(a.alias("a"), b.alias("b")).collect():
            assert row["a"]["node"] == row["b"]["node"] and row["a"]["conf"] == pytest.approx(row["b"]["conf"])


def test_thousands_of_classes(spark):
    """5000 classes, one branch of 200 levels: against plain loops."""
    r, n = random.Random(7), 5000
    parent = [None, None] + [i - 1 if i < 200 else r.randrange(i) for i in range(2, n)]
    df = energies(spark, n, 3)
    rows = df.select("e", wide.source_log_softmax(F.col("e"), parent).alias("s"), wide.sink_log_softmax(F.col("e"), parent).alias("k"), wide.decision(wide.softmax(F.col("e"), parent), parent, 0.05).alias("d")).collect()
    kids = {}
    for i, p in enumerate(parent):
        kids.setdefault(p, []).append(i)
    for row in rows:
        e = row["e"]
        norm = {p: math.log(sum(math.exp(e[i]) for i in c)) for p, c in kids.items()}
        logp, mass = [0.0] * n, [0.0] * n
        for i, p in enumerate(parent):  # parents come before their children here
            logp[i] = e[i] - norm[p] + (0 if p is None else logp[p])
        for i in reversed(range(n)):
            mass[i] = mass[i] if i in kids else math.exp(e[i])
            if parent[i] is not None:
                mass[parent[i]] += mass[i]
        whole = math.log(sum(mass[i] for i in kids[None]))
        assert row["s"] == pytest.approx(logp, abs=1e-7)
        assert row["k"] == pytest.approx([math.log(m) - whole for m in mass], abs=1e-7)
        assert row["d"]["conf"] == pytest.approx(math.exp(logp[row["d"]["node"]]))


def test_odd_rows(spark):
    """Null, empty and short arrays give nulls; a target that is no class gives null; cycles are refused."""
    parent = (None, None, 0, 0)
    df = spark.createDataFrame([(None,), ([],), ([1.0, 2.0],), ([1.0, 2.0, 0.5, None],), ([math.inf, 1.0, 0.0, 0.0],)], "e array<double>")
    rows = df.select(wide.source_log_softmax(F.col("e"), parent).alias("s"), wide.cross_entropy(F.col("e"), F.lit(9), parent).alias("c")).collect()
    assert rows[0]["s"] is None or set(rows[0]["s"]) == {None}
    assert set(rows[1]["s"]) == {None} and rows[2]["s"][2:] == [None, None] and rows[2]["s"][0] is not None
    assert rows[3]["s"][3] is None and all(r["c"] is None for r in rows)
    with pytest.raises(ValueError):
        wide.source_log_softmax(F.col("e"), (1, 0))
