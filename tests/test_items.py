"""Items by ordinal with overrides, pools by ratio, drawn ordinals."""

import pytest

from tesselar.operators import selection
from tesselar.sources.annotations import Dataset

POSITIVES = "aid long, gid long, category_id int, cx float, cy float, width float, height float"
NEGATIVES = "cand long, image_id long, x1 double, y1 double, x2 double, y2 double"


def pool_of(spark, n_neg=3):
    pos = spark.createDataFrame([(10 + i, i, 2, 5.0, 6.0, 4.0, 3.0) for i in range(4)], POSITIVES)
    make = lambda n: spark.createDataFrame([(i, 50 + i, 0.0, 0.0, 4.0, 2.0) for i in range(n)], NEGATIVES)
    return selection.preselect(pos, make, n_neg=n_neg)


def test_ordinals_go_round_and_overrides_win(spark):
    wanted = spark.createDataFrame([(1, 0, None, None), (2, 7, 9, "3,3"), (3, -1, None, "2,2"), (4, 4, 7, None), (5, 0, None, None)], "target_id long, ordinal long, category_id long, window string")
    rows = {r["target_id"]: r for r in selection.item_targets(pool_of(spark), wanted).collect()}
    assert {t: (r["aid"], r["category_id"], r["window"], r["is_positive"]) for t, r in rows.items()} == {
        1: (10, 2, None, True), 2: (10, 9, "3,3", True), 3: (-1, 0, "2,2", False), 4: (-1, 7, None, False), 5: (10, 2, None, True),
    }
    assert rows[3]["gid"] == 52 and (rows[3]["cx"], rows[3]["width"]) == (2.0, 4.0)


def test_kinds(spark):
    wanted = spark.createDataFrame([(1, 5)], "target_id long, ordinal long")
    pick = lambda kind: selection.item_targets(pool_of(spark), wanted, kind).first()["gid"]
    assert (pick("positive"), pick("negative"), pick("item")) == (1, 52, 51)
    with pytest.raises(ValueError):
        pick("other")


def test_pools(spark):
    pos = spark.createDataFrame([(i, i, 2, 5.0, 6.0, 4.0, 3.0) for i in range(9)], POSITIVES)
    asked = []
    make = lambda n: asked.append(n) or spark.createDataFrame([(i, 50 + i, 0.0, 0.0, 4.0, 2.0) for i in range(n)], NEGATIVES)
    pool = selection.preselect(pos, make, n_pos=5, ratio=0.5)
    rows = sorted(pool.collect(), key=lambda r: r["ordinal"])
    assert asked == [2] and [r["is_positive"] for r in rows] == [True] * 5 + [False] * 2 and [r["ordinal"] for r in rows] == list(range(7))
    assert selection.preselect(pos).count() == 9
    with pytest.raises(selection.MissingNegatives):
        selection.preselect(pos, n_neg=1)
    none = spark.createDataFrame([(1, 0)], "target_id long, ordinal long")
    with pytest.raises(selection.MissingNegatives):
        selection.item_targets(selection.preselect(pos), none, "negative")
    with pytest.raises(LookupError):
        selection.item_targets(selection.preselect(pos.where("false")), none)


def test_draws(spark):
    rows = selection.drawn_ordinals(spark, 500, 7, 3).collect()
    assert {r["ordinal"] for r in rows} == set(range(7)) and [r["target_id"] for r in rows] == list(range(500))
    assert selection.drawn_ordinals(spark, 500, 7, 3).collect() == rows
    with pytest.raises(LookupError):
        selection.drawn_ordinals(spark, 1, 0)


def test_pool_makes_positives_once(spark, monkeypatch):
    """Positives and anchors may be joins of all annotations: they are not made again to be counted."""
    positives = spark.createDataFrame([(i, i, 1, 1.0, 2.0, 3.0, 4.0) for i in range(9)], "aid long, gid long, category_id int, cx float, cy float, width float, height float")
    negatives = spark.createDataFrame([(3, 1, 0.0, 0.0, 4.0, 4.0)], "cand long, image_id long, x1 double, y1 double, x2 double, y2 double")
    counted, count = [], type(positives).count
    monkeypatch.setattr(type(positives), "count", lambda df: (counted.append(df._jdf.queryExecution().analyzed().toString()), count(df))[1])
    pool = selection.item_pool(positives, negatives)
    assert sorted((r.ordinal, r.is_positive) for r in pool.collect()) == [(i, i < 9) for i in range(10)]
    anchors = spark.createDataFrame([(i, 0.1, 0.2) for i in range(5)], "aid long, w double, h double")
    images = spark.createDataFrame([(i, 90, 80) for i in range(6)], "id long, width int, height int")
    annots = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 5.0, 5.0)], "id long, image_id long, category_id int, x double, y double, w double, h double")
    assert selection.relative_negatives(Dataset(images, None, annots, None), anchors, 4).count() == 4
    assert len(counted) >= 3 and not any("LogicalRDD [aid#" in plan for plan in counted)
