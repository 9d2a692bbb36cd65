"""Joins and selections on images with very many boxes, and negatives that need several rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tesselar.functions import geometry as g
from tesselar.operators import grid, overlap, sampling, selection
from tesselar.sources.annotations import Dataset

ANNOTS = "id long, image_id long, category_id int, x double, y double, w double, h double"


def dataset(spark, sizes, boxes):
    images = spark.createDataFrame(sizes, "id long, width int, height int")
    return Dataset(images, None, spark.createDataFrame(boxes, ANNOTS), None)


@pytest.mark.parametrize("cell", [7, 64])
def test_cells_give_the_same_pairs(spark, cell):
    """Whole-number boxes, so that many touch at cell borders; empty and null ones among them."""
    r = random.Random(cell)
    boxes = [(i, i % 3, 1, float(r.randrange(-20, 90)), float(r.randrange(-20, 90)), float(r.randrange(0, 30)), float(r.randrange(0, 30))) for i in range(150)] + [(999, 1, 1, None, 0.0, 1.0, 1.0)]
    rows = [(r.randrange(3), x := float(r.randrange(-10, 90)), y := float(r.randrange(-10, 90)), x + r.randrange(0, 40), y + r.randrange(0, 40)) for _ in range(60)]
    windows = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], "image_id long, x1 double, y1 double, x2 double, y2 double, nth int")
    annots = spark.createDataFrame(boxes, ANNOTS)
    for visible in (0.0, 0.4):
        got, want = overlap.overlaps_by_cell(windows, annots, visible, cell), overlap.overlaps(windows, annots, visible)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("thresh", [0.0, 0.3])
def test_rounds_select_as_arrays_do(spark, thresh):
    """One image of a dense heap, equal centres included, beside sparse ones."""
    r = random.Random(5)
    rows = [(i, i % 2, r.gauss(0, 60), r.gauss(0, 40)) for i in range(400)] + [(1000 + i, 0, 3.0, 4.0) for i in range(200)]
    rows += [(5000 + i, 9, -700.0 + 13 * i, 20.0) for i in range(50)]
    targets = spark.createDataFrame(rows, "aid long, gid long, cx double, cy double")
    want = sorted(map(tuple, selection.spread_positives(targets, (24, 32), thresh, crowded=10**6).collect()))
    for crowded in (0, 150):
        assert sorted(map(tuple, selection.spread_positives(targets, (24, 32), thresh, crowded=crowded).collect())) == want
    assert selection.spread_positives(targets.limit(0), (24, 32), thresh).count() == 0


@pytest.mark.parametrize("side, listed", [(1, 4), (2, 7), (16, 20)])
def test_small_blocks_select_as_arrays_do(spark, side, listed):
    """Blocks with many neighbours, and more windows than a round looks at."""
    r = random.Random(side)
    rows = [(i, i % 2, r.gauss(0, 90), r.gauss(0, 60)) for i in range(90)] + [(1000 + i, 0, -3.0, 4.0) for i in range(30)]
    targets = spark.createDataFrame(rows, "aid long, gid long, cx double, cy double")
    want = sorted(map(tuple, selection.spread_positives(targets, (24, 32), 0.1).collect()))
    scored = targets.select("gid", "aid", g.portable_hash(F.col("aid"), 5).alias("score"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    assert sorted(map(tuple, selection.spread_in_rounds(scored, 32.0, 24.0, 0.1, side, listed).collect())) == want


def test_a_block_takes_one_round(spark, monkeypatch):
    """Windows whose fate hangs on one another are settled together, and nothing is written again for a further round."""
    said, write = [], selection.staged
    monkeypatch.setattr(selection, "staged", lambda df, label: said.append(label) or write(df, label))
    targets = spark.createDataFrame([(i, i % 5, 6.0 * (i // 5), 9.0) for i in range(200)], "aid long, gid long, cx double, cy double")
    got = sorted(map(tuple, selection.spread_positives(targets, (24, 32), 0.1, crowded=0).collect()))
    assert said == ["scored", "kept"] and got == sorted(map(tuple, selection.spread_positives(targets, (24, 32), 0.1).collect()))


def test_negatives_in_rounds(spark):
    """Images that are mostly covered: a first round finds too few windows, later ones go on; what can't be found is said."""
    boxes = [(i, i % 20, 1, 0.0, 0.0, 100.0, 78.0) for i in range(20)]
    data = dataset(spark, [(i, 100, 100) for i in range(20)], boxes)
    found = sampling.random_negatives(data, (10, 10), 25, rounds=30).collect()
    assert len(found) == 25 and len({r.cand for r in found}) == 25 and all(r.y1 > 78 and r.y2 <= 100 for r in found)
    full = dataset(spark, [(1, 50, 50)], [(1, 1, 1, 0.0, 0.0, 50.0, 50.0)])
    with pytest.warns(UserWarning, match="0 of 3"):
        assert sampling.random_negatives(full, (10, 10), 3).count() == 0


def test_exploded_sides_are_not_broadcast(spark):
    """Cells multiply both sides, which Spark's sizes don't show."""
    windows = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0)], "image_id long, x1 double, y1 double, x2 double, y2 double")
    met = overlap.overlaps_by_cell(windows, spark.createDataFrame([(7, 1, 1, 3.0, 4.0, 900.0, 900.0)], ANNOTS), cell=10)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1


def test_uncovered_area_has_one_array_an_image(spark):
    """Unions of arrays equal those of cells and a count of unit squares; only crowded images are cut in cells."""
    r = random.Random(8)
    boxes = [(i, i % 3, 1, float(r.randrange(-20, 90)), float(r.randrange(-20, 70)), float(r.randrange(0, 40)), float(r.randrange(0, 40))) for i in range(90)] + [(999, 1, 1, None, 0.0, 1.0, 1.0)]
    data = dataset(spark, [(i, 90, 60 + i) for i in range(4)], boxes)
    full = {i: {(x, y) for b in boxes if b[1] == i and b[3] is not None for x in range(max(int(b[3]), 0), min(int(b[3] + b[5]), 90)) for y in range(max(int(b[4]), 0), min(int(b[4] + b[6]), 60 + i))} for i in range(4)}
    want = [(i, float(len(full[i])), 90.0 * (60 + i) - len(full[i])) for i in range(4)]
    for crowded in (0, 30, 500):
        assert sorted(map(tuple, overlap.uncovered_area(data.images, data.annots, 16, crowded).collect())) == want
    assert "Generate" not in overlap.uncovered_area(data.images, data.annots)._jdf.queryExecution().sparkPlan().toString()


def test_windows_are_not_shuffled(spark):
    """Windows come after all shuffles, and see the boxes that a join shows them; images of very many boxes are joined."""
    r = random.Random(2)
    boxes = [(i, i % 4, 1 + i % 3, float(r.randrange(-20, 90)), float(r.randrange(-20, 90)), float(r.randrange(0, 60)), float(r.randrange(0, 60))) for i in range(150)] + [(999, 1, 1, None, 0.0, 1.0, 1.0), (1000, 4, None, 1.0, 2.0, 9.0, 9.0)]
    data = dataset(spark, [(i, 90 + i, 70 + 3 * i) for i in range(6)], boxes + [(2000 + i, 4, 3, 5.0 * i, 0.0, 9.0, 70.0) for i in range(12)])
    data = Dataset(data.images, None, data.annots, spark.createDataFrame([(1, "a"), (2, "b"), (3, "Ignore")], "id int, name string"))
    for window, overlap_, interest in (((32, 40), 0.5, ()), ((50, 50), 0.0, ("B",)), (None, 0.0, ())):
        rows = lambda df: sorted(map(repr, df.collect()))
        want = rows(grid.crowded_grid(data, window, overlap_, interest))
        for crowded in (0, 36, 10**6):
            assert rows(grid.image_grid(data, window, overlap_, interest, crowded=crowded)) == want
    plan = grid.image_grid(data, (32, 40), 0.5)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.index("Generate") < plan.index("Aggregate")
