"""Free corners against every place of small images, and negatives on images with a single free place."""

import random
import warnings

import pytest

from tesselar.operators import sampling
from tesselar.sources.annotations import Dataset


def dataset(spark, sizes, boxes):
    images = spark.createDataFrame([(i, None, 0, w, h, 1.0) for i, (w, h) in enumerate(sizes)], "id long, video_id long, frame_index int, width int, height int, vid_scale double")
    annots = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "id long, image_id long, category_id int, x double, y double, w double, h double")
    return Dataset(images, spark.createDataFrame([], "id long, width int, height int"), annots, spark.createDataFrame([(1, "a")], "id int, name string"))


def free(x, y, w, h, boxes):
    return not any(bx + bw >= x and bx <= x + w and by + bh >= y and by <= y + h for _, _, bx, by, bw, bh in boxes)


def test_corners_brute(spark):
    r, w, h = random.Random(2), 4, 3
    sizes = [(r.randrange(3, 20), r.randrange(2, 16)) for _ in range(40)]
    boxes = [(i, 1, r.choice([-3.0, 0.0, 1.5, float(r.randrange(20))]), float(r.randrange(-2, 15)) + r.choice([0, 0.25]), r.choice([0.0, 1.0, 2.5, 9.0]), r.choice([0.0, 1.5, 4.0])) for i in range(40) for _ in range(r.randrange(6))]
    got = {}
    for row in sampling.free_corners(dataset(spark, sizes, boxes), (w, h)).collect():
        got.setdefault(row["image_id"], {})[row["x1"]] = row["y1"]
    for i, (iw, ih) in enumerate(sizes):
        mine = [b for b in boxes if b[0] == i]
        places = {(x, y) for x in range(iw - w + 1) for y in range(ih - h + 1) if free(x, y, w, h, mine)}
        assert (i in got) == bool(places)
        for x, y in got.get(i, {}).items():
            assert y == min(b for a, b in places if a == x)


def test_last_place_is_found(spark):
    """Each image is covered but for one place; too few places give a warning, and none of them twice."""
    sizes = [(200, 200)] * 3
    boxes = [(i, 1, x, y, w, h) for i in range(3) for x, y, w, h in ((0.0, 0.0, 149.0, 200.0), (0.0, 0.0, 200.0, 149.0))]
    d = dataset(spark, sizes, boxes)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rows = sampling.random_negatives(d, (50, 50), 3).collect()
    assert {(r["image_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows} == {(i, 150.0, 150.0, 200.0, 200.0) for i in range(3)}
    with pytest.warns(UserWarning, match="3 of 9"):
        assert sampling.random_negatives(d, (50, 50), 9).count() == 3
