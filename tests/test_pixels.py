"""Samples with pixels against plain loops, channel requests, and odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselar.operators import pixels, targets
from tesselar.sources.annotations import Dataset

from .test_rasters import brute, tiles_of

REQUESTS = {"r|g": ["r", "g"], " rgb | r ": ["r", "g", "b"], "m:3": ["m.0", "m.1", "m.2"], "m.1:3|m.2|q": ["m.1", "m.2", "q"], "m.3:3": [], "": [], "a.b:2": ["a.b.0", "a.b.1"]}


def dataset(spark):
    images = spark.createDataFrame([(1, 7, 0, 20, 12, 1.0), (2, 7, 1, 10, 6, 2.0), (3, None, 0, 9, 9, 1.0)], "id long, video_id long, frame_index int, width int, height int, vid_scale double")
    annots = spark.createDataFrame([(1, 1, 1, 4.0, 3.0, 5.0, 4.0), (2, 2, 1, 2.0, 2.0, 2.0, 1.0), (3, 3, 2, 100.0, 0.0, 1.0, 1.0), (4, 1, 1, None, None, None, None)], "id long, image_id long, category_id int, x double, y double, w double, h double")
    return Dataset(images, spark.createDataFrame([(7, 20, 12)], "id long, width int, height int"), annots, spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))


def channels(spark):
    r = random.Random(5)
    whole = lambda h, w: [[float(r.randrange(200)) for _ in range(w)] for _ in range(h)]
    px = {(1, "r"): whole(12, 20), (2, "r"): whole(6, 10), (3, "r"): whole(9, 9), (1, "m.0"): whole(4, 10)}
    maps = {k: [20 / 10, 0.0, 0.0, 0.0, 12 / 4, 0.0] if k[1] == "m.0" else None for k in px}
    assets = spark.createDataFrame([(*k, len(v), len(v[0]), maps[k]) for k, v in px.items()], "gid long, channel string, height int, width int, warp array<double>")
    return px, maps, assets, tiles_of(spark, px)


def test_requests(spark):
    for text, names in REQUESTS.items():
        assert pixels.channel_list(text) == names
    rows = spark.createDataFrame([(t,) for t in [*REQUESTS, None]], "t string").select("t", pixels.channel_array(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == {**REQUESTS, None: None}
    assert {r["channel"] for r in pixels.by_channel(spark.createDataFrame([(1, "rgb"), (2, "m:2")], "gid long, channels string")).collect()} == {"r", "g", "b", "m.0", "m.1"}


@pytest.mark.parametrize("kind", ["nearest", "linear"])
def test_lines_brute(spark, kind):
    """A video target over frames of two scales, an image target beyond its image, and one without any of the channels."""
    d, (px, maps, assets, tiles) = dataset(spark), channels(spark)
    asked = [(1, 7, None, 2, 9, 3, 15, 1, 2), (2, None, 3, -2, 5, 4, 12, 0, 0)]
    rows = spark.createDataFrame(asked, "target_id long, video_id long, image_id long, y0 long, y1 long, x0 long, x1 long, pad_y long, pad_x long")
    out = pixels.load_pixels(targets.resolve(rows, d), d, tiles, assets, channels="m:1|r", interpolation=kind, constant=-1.0, tile=4)
    got = {(r["target_id"], r["rel_frame"]): r for r in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    boxes = {1: (1, 10, 1, 17), 2: (-2, 5, 4, 12)}
    for (t, f), r in got.items():
        y0, y1, x0, x1 = boxes[t]
        gid, s = r["image_id"], {1: 1.0, 2: 2.0, 3: 1.0}[r["image_id"]]
        assert [line["y"] for line in r["lines"]] == list(range(y1 - y0))
        for c in ("r", "m.0"):
            have = [line[c] for line in r["lines"]]
            if (gid, c) not in px:
                assert all(math.isnan(v) for line in have for v in line)
                continue
            sx, sy = (maps[gid, c][0], maps[gid, c][4]) if maps[gid, c] else (1.0, 1.0)
            want = brute(px[gid, c], 0, y1 - y0, 0, x1 - x0, [1 / s / sx, 0, x0 / s / sx, 0, 1 / s / sy, y0 / s / sy], kind == "linear")
            for line, wanted in zip(have, want):
                assert line == pytest.approx([-1.0 if v is None else v for v in wanted])
    assert [a["aid"] for a in got[1, 0]["annots"]] == [1] and [a["aid"] for a in got[1, 1]["annots"]] == [2] and got[2, 0]["annots"] is None
    assert got[1, 1]["annots"][0]["rx1"] == 2 * 2 - 1 and got[1, 1]["annots"][0]["ry1"] == 2 * 2 - 1


def test_odd_requests(spark):
    d, (_, _, assets, tiles) = dataset(spark), channels(spark)
    rows = targets.resolve(spark.createDataFrame([(1, 3)], "target_id long, image_id long"), d)
    none = pixels.sample_lines(rows, d, tiles, assets, "nothing", dtype="int", tile=4).collect()
    assert len(none) == 9 and {v for r in none for v in r["nothing"]} == {0}
    assert pixels.sample_lines(rows, d, tiles, assets, dtype="float", tile=4).columns[4:] == ["m.0", "r"]
    assert pixels.sample_lines(rows.where("false"), d, tiles, assets, tile=4).count() == 0
    with pytest.raises(ValueError):
        pixels.sample_lines(rows, d, tiles, assets, "", tile=4)
    with pytest.raises(ValueError):
        pixels.sample_lines(rows, d, tiles, assets, interpolation="sharp", tile=4)
