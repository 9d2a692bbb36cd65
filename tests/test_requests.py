"""Files of arrays, channel requests, keypoints in structs, grids by task, subsets with their videos."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import grid, pixels, rasters, samples
from tesselar.sources import arrays
from tesselar.sources.annotations import derived

PART = "gid long, channel string, height int, width int, k int"


def raster(spark, tile=4):
    rows = [(gid, c, h, w, k) for gid, h, w in ((1, 5, 9), (-2, 4, 4), (1003, 1, 1)) for c, k in (("r", 0), ("g", 1))]
    return rasters.made_tiles(spark.createDataFrame(rows, PART), lambda y, x: y * 20 + x * 2 + F.col("k"), tile)


def test_arrays_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}"
    files = {r["gid"]: r for r in arrays.write_arrays(raster(spark), path, ["g", "r"], tile=4).collect()}
    assert {g: f["file_name"] for g, f in files.items()} == {1: "001/1.npy", -2: "998/-2.npy", 1003: "003/1003.npy"}
    whole = np.load(tmp_path / "001/1.npy")
    y, x, c = np.indices((5, 9, 2))
    assert whole.dtype == np.uint8 and np.array_equal(whole, y * 20 + x * 2 + 1 - c)
    back = arrays.read_arrays(arrays.array_files(spark, path), ["g", "r"], tile=4)
    same = lambda df: sorted(map(tuple, df.select(*arrays.ARROW_TILES.names).collect()))
    assert same(back) == same(raster(spark))
    coarse = arrays.read_arrays(arrays.array_files(spark, path), ["g", "r"], tile=100)
    assert coarse.count() == 6  # tiles of another size from the same files
    again = arrays.write_arrays(raster(spark), path, ["g", "r"], tile=4)  # same files, nothing left beside them
    assert again.count() == 3 and len([p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")]) == 3


def test_faulty_images_are_named(spark, tmp_path):
    path = f"file://{tmp_path}"
    with pytest.raises(Exception, match="image 1 lacks pixels"):
        arrays.write_arrays(raster(spark).where("gid = 1 and not (channel = 'g' and tx = 1)"), path, ["r", "g"], tile=4)
    with pytest.raises(Exception, match="uint8 can't hold"):
        arrays.write_arrays(raster(spark).withColumn("values", F.transform("values", lambda v: v + 250)), path, ["r", "g"], tile=4)
    arrays.write_arrays(raster(spark), path, ["r", "g"], tile=4)
    whole = (tmp_path / "998/-2.npy").read_bytes()
    (tmp_path / "998/-2.npy").write_bytes(whole[:-3])
    (tmp_path / "998/-3.npy").write_bytes(b"abc")
    files = arrays.array_files(spark, path)
    assert sorted(r["gid"] for r in arrays.damaged_arrays(files).collect()) == [-3, -2]
    with pytest.raises(Exception, match="file of image -"):
        arrays.read_arrays(files, ["r", "g"]).collect()
    with pytest.raises(Exception, match="2 channels"):
        arrays.read_arrays(files.where("gid = 1"), ["r"]).collect()
    with pytest.raises(ValueError):
        arrays.with_file_hash(files, "GIVEN")


def test_packs(spark, tmp_path):
    """Packs hold the files that write_arrays writes, one a pack or several; a damaged record is an error that names its image."""
    path, same = f"file://{tmp_path}", lambda df: sorted(map(tuple, df.select(*arrays.ARROW_TILES.names).collect()))
    arrays.write_arrays(raster(spark), f"{path}/s", ["r", "g"], tile=4)
    single = {r["gid"]: bytes(r["content"]) for r in arrays.array_files(spark, f"{path}/s").collect()}
    for size in (1, 1 << 28):
        folder = tmp_path / str(size)
        files = arrays.write_packs(raster(spark).coalesce(1), f"file://{folder}", ["r", "g"], tile=4, pack=size)
        rows = {r["gid"]: r for r in files.collect()}
        packs = list(folder.glob("*.npz"))
        assert len(packs) == len({r["pack"] for r in rows.values()}) and (len(packs) == 3 if size == 1 else len(packs) <= 4)
        for gid, r in rows.items():
            assert r["n_bytes"] == len(single[gid]) and np.array_equal(np.load(folder / r["pack"])[r["file_name"][:-4]], arrays.array_of(single[gid]))
        for listed in (files, files.orderBy(F.desc("gid")).coalesce(1)):
            contents = arrays.listed_arrays(listed, f"file://{folder}")
            assert {r["gid"]: bytes(r["content"]) for r in contents.collect()} == single
            assert same(arrays.read_arrays(contents, ["r", "g"], tile=4)) == same(raster(spark))
    one = rows[-2]
    whole = bytearray((folder / one["pack"]).read_bytes())
    whole[one["start"] + one["size"] - 20] ^= 1
    (folder / one["pack"]).write_bytes(whole)
    with pytest.raises(Exception, match="file of image -2"):
        arrays.listed_arrays(files, f"file://{folder}").collect()
    with pytest.raises(Exception, match="image 1 lacks pixels"):
        arrays.write_packs(raster(spark).where("gid = 1 and not (channel = 'g' and tx = 1)"), path, ["r", "g"], tile=4)


def test_requests_find_what_assets_name_otherwise(spark):
    assets = spark.createDataFrame([(1, "r|g|b", "own"), (1, "m:2", "aux"), (2, "g", "own")], "gid long, channels string, file_name string")
    asked = spark.createDataFrame([(7, 1, "m.1 | rgb"), (8, 2, "g|zz"), (9, 1, None), (10, 2, "<all>"), (11, 3, "r"), (12, 3, None)], "sample_id long, gid long, request string")
    got = {}
    for r in pixels.requested_assets(asked, assets).orderBy("sample_id", "place").collect():
        got.setdefault(r["sample_id"], []).append((r["channel"], r["file_name"]))
    assert got == {
        7: [("m.1", "aux"), ("r", "own"), ("g", "own"), ("b", "own")], 8: [("g", "own"), ("zz", None)],
        9: [("b", "own"), ("g", "own"), ("m.0", "aux"), ("m.1", "aux"), ("r", "own")], 10: [("g", "own")], 11: [("r", None)],
    }


def test_channels_are_expanded_after_shuffles(spark):
    """Assets that share a channel all come out; nothing is expanded below a shuffle."""
    assets = spark.createDataFrame([(1, "r|g", "a"), (1, "g", "b"), (2, None, "c")], "gid long, channels string, file_name string")
    asked = spark.createDataFrame([(7, 1, "g|r"), (8, 1, "<all>"), (9, 2, "g"), (10, 2, None), (11, None, "g"), (12, None, None)], "sample_id long, gid long, request string")
    out = pixels.requested_assets(asked, assets)
    assert sorted(map(repr, map(tuple, out.select("sample_id", "place", "channel", "file_name").collect()))) == sorted(map(repr, [
        (7, 0, "g", "a"), (7, 0, "g", "b"), (7, 1, "r", "a"), (8, 0, "g", "a"), (8, 0, "g", "b"), (8, 1, "r", "a"), (9, 0, "g", None), (11, 0, "g", None),
    ]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("Generate") < plan.index("Join") and "Window" not in plan
    assert pixels.requested_assets(asked, assets.drop("file_name")).count() == 8


def test_keypoint_structs(spark):
    points = "array<struct<keypoint_category_id:int,xy:array<double>,visible:int>>"
    rows = spark.createDataFrame([(1, [(2, [1.0, 2.0], 2), (9, [3.0], None)]), (2, None), (3, [])], f"id int, points {points}")
    names = samples.keypoint_names(spark.createDataFrame([(1, "head"), (2, "tail")], "id int, name string"))
    got = dict(rows.crossJoin(names).select("id", samples.decode_keypoint_structs(F.col("points"), F.col("names"))).collect())
    assert [tuple(p) for p in got[1]] == [("tail", 1.0, 2.0, 2), (None, 3.0, None, None)] and got[2] == got[3] == []


def test_grid_by_task(spark, sf_dir):
    d = derived(spark, sf_dir)
    assert grid.sample_grid(d, "video_detection", (2, 300, 300)).columns == ["video_id", "t0", "x0", "y0", "aids", "is_positive"]
    assert "n_counted" in grid.sample_grid(d, "image_detection", (300, 300), ignore_over=None).columns
    with pytest.raises(NotImplementedError):
        grid.sample_grid(d, "image_classification", (300, 300))


def test_subset_keeps_only_its_videos(spark, sf_dir):
    d = derived(spark, sf_dir)
    ids = d.images.orderBy("id").limit(5).select("id")
    part = d.subset(ids)
    shown = {r[0] for r in part.images.select("video_id").collect()}
    assert {r["id"] for r in part.videos.collect()} == shown and part.images.count() == 5
