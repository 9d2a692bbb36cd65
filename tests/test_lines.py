"""Datasets as JSON lines, warps in all their forms, splits of one dataset."""

import json

import pytest
from pyspark.sql import functions as F

from tesselar.operators import rasters, splits
from tesselar.sources.annotations import derived
from tesselar.sources.lines import auxiliary_rows, frame_warp, load_lines, save_lines, warp_of


def test_warps(spark):
    rows = [("[[1,2,3],[4,5,6]]",), ("[[1,2,3],[4,5,6],[0,0,1]]",), ('{"scale": 2}',), ('{"scale": [2, 3], "offset": [4, 5]}',), ('{"offset": [1.5, 0]}',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "w string").select(warp_of(F.col("w"))).collect()]
    assert got == [[1, 2, 3, 4, 5, 6]] * 2 + [[2, 0, 0, 0, 2, 0], [2, 0, 4, 0, 3, 5], [1, 0, 1.5, 0, 1, 0], None]


FILES = {
    "images": [
        {"id": 1, "file_name": "a.png", "width": 9, "height": 8, "video_id": 3, "frame_index": 0, "channels": "r|g", "warp_img_to_vid": {"scale": 2}, "auxiliary": [{"file_name": "b.tif", "channels": "b", "warp_aux_to_img": [[2, 0, 1], [0, 4, 0]]}], "unknown": [1]},
        {"id": 2, "width": 9, "height": 8},
    ],
    "videos": [{"id": 3, "name": "v", "width": 18, "height": 16}],
    "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "segmentation": [[1, 2, 3]], "keypoints": [1, 2, 2]}, {"id": 6, "image_id": 2}],
    "categories": [{"id": 2, "name": "x", "supercategory": "y", "keypoints": ["nose"]}, {"id": 4, "name": "y"}],
}


def test_load_and_round_trip(spark, tmp_path):
    for name, rows in FILES.items():
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "part.json").write_text("\n".join(map(lambda r: json.dumps(r, separators=(",", ":")), rows)))
    d = load_lines(spark, str(tmp_path / "d"))
    save_lines(d, str(tmp_path / "e"))
    again = load_lines(spark, str(tmp_path / "e"))
    for data in (d, again):
        assert [tuple(r) for r in frame_warp(data.images).orderBy("image_id").collect()] == [(1, [2, 0, 0, 0, 2, 0]), (2, [1, 0, 0, 0, 1, 0])]
        assert sorted(tuple(r) for r in data.annots.collect()) == [(5, 1, 2, 1, 2, 3, 4, "[[1,2,3]]", [1, 2, 2]), (6, 2, None, None, None, None, None, None, None)]
        assert sorted((r.id, r.name, r.parent_id, r.keypoints) for r in data.categories.collect()) == [(2, "x", 4, ["nose"]), (4, "y", None, None)]
        assets = rasters.asset_table(data.images, auxiliary_rows(data.images)).collect()
        assert sorted((r.gid, r.channel, r.file_name, r.warp) for r in assets) == [(1, "b", "b.tif", [2, 0, 1, 0, 4, 0]), (1, "g", "a.png", [1, 0, 0, 0, 1, 0]), (1, "r", "a.png", [1, 0, 0, 0, 1, 0])]
        assert data.videos.count() == 1 and sorted(r.vid_scale for r in data.images.collect()) == [1, 2]


def test_a_large_file_is_split(spark, tmp_path):
    for name in FILES:
        spark.range(60_000).select("id", F.lit(100).alias("width"), F.lit(50).alias("height")).coalesce(1).write.json(str(tmp_path / "d" / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        images = load_lines(spark, str(tmp_path / "d")).images
        assert images.rdd.getNumPartitions() > 4 and images.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_line(spark, tmp_path):
    for name in FILES:
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "part.json").write_text('{"id": 1}\n{"id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_lines(spark, str(tmp_path / "d")).videos.collect()


def test_coerce_datasets(spark, sf_dir):
    base = derived(spark, sf_dir)
    assert set(splits.coerce_datasets(train=base)) == {"train"} and splits.coerce_datasets() == {}
    three = splits.coerce_datasets(base=base)
    ids = {tag: {r.id for r in d.images.select("id").collect()} for tag, d in three.items()}
    assert set(ids) == {"train", "vali", "test"} and sum(map(len, ids.values())) == len(set.union(*ids.values()))
    two = splits.coerce_datasets(base=base, no_test=True)
    assert {r.id for r in two["train"].images.select("id").collect()} == ids["train"] | ids["test"] and set(two) == {"train", "vali"}
    sums = [r["sum"] for r in splits.class_frequency(three).collect()]
    assert sums == sorted(sums) and len(sums) == 10
