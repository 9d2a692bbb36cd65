"""Datasets as folders of JSON lines, which Spark splits over tasks however large a file is.

A dataset is a folder with images, videos, annotations and categories, a row a line, in the usual field names. Schemas are given, so
nothing is read before it is needed. An image has its file and channels, its warp to the video, and auxiliary files with their warps.
A warp is either a matrix (rows of numbers) or an object of scale (one or two numbers) and offset; it may be missing. An image's vid_scale is the x scale of its warp.
Fields that are not listed here are ignored, missing ones are null, and a line that is no JSON is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from .annotations import Dataset

AUXILIARY = "array<struct<file_name string, channels string, width int, height int, warp_aux_to_img string, warp_img_to_aux string>>"
SCHEMAS = {
    "images": f"id long, file_name string, width int, height int, video_id long, frame_index int, channels string, warp_img_to_vid string, auxiliary {AUXILIARY}",
    "videos": "id long, name string, width int, height int",
    "annotations": "id long, image_id long, category_id int, bbox array<double>, segmentation string, keypoints array<double>",
    "categories": "id int, name string, supercategory string, keypoints array<string>",
}


def warp_of(text: Column) -> Column:
    """Six numbers of a warp given as JSON text; null where there is none."""
    matrix = F.flatten(F.slice(F.from_json(text, "array<array<double>>"), 1, 2))
    parts = F.from_json(text, "struct<scale string, offset array<double>>")
    scales = F.from_json(parts["scale"], "array<double>")
    one = F.coalesce(parts["scale"].try_cast("double"), F.lit(1.0))
    x, y = F.coalesce(F.get(scales, F.lit(0)), one), F.coalesce(F.get(scales, F.lit(1)), one)
    at = lambda i: F.coalesce(F.get(parts["offset"], F.lit(i)), F.lit(0.0))
    zero = F.lit(0.0)
    return F.when(F.ltrim(text).startswith("["), matrix).when(text.isNotNull(), F.array(x, zero, at(0), zero, y, at(1)))


def matrix_text(warp: Column) -> Column:
    """A warp of six numbers as JSON text."""
    return F.to_json(F.array(F.slice(warp, 1, 3), F.slice(warp, 4, 3)))


def load_lines(spark: SparkSession, path: str) -> Dataset:
    """The dataset of a folder. images has vid_scale, vid_warp and auxiliary with warps of six numbers; annots has segmentation (JSON text) and keypoints."""
    rows = {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    part = lambda a: F.struct(*[a[c].alias(c) for c in ("file_name", "channels", "width", "height")], warp_of(a["warp_aux_to_img"]).alias("warp_aux_to_img"), warp_of(a["warp_img_to_aux"]).alias("warp_img_to_aux"))
    images = rows["images"].withColumn("vid_warp", warp_of(F.col("warp_img_to_vid"))).withColumn("auxiliary", F.transform("auxiliary", part))
    images = images.withColumn("vid_scale", F.coalesce(F.get("vid_warp", F.lit(0)), F.lit(1.0))).drop("warp_img_to_vid")
    box = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")]
    annots = rows["annotations"].select("id", "image_id", "category_id", *box, "segmentation", "keypoints")
    above = rows["categories"].select(F.col("name").alias("supercategory"), F.col("id").alias("parent_id"))
    categories = rows["categories"].join(above, "supercategory", "left").select("id", "name", "parent_id", "keypoints")
    return Dataset(images, rows["videos"], annots, categories)


def save_lines(data: Dataset, path: str) -> None:
    """Write a dataset so that load_lines gives it back; what it doesn't have is left out."""

    def put(name: str, rows: DataFrame) -> None:
        known = {c.split()[0] for c in SCHEMAS[name].replace(AUXILIARY, "x").split(", ")}
        rows.select(*[c for c in rows.columns if c in known]).write.json(f"{path}/{name}")

    has = set(data.images.columns)
    images, zero = data.images, F.lit(0.0)
    if "vid_warp" in has or "vid_scale" in has:
        images = images.withColumn("warp_img_to_vid", matrix_text(F.col("vid_warp") if "vid_warp" in has else F.array("vid_scale", zero, zero, zero, "vid_scale", zero)))
    if "auxiliary" in has:
        fields = data.images.schema["auxiliary"].dataType.elementType.names
        text = lambda a, c: matrix_text(a[c]).alias(c) if c.startswith("warp") else a[c].alias(c)
        images = images.withColumn("auxiliary", F.transform("auxiliary", lambda a: F.struct(*[text(a, c) for c in fields])))
    put("images", images)
    put("videos", data.videos)
    put("annotations", data.annots.withColumn("bbox", F.when(F.col("x").isNotNull(), F.array("x", "y", "w", "h"))))
    above = data.categories.select(F.col("id").alias("parent_id"), F.col("name").alias("supercategory"))
    put("categories", data.categories.join(above, "parent_id", "left"))


def auxiliary_rows(images: DataFrame) -> DataFrame:
    """gid, channels, file_name and warps of the auxiliary files of images, as rasters.asset_table takes them."""
    return images.select(F.col("id").alias("gid"), F.inline("auxiliary")).select("gid", "channels", "file_name", "warp_aux_to_img", "warp_img_to_aux")


def frame_warp(images: DataFrame) -> DataFrame:
    """image_id and its map to the video (the identity where none is given)."""
    return images.select(F.col("id").alias("image_id"), F.array(*g.affine(F.col("vid_warp"))).alias("warp"))
