"""Annotations of samples: which ones a sample meets in each frame, and where they lie in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from .overlap import BOX, overlaps
from .targets import sample_boxes, sample_frames

#: What with_annots may name.
PARTS = ("boxes", "segmentation", "keypoints")


def target_annotations(resolved: DataFrame, data: Dataset) -> DataFrame:
    """target_id, image_id and aid of annotations that touch a target's unpadded slice, taken as image coordinates in each frame."""
    one = F.when(F.col("gids").isNull(), F.array("gid")).otherwise(F.col("gids"))
    d = lambda c: F.col(c).cast("double")
    windows = resolved.select("target_id", F.explode(one).alias("image_id"), d("x0").alias("x1"), d("y0").alias("y1"), d("x1").alias("x2"), d("y1").alias("y2"))
    return overlaps(windows, data.annots).select("target_id", "image_id", "aid")


def sample_annotations(resolved: DataFrame, data: Dataset, visible: float = 0.0, scale: float = 1.0, only: DataFrame | None = None, own: tuple[str, ...] = (), stills: bool = False) -> DataFrame:
    """target_id, rel_frame, image_id, aid, category_id, the box (rx1, ry1, rx2, ry2) in sample space and columns `own` of annotations.

    Overlap is tested in image space; the box of a video sample is mapped there and widened to whole
    numbers. only (target_id, aid) restricts a target to listed annotations. stills: see sample_frames.
    """
    met = framed_annotations(sample_frames(resolved, data.images, stills=stills), data, visible, own)
    if only is not None:
        met = met.join(only.select("target_id", "aid"), ["target_id", "aid"], "left_semi")
    return met.select("target_id", "rel_frame", "image_id", "aid", "category_id", *in_sample(scale), *own)


def framed_annotations(frames: DataFrame, data: Dataset, visible: float = 0.0, own: tuple[str, ...] = (), how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    """target_id, rel_frame, image_id, s, dx, dy and columns `more` of frames of samples, and aid, category_id, box and columns `own` of each annotation that a frame meets.

    An annotation brings its box and other columns along, so that pairs are not joined with annotations again.
    """
    s = F.coalesce("vid_scale", F.lit(1.0))
    box = tuple(map(F.col, ("sx1", "sy1", "sx2", "sy2")))
    moved = g.quantize(g.warp(box, g.scaling(1 / s)))
    in_image = [F.when(F.col("vidid").isNotNull(), m.cast("double")).otherwise(b).alias(n) for m, b, n in zip(moved, box, ("x1", "y1", "x2", "y2"))]
    windows = frames.select("target_id", "rel_frame", "image_id", s.alias("s"), "dx", "dy", *more, *in_image)
    return overlaps(windows, data.annots, visible, how, own=(*BOX, *own))


def in_sample(scale: float = 1.0) -> list[Column]:
    """The box of an annotation that a frame meets (see framed_annotations), in sample space."""
    to_sample = g.compose(g.scaling(F.lit(scale)), g.compose(g.translation(F.col("dx"), F.col("dy")), g.scaling(F.col("s"))))
    return [c.alias(n) for c, n in zip(g.warp(tuple(map(F.col, BOX)), to_sample), ("rx1", "ry1", "rx2", "ry2"))]


def annotation_index(resolved: DataFrame, annots: DataFrame) -> DataFrame:
    """target_id, sorted aids of its sample, and the place of its own annotation in them (-1 without)."""
    listed = annots.groupBy("target_id").agg(F.array_sort(F.collect_set("aid")).alias("aids"))
    rows = resolved.select("target_id", "aid").join(listed, "target_id", "left").withColumn("aids", F.coalesce("aids", F.array().cast("array<bigint>")))
    place = F.coalesce(F.array_position("aids", F.col("aid")), F.lit(0)).cast("int") - 1
    return rows.select("target_id", "aids", place.alias("annot_idx"))


def asked_parts(data: Dataset, with_annots: str | list[str]) -> tuple[tuple[str, ...], Callable]:
    """(columns of annotations that with_annots, a list or "+"-separated, names; what makes a struct of all that it names, with the box in sample space by a scale)."""
    asked = with_annots.split("+") if isinstance(with_annots, str) else list(with_annots)
    if unknown := set(asked) - set(PARTS):
        raise ValueError(f"unknown parts of annotations: {sorted(unknown)}")
    extra = tuple(c for c in ("segmentation", "keypoints") if c in asked and c in data.annots.columns)
    return extra, lambda scale: F.struct("rel_frame", "aid", "category_id", *(in_sample(scale) if "boxes" in asked else []), *extra)


def listed_annotations(resolved: DataFrame, data: Dataset, with_annots: str | list[str], visible: float = 0.0, scale: float = 1.0) -> DataFrame:
    """target_id, rel_frame and annots, an array of what with_annots (a list, or "+"-separated) names of each annotation that a frame meets."""
    extra, part = asked_parts(data, with_annots)
    met = framed_annotations(sample_frames(resolved, data.images), data, visible, extra)
    return met.groupBy("target_id", "rel_frame").agg(F.array_sort(F.collect_list(part(scale))).alias("annots"))


def load_samples(resolved: DataFrame, data: Dataset, with_annots: str | list[str] | None = "boxes", visible: float = 0.0, scale: float = 1.0, stills: bool = False) -> DataFrame:
    """One row a sample: its parameters and, as with_annots (a list, or "+"-separated) asks, arrays of its annotations (null without any). stills: see sample_frames."""
    if not with_annots:
        return sample_boxes(resolved)
    extra, part = asked_parts(data, with_annots)
    # A sample's parameters go with its frames, so that its annotations are not joined with it again; stills are put together where their images are.
    frames = sample_frames(resolved, data.images, empty=True, stills=stills).withColumn("sample", F.struct(*[c for c in resolved.columns if c != "target_id"]))
    met = framed_annotations(frames, data, visible, extra, "left", ("sample", "there"))
    listed = F.array_sort(F.collect_list(F.when(F.col("aid").isNotNull() & F.col("there"), part(scale))))
    rows = met.groupBy("target_id", "sample", *(["image_id"] if stills else [])).agg(listed.alias("annots"))
    return sample_boxes(rows.select("target_id", "sample.*", F.when(F.size("annots") > 0, F.col("annots")).alias("annots"))).select(*sample_boxes(resolved).columns, "annots")


def segmentations(annots: DataFrame, aids: DataFrame) -> DataFrame:
    """place, aid and segmentation in the order asked for; aids has place and aid."""
    return aids.join(annots.select(F.col("id").alias("aid"), "segmentation"), "aid", "left").select("place", "aid", "segmentation")


def decode_keypoints(flat: Column, names: Column) -> Column:
    """Array of (name, x, y, visible) from x, y, v triplets and a category's names."""
    n = F.floor(F.size(flat) / 3).cast("int")
    at = lambda i, k: F.get(flat, i * 3 + F.lit(k))
    each = lambda i: F.struct(F.get(names, i).alias("name"), at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).cast("int").alias("visible"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).otherwise(F.array().cast("array<struct<name:string,x:double,y:double,visible:int>>"))


def keypoint_names(categories: DataFrame) -> DataFrame:
    """One row: names, a map from the id of each keypoint category (id, name) to its name."""
    return categories.agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("long"), "name"))).alias("names"))


def decode_keypoint_structs(points: Column, names: Column) -> Column:
    """The same array as decode_keypoints gives, from structs of keypoint_category_id, xy and visible; null gives an empty one, an unknown category a null name."""
    each = lambda p: F.struct(F.try_element_at(names, p["keypoint_category_id"].cast("long")).alias("name"), F.get(p["xy"], F.lit(0)).alias("x"), F.get(p["xy"], F.lit(1)).alias("y"), p["visible"].cast("int").alias("visible"))
    return F.coalesce(F.transform(points, each), F.array().cast("array<struct<name:string,x:double,y:double,visible:int>>"))


def images_with_annotations(images: DataFrame, annots: DataFrame) -> DataFrame:
    """A row for each annotation of each image, with all columns of both; images without annotations have one row with nulls.

    Columns of annotations are named annot_id, annot_w and so on.
    """
    named = annots.select(*[F.col(c).alias(f"annot_{c}") for c in annots.columns])
    return images.join(named, F.col("id") == F.col("annot_image_id"), "left").drop("annot_image_id")


def class_names(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with the name of their category_id."""
    return rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("class_name")), "category_id", "left")


def class_ids(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with the category_id of their class_name."""
    return rows.join(categories.select(F.col("name").alias("class_name"), F.col("id").alias("category_id")), "class_name", "left")
