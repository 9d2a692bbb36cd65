"""Joins of windows with annotations of the same image.

All joins have the image as equality key, so Catalyst plans a hash or sort-merge join with the
range as residual condition; many annotations on one image are left to AQE's skew join, or joined by cells of the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.staging import staged


#: Columns of an annotation's box.
BOX = ("ax1", "ay1", "ax2", "ay2")


def boxed(annots: DataFrame, *more: str) -> DataFrame:
    """aid, image_id, category_id, the box and more columns of annotations that have one."""
    return annots.where("x is not null").select(F.col("id").alias("aid"), "image_id", "category_id", *[c.alias(n) for c, n in zip(g.xywh_box(*map(F.col, "xywh")), BOX)], *more)


def overlaps(windows: DataFrame, annots: DataFrame, visible: float = 0.0, how: str = "inner", clipped: bool = False, own: tuple[str, ...] = ()) -> DataFrame:
    """windows (image_id, x1, y1, x2, y2, ...) with aid, category_id, iou, iooa and shared of each annotation that touches.

    visible: least share of the annotation that must be inside (strict); 0 asks for contact only.
    clipped: also the part of the annotation's box inside the window. own: more columns of the annotation, as BOX.
    """
    a = boxed(annots, *[c for c in own if c not in BOX]).withColumnRenamed("image_id", "a_image")
    w, b = g.box(), g.box("a")
    on = (F.col("image_id") == F.col("a_image")) & g.touches(b, w)
    if visible > 0:
        on = on & (g.iooa(w, b) > visible)
    met = windows.join(a, on, how)
    edges = [f(F.col("a" + n), F.col(n)).alias(n) for n, f in (("x1", F.greatest), ("y1", F.greatest), ("x2", F.least), ("y2", F.least))]
    more = [F.struct(*edges).alias("clipped")] if clipped else []
    return met.select(*windows.columns, *more, "aid", "category_id", g.iou(w, b).alias("iou"), g.iooa(w, b).alias("iooa"), g.shared_area(w, b).alias("shared"), g.area(b).alias("annot_area"), *own)


def overlaps_by_cell(windows: DataFrame, annots: DataFrame, visible: float = 0.0, cell: int = 256) -> DataFrame:
    """The rows of overlaps, joined by square cells of an image, for images so crowded that none should be in one task.

    Windows and boxes are in each cell that they reach; a pair counts in the cell of its first common point, so it comes once.
    """
    reached = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    whole = lambda p: F.col(f"{p}x2") >= F.col(f"{p}x1")
    a = boxed(annots).withColumnRenamed("image_id", "a_image").where(whole("a") & (F.col("ay2") >= F.col("ay1")))
    a = a.withColumn("a_cx", reached("ax1", "ax2")).withColumn("a_cy", reached("ay1", "ay2"))
    keyed = windows.where(whole("") & (F.col("y2") >= F.col("y1"))).withColumn("_cx", reached("x1", "x2")).withColumn("_cy", reached("y1", "y2"))
    w, b = g.box(), g.box("a")
    first = lambda lo: F.floor(F.greatest(F.col(lo), F.col(f"a{lo}")) / cell)
    on = (F.col("image_id") == F.col("a_image")) & (F.col("_cx") == F.col("a_cx")) & (F.col("_cy") == F.col("a_cy"))
    on = on & g.touches(b, w) & (F.col("_cx") == first("x1")) & (F.col("_cy") == first("y1"))
    if visible > 0:
        on = on & (g.iooa(w, b) > visible)
    # Spark takes exploded tables for as small as they were, and would broadcast them.
    met = keyed.join(a.hint("merge"), on)
    return met.select(*windows.columns, "aid", "category_id", g.iou(w, b).alias("iou"), g.iooa(w, b).alias("iooa"), g.shared_area(w, b).alias("shared"), g.area(b).alias("annot_area"))


def annotations_of(images: DataFrame, annots: DataFrame) -> DataFrame:
    """The rows of annots whose image is in images."""
    return annots.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def union_area(boxes: Column) -> Column:
    """Exact area of the union of an array of boxes (x1, y1, x2, y2): slabs between their x edges, intervals joined along y in each."""
    edges = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x1"]), F.transform(boxes, lambda b: b["x2"]))))
    start = F.struct(F.lit(0.0).alias("covered"), F.lit(float("-inf")).alias("end"))

    def add(a: Column, b: Column) -> Column:
        fresh = F.greatest(b["y2"] - F.greatest(b["y1"], a["end"]), F.lit(0.0))
        return F.struct((a["covered"] + fresh).alias("covered"), F.greatest(a["end"], b["y2"]).alias("end"))

    def slab(lo: Column, hi: Column) -> Column:
        spans = F.transform(F.filter(boxes, lambda b: (b["x1"] <= lo) & (b["x2"] >= hi)), lambda b: F.struct(b["y1"], b["y2"]))
        return (hi - lo) * F.aggregate(F.array_sort(spans), start, add, lambda a: a["covered"])

    each = lambda es: F.transform(es, lambda lo, i: F.when(i + F.lit(1) < F.size(es), slab(lo, F.get(es, i + F.lit(1)))).otherwise(0.0))
    return F.aggregate(g.bound(edges, each), F.lit(0.0), lambda a, x: a + x)


#: Boxes of an image up to which its union is taken of all of them at once, as an array.
CROWDED = 500


def uncovered_area(images: DataFrame, annots: DataFrame, cell: int = 256, crowded: int = CROWDED) -> DataFrame:
    """id, covered and uncovered (areas) of each image. Boxes are shuffled as one array an image; images of more than `crowded` boxes are cut in cells."""
    size = images.select(F.col("id").alias("image_id"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    boxes = boxed(annots)
    large = staged(boxes.groupBy("image_id").count().where(F.col("count") > crowded).select("image_id"), "crowded")
    many = not large.isEmpty()
    few = boxes.join(large, "image_id", "left_anti") if many else boxes
    listed = few.groupBy("image_id").agg(F.collect_set(F.struct("ax1", "ay1", "ax2", "ay2")).alias("boxes"))
    edges = lambda b: (F.greatest(b["ax1"], F.lit(0.0)), F.greatest(b["ay1"], F.lit(0.0)), F.least(b["ax2"], "width"), F.least(b["ay2"], "height"))
    inside = F.transform("boxes", lambda b: F.struct(*[e.alias(n) for e, n in zip(edges(b), ("x1", "y1", "x2", "y2"))]))
    rows = size.join(listed, "image_id", "left").withColumn("boxes", F.filter(inside, lambda b: (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])))
    rows = rows.select("image_id", "width", "height", union_area(F.col("boxes")).alias("covered"))
    if many:
        cut = cell_unions(size.join(large, "image_id", "left_semi"), boxes, cell).withColumnRenamed("covered", "in_cells")
        rows = rows.join(cut, "image_id", "left").withColumn("covered", F.coalesce("in_cells", "covered")).drop("in_cells")
    covered = F.coalesce("covered", F.lit(0.0))
    return rows.select(F.col("image_id").alias("id"), covered.alias("covered"), (F.col("width") * F.col("height") - covered).alias("uncovered"))


def cell_unions(size: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """image_id and covered (area) of the images of size (image_id, width, height) that have boxes inside; unions are taken in cells."""
    b = boxes.join(size, "image_id")
    x1, y1, x2, y2 = (F.greatest("ax1", F.lit(0.0)), F.greatest("ay1", F.lit(0.0)), F.least("ax2", "width"), F.least("ay2", "height"))
    inside = b.select("image_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x1 < x2 AND y1 < y2").distinct()
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.ceil(F.col(hi) / cell) - 1)
    cut = inside.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))
    part = lambda f, name, at: f(F.col(name), (F.col(at) * cell).cast("double")).alias(name)
    cut = cut.withColumns({"ex": F.col("cx") + 1, "ey": F.col("cy") + 1})
    box = F.struct(part(F.greatest, "x1", "cx"), part(F.greatest, "y1", "cy"), part(F.least, "x2", "ex"), part(F.least, "y2", "ey"))
    return cut.groupBy("image_id", "cx", "cy").agg(union_area(F.collect_set(box)).alias("area")).groupBy("image_id").agg(F.sum("area").alias("covered"))
