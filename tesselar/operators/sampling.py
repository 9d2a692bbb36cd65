"""Target tables, anchors, negatives and pools of training samples."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from ..sources.staging import staged
from .overlap import boxed

#: Numbers of candidates of different rounds are so far apart.
ROUND = 1 << 40
#: Images are narrower than this.
EDGES = 1 << 20


def targets(data: Dataset) -> DataFrame:
    """All positives: one row for each annotation with a box, centre form."""
    sizes = data.images.select(F.col("id").alias("gid"), F.col("width").alias("img_width"), F.col("height").alias("img_height"))
    f = lambda c, n: c.cast("float").alias(n)
    rows = data.annots.where("x is not null").select(
        F.col("id").alias("aid"), F.col("image_id").alias("gid"), "category_id", f(F.col("x") + F.col("w") / 2, "cx"), f(F.col("y") + F.col("h") / 2, "cy"), f(F.col("w"), "width"), f(F.col("h"), "height")
    )
    return rows.join(sizes, "gid").select("aid", "gid", "category_id", "cx", "cy", "width", "height", "img_width", "img_height")


def negative_anchors(rows: DataFrame, most: int = 1000, seed: int = 0) -> DataFrame:
    """Box sizes relative to the shorter image side, of `most` targets in hashed order."""
    side = F.least("img_width", "img_height")
    return rows.orderBy(g.portable_hash(F.col("aid"), seed), "aid").limit(most).select("aid", (F.col("width").cast("double") / side).alias("w"), (F.col("height").cast("double") / side).alias("h"))


def free_corners(data: Dataset, window: tuple[int, int]) -> DataFrame:
    """image_id, x1 and y1 of the uppermost window (width, height) without contact for each left edge worth a try, at whole pixels.

    A free window can be moved left and then up until an annotation or the border stops it, so the edges right behind annotations and the
    border's own are enough: an image has a row here if and only if it has a free place. Per edge the heights that annotations
    block are merged in order. An annotation meets at most as many edges as it and the window are wide.
    """
    w, h = window
    large = data.images.where((F.col("width") >= w) & (F.col("height") >= h)).select(F.col("id").alias("image_id"), (F.col("width") - w).cast("long").alias("most_x"), (F.col("height") - h).cast("long").alias("most_y"))
    boxes = boxed(data.annots).select("image_id", F.floor("ax2").alias("right"), F.ceil(F.col("ax1") - w).alias("left"), F.ceil(F.col("ay1") - h).alias("lo"), F.floor("ay2").alias("hi"))
    behind = boxes.select("image_id", (F.col("right") + 1).alias("x")).unionByName(large.select("image_id", F.lit(0).cast("long").alias("x"))).distinct()
    edges = behind.join(large, "image_id").where((F.col("x") >= 0) & (F.col("x") <= F.col("most_x"))).withColumn("cell", F.floor(F.col("x") / w))
    first, last = F.greatest(F.col("left"), F.lit(0)), F.least(F.col("right"), F.col("most_x"))
    spread = boxes.join(large.select("image_id", "most_x"), "image_id").where(first <= last).withColumn("cell", F.explode(F.sequence(F.floor(first / w), F.floor(last / w)))).drop("most_x")
    met = edges.join(spread, ["image_id", "cell"]).where("x between left and right").select("image_id", "x", "most_y", "lo", "hi")
    end = edges.select("image_id", "x", "most_y", (F.col("most_y") + 1).alias("lo"), (F.col("most_y") + 1).alias("hi"))
    above = W.partitionBy("image_id", "x").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    gaps = met.unionByName(end).withColumn("y", F.greatest(F.coalesce(F.max("hi").over(above), F.lit(-1)) + 1, F.lit(0))).where("y < lo and y <= most_y")
    return gaps.groupBy("image_id", "x").agg(F.min("y").alias("y")).select("image_id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))


def random_negatives(data: Dataset, window: tuple[int, int], num: int, thresh: float = 0.0, tries: int = 2, rounds: int = 5, seed: int = 0) -> DataFrame:
    """num windows (width, height) that meet no annotation by more than thresh of its area (0: no contact).

    In each of up to `rounds` rounds `tries` places are drawn on each image that is large enough, until num are free. With fewer, and
    a thresh of 0, the free corners of all images are added, so none is missed where an image has a place; then it warns if there still are fewer.
    The kept ones are taken in hashed order; free corners have candidate numbers below zero.
    """
    w, h = window
    large = data.images.where((F.col("width") >= w) & (F.col("height") >= h))
    a = boxed(data.annots).withColumnRenamed("image_id", "a_image")
    on = (F.col("image_id") == F.col("a_image")) & g.touches(g.box("a"), g.box())
    if thresh > 0:
        on = on & (g.iooa(g.box(), g.box("a")) >= thresh)
    found, have = None, 0
    for k in range(rounds):
        tried = large.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        key = F.col("id") * tries + F.col("try") + F.lit(k * ROUND).cast("long")
        place = lambda s, whole, own, key=key: (g.portable_hash(key, seed + s) % (F.col(whole) - own + 1)).cast("double")
        tried = tried.select(key.alias("cand"), F.col("id").alias("image_id"), place(1, "width", w).alias("x1"), place(2, "height", h).alias("y1")).withColumns({"x2": F.col("x1") + w, "y2": F.col("y1") + h})
        free = staged(tried.join(a, on, "left_anti"), "free-windows")
        found = free if found is None else found.unionByName(free)
        have += free.count()
        if have >= num:
            break
    if have < num and thresh <= 0:
        corners = free_corners(data, window).select((-1 - F.col("image_id") * EDGES - F.col("x1")).cast("long").alias("cand"), "image_id", "x1", "y1", (F.col("x1") + w).alias("x2"), (F.col("y1") + h).alias("y2"))
        corners = staged(corners if found is None else corners.join(found.select("image_id", "x1", "y1"), ["image_id", "x1", "y1"], "left_anti").select("cand", "image_id", "x1", "y1", "x2", "y2"), "free-corners")
        found = corners if found is None else found.unionByName(corners)
        have += corners.count()
    if have < num:
        warnings.warn(f"{have} of {num} negatives found", stacklevel=2)
    return found.orderBy(g.portable_hash(F.col("cand"), seed + 3), "cand").limit(num)
