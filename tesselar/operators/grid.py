"""Sliding-window grids over images and videos, labelled by the annotations they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from ..sources.staging import staged
from .overlap import boxed, overlaps, union_area

NEGATIVE = ("ignore", "background")
#: Boxes of an image up to which its windows look at them as an array.
CROWDED = 2000


def image_windows(images: DataFrame, window: tuple[int, int] | None, overlap: float = 0.0, *more: str) -> DataFrame:
    """image_id and the box of every window, and more columns of images; window is (height, width), None the whole image."""
    h, w = window or (None, None)
    rows = images.select(F.col("id").alias("image_id"), "width", "height", *more, F.explode(g.window_starts(F.col("height"), h, overlap)).alias("y0"))
    rows = rows.withColumn("x0", F.explode(g.window_starts(F.col("width"), w, overlap)))
    d = lambda c: c.cast("double")
    far_x = F.col("width") if w is None else F.col("x0") + w
    far_y = F.col("height") if h is None else F.col("y0") + h
    return rows.select("image_id", d(F.col("x0")).alias("x1"), d(F.col("y0")).alias("y1"), d(far_x).alias("x2"), d(far_y).alias("y2"), *more)


def image_grid(data: Dataset, window: tuple[int, int] | None, overlap: float = 0.0, interest: tuple[str, ...] = (), negative: tuple[str, ...] = NEGATIVE, ignore_over: float | None = 0.6, crowded: int = CROWDED) -> DataFrame:
    """One row a window: box, aids (sorted), n_counted and is_positive; windows that are mostly ignored are left out.

    A window is positive if it meets an annotation of the classes of interest (if none are named:
    of any class that is not negative). Windows look at their image's boxes as an array, so only images and boxes are shuffled; images of more than
    `crowded` boxes are joined box by box.
    """
    names = data.categories.select(F.col("id").alias("category_id"), F.lower("name").alias("name"))
    counts = F.col("name").isin(*map(str.lower, interest)) if interest else ~F.col("name").isin(*negative)
    flags = F.struct("category_id", F.coalesce(counts, F.lit(False)).alias("counted"), F.coalesce(F.col("name") == "ignore", F.lit(False)).alias("ignored"))
    kinds = names.select(flags.alias("k")).select("k.*")
    boxes = boxed(data.annots).join(F.broadcast(kinds), "category_id", "left")
    box = F.struct("aid", "ax1", "ay1", "ax2", "ay2", "counted", "ignored")
    listed = boxes.groupBy(F.col("image_id").alias("id")).agg(F.collect_list(box).alias("boxes"))
    if crowded is not None:
        large = staged(boxes.groupBy(F.col("image_id").alias("id")).count().where(F.col("count") > crowded).select("id"), "crowded")
        if not large.isEmpty():
            few = Dataset(data.images.join(large, "id", "left_anti"), data.videos, data.annots.join(large.withColumnRenamed("id", "image_id"), "image_id", "left_anti"), data.categories)
            found = image_grid(few, window, overlap, interest, negative, ignore_over, None)
            many = Dataset(data.images.join(large, "id", "left_semi"), data.videos, data.annots.join(large.withColumnRenamed("id", "image_id"), "image_id", "left_semi"), data.categories)
            return found.unionByName(crowded_grid(many, window, overlap, interest, negative, ignore_over))
    rows = image_windows(data.images.join(listed, "id", "left"), window, overlap, "boxes")
    w = g.box()
    touching = F.filter("boxes", lambda b: g.touches(tuple(b[c] for c in ("ax1", "ay1", "ax2", "ay2")), w))
    rows = rows.withColumn("met", F.coalesce(touching, F.array().cast(dict(rows.dtypes)["boxes"]))).drop("boxes")
    ignored = F.filter("met", lambda b: b["ignored"])
    edges = (("x1", F.greatest), ("y1", F.greatest), ("x2", F.least), ("y2", F.least))
    clipped = F.array_distinct(F.transform("ignored", lambda b: F.struct(*[f(b["a" + n], F.col(n)).alias(n) for n, f in edges])))
    own = lambda b: tuple(b[c] for c in ("ax1", "ay1", "ax2", "ay2"))
    grid = rows.select("image_id", "x1", "y1", "x2", "y2", F.array_sort(F.array_compact(F.array_distinct(F.transform("met", lambda b: b["aid"])))).alias("aids"), F.size(F.filter("met", lambda b: b["counted"] & b["aid"].isNotNull())).cast("long").alias("n_counted"), ignored.alias("ignored"))
    if ignore_over:
        size = g.area(w)
        over = lambda c: c / size > ignore_over
        total = F.aggregate("ignored", F.lit(0.0), lambda a, b: a + g.area(own(b)))
        most = F.aggregate("ignored", F.lit(0.0), lambda a, b: F.greatest(a, g.shared_area(w, own(b))))
        # Only windows that pass the cheap bound and have several such boxes need the exact union.
        whole = F.when(F.size(clipped) > 1, over(union_area(clipped))).otherwise(False)
        grid = grid.where(~F.when(~over(total), False).when(over(most), True).otherwise(whole))
    return grid.select("image_id", "x1", "y1", "x2", "y2", "aids", "n_counted", (F.col("n_counted") > 0).alias("is_positive"))


def crowded_grid(data: Dataset, window: tuple[int, int] | None, overlap: float = 0.0, interest: tuple[str, ...] = (), negative: tuple[str, ...] = NEGATIVE, ignore_over: float | None = 0.6) -> DataFrame:
    """The rows of image_grid, by a join of windows with boxes."""
    windows = image_windows(data.images, window, overlap)
    names = data.categories.select(F.col("id").alias("category_id"), F.lower("name").alias("name")) if data.categories is not None else None
    counts = F.col("name").isin(*map(str.lower, interest)) if interest else ~F.col("name").isin(*negative)
    ignored, size = F.col("name") == "ignore", g.area(g.box())
    met = overlaps(windows, data.annots, how="left", clipped=True).join(names, "category_id", "left")
    grid = met.groupBy("image_id", "x1", "y1", "x2", "y2").agg(
        F.array_sort(F.collect_set("aid")).alias("aids"),
        F.count(F.when(counts & F.col("aid").isNotNull(), 1)).alias("n_counted"),
        F.collect_set(F.when(ignored, F.col("clipped"))).alias("ignored"),
        F.coalesce(F.sum(F.when(ignored, F.col("annot_area"))), F.lit(0.0)).alias("ignored_sum"),
        F.coalesce(F.max(F.when(ignored, F.col("shared"))), F.lit(0.0)).alias("ignored_max"),
    )
    if ignore_over:
        over = lambda c: c / size > ignore_over
        # Only windows that pass the cheap bound and have several such boxes need the exact union.
        whole = F.when(F.size("ignored") > 1, over(union_area(F.col("ignored")))).otherwise(False)
        grid = grid.where(~F.when(~over(F.col("ignored_sum")), False).when(over(F.col("ignored_max")), True).otherwise(whole))
    return grid.select("image_id", "x1", "y1", "x2", "y2", "aids", "n_counted", (F.col("n_counted") > 0).alias("is_positive"))


def ordered_frames(images: DataFrame, *more: Column) -> DataFrame:
    """image_id, video_id, place (from 0, by frame index) and vid_scale of frames of videos, and more columns."""
    place = F.expr("CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_index, id) - 1 AS INT)")
    return images.where("video_id is not null").select(F.col("id").alias("image_id"), "video_id", place.alias("place"), "vid_scale", *more)


def video_grid(data: Dataset, window: tuple[int, int, int], overlap: float = 0.0) -> DataFrame:
    """One row a window of (frames, height, width) in video space: its aids and is_positive."""
    t, h, w = window
    # A frame names the windows that hold it, so neither lengths nor windows are joined with frames.
    length = F.expr("CAST(count(*) OVER (PARTITION BY video_id) AS INT)")
    frames = ordered_frames(data.images, length.alias("length")).withColumn("t0", F.explode(g.starts_around(F.col("place"), F.col("length"), t, overlap)))
    spans = frames.join(data.videos.select(F.col("id").alias("video_id"), "width", "height"), "video_id")
    for name, size, step in (("y0", "height", h), ("x0", "width", w)):
        spans = spans.withColumn(name, F.explode(g.window_starts(F.col(size), step, overlap)))
    d = lambda c: c.cast("double")
    boxes = (d(F.col("x0")), d(F.col("y0")), d(F.col("x0") + w), d(F.col("y0") + h))
    placed = spans.select("video_id", "t0", "x0", "y0", "image_id", *[c.alias(n) for c, n in zip(g.scale(boxes, 1 / F.col("vid_scale")), ("x1", "y1", "x2", "y2"))])
    met = overlaps(placed, data.annots, how="left")
    return met.groupBy("video_id", "t0", "x0", "y0").agg(F.array_sort(F.collect_set("aid")).alias("aids"), (F.count("aid") > 0).alias("is_positive"))


def sample_grid(data: Dataset, task: str, window: tuple, overlap: float = 0.0, **options) -> DataFrame:
    """The grid for a task: image_detection has windows of (height, width), video_detection of (frames, height, width)."""
    if task == "video_detection":
        return video_grid(data, window, overlap, **options)
    if task == "image_detection":
        return image_grid(data, window, overlap, **options)
    raise NotImplementedError(task)
