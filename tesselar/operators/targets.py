"""From loosely given targets to exact slices: default values, bounds, windows, frames.

A table of targets has target_id and any of the columns of TARGET; missing ones and nulls are inferred.
A target with a video or a list of images is a video target (its slices are in video space), else one
with an image is an image target. Left joins on keys do all of it, so millions of targets are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from .grid import ordered_frames

TARGET = {
    **{c: "long" for c in ("aid", "gid", "image_id", "vidid", "video_id", "category_id", "y0", "y1", "x0", "x1", "t0", "t1", "pad_y", "pad_x")},
    **{c: "array<long>" for c in ("gids", "image_ids")},
    **{c: "double" for c in ("cx", "cy", "width", "height")},
    "window": "string",
}
#: Column that an alias stands for, where that is null.
ALIASES = {"image_id": "gid", "image_ids": "gids", "video_id": "vidid"}


def normalized(targets: DataFrame) -> DataFrame:
    """target_id and all columns of TARGET but the aliases, which fill what they stand for."""
    has = set(targets.columns)
    col = lambda c: (F.col(c) if c in has else F.lit(None)).cast(TARGET[c])
    named = {of: alias for alias, of in ALIASES.items()}
    return targets.select("target_id", *[F.coalesce(col(c), col(named[c])).alias(c) if c in named else col(c).alias(c) for c in TARGET if c not in ALIASES])


def common_video(targets: DataFrame, images: DataFrame) -> DataFrame:
    """target_id, video_id of the first listed image that has one, and n_videos that the images belong to."""
    listed = normalized(targets).select("target_id", F.posexplode("gids").alias("at", "id"))
    met = listed.join(images.select("id", "video_id"), "id")
    return met.groupBy("target_id").agg(F.min_by("video_id", F.when(F.col("video_id").isNotNull(), F.col("at"))).alias("video_id"), F.count_distinct("video_id").alias("n_videos"))


def window_of(window: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(height, width) of a window given as "extent", "square" or "height,width"; null is "extent"."""
    parts = F.split(window, ",")
    fixed = lambda i: F.try_element_at(parts, F.lit(i)).cast("long")
    eh, ew = g.window_extent(F.when(window.contains(","), "extent").otherwise(F.coalesce(window, F.lit("extent"))), width, height)
    return F.when(window.contains(","), fixed(1)).otherwise(eh), F.when(window.contains(","), fixed(2)).otherwise(ew)


def left_on(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """rows left-joined with right by a whole-number key; rows without a key meet nothing, and are dealt to all tasks instead of to one."""
    dealt = rows.withColumn("_dealt", F.coalesce(F.col(key), F.xxhash64("target_id")))
    return dealt.join(right.withColumn("_dealt", F.col(key)), [key, "_dealt"], "left").drop("_dealt")


def resolve(targets: DataFrame, data: Dataset) -> DataFrame:
    """One row a target: aid, gid, vidid, category_id, gids (frames in order), space_height, space_width, slices and padding.

    An unknown aid, and an annotation without a box, give no centre; a target without slice and centre
    takes the whole extent. A target without image and video is an error. Columns that targets don't have cost no join.
    """
    t = normalized(targets)
    centre = (F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"))
    known = data.annots.select(F.col("id").alias("aid"), F.col("image_id").alias("a_gid"), F.col("category_id").cast("long").alias("a_category_id"), *[F.when(F.col("x").isNotNull(), c.cast("double")).alias(f"a_{n}") for c, n in zip(centre, ("cx", "cy", "width", "height"))])
    filled = ("gid", "category_id", "cx", "cy", "width", "height")
    if "aid" in targets.columns:
        t = left_on(t, known, "aid").withColumns({c: F.coalesce(F.col(c), F.col(f"a_{c}")) for c in filled}).drop(*[f"a_{c}" for c in filled])
    if {"gids", "image_ids"} & set(targets.columns):
        given = common_video(targets, data.images).select("target_id", F.col("video_id").alias("v"))
        t = t.join(given, "target_id", "left").withColumn("vidid", F.coalesce("vidid", "v")).drop("v")
    is_video = F.col("vidid").isNotNull() | F.col("gids").isNotNull()
    frames = ordered_frames(data.images).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("place", "image_id"))).alias("frames"))
    videos = data.videos.select(F.col("id").alias("vidid"), F.col("height").alias("v_height"), F.col("width").alias("v_width")).join(frames.withColumnRenamed("video_id", "vidid"), "vidid", "left")
    stills = not {"gids", "image_ids", "vidid", "video_id"} & set(targets.columns)
    if stills:
        t = t.withColumns({c: F.lit(None).cast(k) for c, k in videos.dtypes if c != "vidid"})
    else:
        t = left_on(t, videos, "vidid")
    lone = F.when(~is_video, F.col("gid")).when(F.col("vidid").isNull() & (F.size("gids") == 1), F.get("gids", F.lit(0)))
    images = data.images.select(F.col("id").alias("lone"), F.col("height").alias("i_height"), F.col("width").alias("i_width"))
    # Stills stay where their images are; one without an image is an error below.
    t = t.withColumn("lone", F.col("gid")).join(images, "lone", "left").withColumn("gid", F.col("lone")) if stills else left_on(t.withColumn("lone", lone), images, "lone")
    missing = F.raise_error(F.concat(F.lit("a target has neither image nor video: "), F.col("target_id").cast("string"))).cast("long")
    size = lambda c: F.when(is_video | F.col("gid").isNotNull(), F.coalesce(f"v_{c}", f"i_{c}").cast("long")).otherwise(missing)
    t = t.withColumns({"space_height": size("height"), "space_width": size("width")})
    asked = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    wh, ww = window_of(F.col("window"), F.col("width"), F.col("height"))
    (cx0, cx1), (cy0, cy1) = g.centred_slice(F.col("cx"), ww), g.centred_slice(F.col("cy"), wh)
    pick = lambda c, own, whole: F.coalesce(F.col(c), F.when(asked, own.cast("long")).otherwise(whole)).alias(c)
    n = F.coalesce(F.size("gids"), F.size("frames"), F.lit(0)).cast("long")
    t0, t1 = F.coalesce("t0", F.lit(0)), F.coalesce("t1", n)
    beyond = F.raise_error(F.lit("a time slice ends beyond its video")).cast("array<bigint>")
    chosen = F.when(F.col("gids").isNotNull(), F.col("gids")).otherwise(F.when(t1 > n, beyond).otherwise(F.transform(F.slice("frames", (t0 + 1).cast("int"), F.greatest(t1 - t0, F.lit(0)).cast("int")), lambda s: s["image_id"])))
    return t.select(
        "target_id", "aid", F.when(~is_video, F.col("gid")).alias("gid"), "vidid", "category_id", F.when(is_video, F.coalesce(chosen, F.array().cast("array<bigint>"))).alias("gids"), "space_height", "space_width",
        pick("y0", cy0, F.lit(0).cast("long")), pick("y1", cy1, F.col("space_height")), pick("x0", cx0, F.lit(0).cast("long")), pick("x1", cx1, F.col("space_width")),
        F.when(is_video, t0).alias("t0"), F.when(is_video, t1).alias("t1"), F.coalesce("pad_y", F.lit(0)).alias("pad_y"), F.coalesce("pad_x", F.lit(0)).alias("pad_x"),
    )


def sample_boxes(resolved: DataFrame) -> DataFrame:
    """resolved with the padded box (sx1, sy1, sx2, sy2) of each sample and the offset (dx, dy) into it."""
    box = g.padded(tuple(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")), F.col("pad_y"), F.col("pad_x"))
    named = resolved.withColumns({c: v for c, v in zip(("sx1", "sy1", "sx2", "sy2"), box)})
    return named.withColumns({"dx": F.lit(0.0) - F.col("sx1"), "dy": F.lit(0.0) - F.col("sy1")})


def sample_frames(resolved: DataFrame, images: DataFrame, empty: bool = False, stills: bool = False) -> DataFrame:
    """One row for each frame of each sample: rel_frame, image_id, vid_scale (null for image targets) and the sample's columns.

    empty: also for frames whose image is not there, and for samples without frames one, with null as there. stills: all samples are of images (else it is an
    error), so none is exploded, and resolved ones are where their images are.
    """
    rows = sample_boxes(resolved)
    if stills:
        video = F.raise_error(F.lit("a sample of a video is among stills")).cast("boolean")
        rows = rows.where(F.when(F.col("gids").isNull(), True).otherwise(video)).select("*", F.lit(0).alias("rel_frame"), F.col("gid").alias("image_id"), F.lit(None).cast("double").alias("vid_scale"))
        there = F.when(F.col("space_height").isNotNull(), True)
        return rows.withColumn("there", there) if empty else rows.where(there)
    one = F.when(F.col("gids").isNull(), F.array("gid")).otherwise(F.col("gids"))
    rows = rows.select("*", (F.posexplode_outer if empty else F.posexplode)(one).alias("rel_frame", "image_id"))
    scales = images.select(F.col("id").alias("image_id"), "vid_scale", *([F.lit(True).alias("there")] if empty else []))
    return rows.join(scales, "image_id", "left" if empty else "inner").withColumn("vid_scale", F.when(F.col("vidid").isNotNull(), F.col("vid_scale")))
