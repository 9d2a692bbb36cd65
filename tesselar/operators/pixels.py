"""Samples with their pixels: targets, channels, resampling and annotations put together.

A sample's grid has one pixel for each unit of its padded slice, times a scale. For each frame and channel the map from that grid to
the channel's own pixels is composed of the slice's offset, the frame's map from its video and the channel's from its image; resample.aligned_channels
does the rest, so pixels never leave the task that makes them but as results. sample_lines gives a row a line, whatever the size of a sample; load_pixels gathers the lines of each frame of each sample
in a row, with the annotations there, so its rows are as large as the windows asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from ..sources.staging import staged
from .rasters import TILE, MadeTiles
from .resample import BAND, NAN, aligned_channels
from .samples import listed_annotations
from .targets import sample_boxes, sample_frames

#: Fixed names that stand for several channels.
GROUPS = {"rgb": ("r", "g", "b"), "rgba": ("r", "g", "b", "a")}
#: name:n is name.0 to name.(n - 1); name.a:b is name.a to name.(b - 1).
RANGE = re.compile(r"^(.*?)(?:\.(\d+))?:(\d+)$")


def channel_list(request: str) -> list[str]:
    """The channels of a request such as "r|g", "rgb", "m:3" or "m.1:3", each once, in order; spaces don't count."""
    found = []
    for part in re.sub(r"\s", "", request).split("|"):
        if span := RANGE.match(part):
            name, first, last = span.groups()
            found += [f"{name}.{i}" for i in range(int(first or 0), int(last))]
        else:
            found += GROUPS.get(part, (part,) if part else ())
    return list(dict.fromkeys(found))


def channel_array(names: Column) -> Column:
    """The same for a column, as an array."""
    each = F.split(F.regexp_replace(names, r"\s", ""), r"\|")
    first = lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"\.(\d+):\d+$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    last = lambda p: F.regexp_extract(p, r":(\d+)$", 1).cast("int")
    stem = lambda p: F.regexp_replace(p, r"(\.\d+)?:\d+$", "")
    ranged = lambda p: F.when(last(p) > first(p), F.transform(F.sequence(first(p), last(p) - 1), lambda i: F.concat(stem(p), F.lit("."), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    one = lambda p: F.when(p.rlike(r":\d+$"), ranged(p)).when(p == "", F.array().cast("array<string>"))

    def expand(p: Column) -> Column:
        out = one(p)
        for name, members in GROUPS.items():
            out = out.when(p == name, F.array(*map(F.lit, members)))
        return out.otherwise(F.array(p))

    return F.array_distinct(F.flatten(F.transform(each, expand)))


def by_channel(assets: DataFrame, name: str = "channels") -> DataFrame:
    """A row for each channel of each asset, with column channel in place of the asset's own list."""
    return assets.withColumn("channel", F.explode(channel_array(F.col(name)))).drop(name)


def requested_assets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """sample_id, gid, place, channel and the asset's columns for each channel of requests (sample_id, gid, request), in the order asked for.

    Both sides are expanded, so "rgb" finds "r|g|b" and "m.1" finds "m:3". A channel that no asset of the image has comes out with nulls;
    a null request or <all> is every channel of the image, by name.
    """
    more = [c for c in assets.columns if c not in ("gid", "channels")]
    listed = assets.groupBy("gid").agg(F.collect_list(F.struct("channels", *more)).alias("assets"))
    of = lambda a: F.transform(channel_array(a["channels"]), lambda c: F.struct(c.alias("channel"), *[a[m].alias(m) for m in more]))
    # Channels are expanded after the shuffles: a row an image is shuffled, not one a channel.
    rows = requests.select("sample_id", "gid", "request").join(listed, "gid", "left").withColumn("have", F.flatten(F.transform(F.filter("assets", lambda a: a["channels"].isNotNull()), of)))
    every = F.col("request").isNull() | (F.col("request") == "<all>")
    asked = F.when(every, F.array_sort(F.array_distinct(F.transform("have", lambda h: h["channel"])))).otherwise(channel_array(F.col("request")))
    rows = rows.select("sample_id", "gid", "have", F.posexplode(asked).alias("place", "channel"))
    rows = rows.select("sample_id", "gid", "place", "channel", F.explode_outer(F.filter("have", lambda h: h["channel"] == F.col("channel"))).alias("found"))
    return rows.select("sample_id", "gid", "place", "channel", *[F.col("found")[m].alias(m) for m in more])


def channels_of(assets: DataFrame, request: str | None) -> list[str]:
    """What a request names, whether or not an asset has it; null or <all> is every channel, by name."""
    if request in (None, "<all>"):
        return sorted(r["channel"] for r in assets.select("channel").distinct().collect())  # names of channels, not rows of data
    return channel_list(request)


def placed_frames(resolved: DataFrame, data: Dataset, scale: float = 1.0, more: tuple[str, ...] = ()) -> DataFrame:
    """target_id, rel_frame, image_id, size (y1, x1) and to_image, the map from a sample's pixels to the image, of every frame of every sample; with more, a struct `sample` of these columns."""
    frames = sample_frames(resolved, data.images)
    s, by = F.coalesce("vid_scale", F.lit(1.0)), F.lit(float(scale))
    to_image = g.compose(g.scaling(1 / s), g.compose(g.translation(F.col("sx1"), F.col("sy1")), g.scaling(1 / by)))
    size = lambda lo, hi: F.round((F.col(hi) - F.col(lo)) * by).cast("long")
    return frames.select("target_id", "rel_frame", "image_id", F.array(*to_image).alias("to_image"), size("sy1", "sy2").alias("y1"), size("sx1", "sx2").alias("x1"), *([F.struct(*more).alias("sample")] if more else []))


def sample_grids(frames: DataFrame, assets: DataFrame, *more: str) -> DataFrame:
    """Grids for aligned_channels of placed frames, for each of the assets (gid, channel, height, width and warp to the image), and more columns of frames; a frame without any has one without a channel."""
    parts = assets.select(F.col("gid").alias("image_id"), "channel", "height", "width", F.col("warp").alias("to_img"))
    rows = frames.join(parts, "image_id", "left")
    warp = g.compose(g.invert(g.affine(F.col("to_img"))), g.affine(F.col("to_image")))
    zero, size = F.lit(0).cast("long"), lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("target_id").alias("sample_id"), "rel_frame", F.col("image_id").alias("gid"), "channel", zero.alias("y0"), "y1", zero.alias("x0"), "x1", F.array(*warp).alias("warp"), size("height"), size("width"), *more)


def sample_lines(
    resolved: DataFrame,
    data: Dataset,
    tiles: DataFrame | MadeTiles,
    assets: DataFrame,
    channels: str | None = None,
    interpolation: str | None = None,
    scale: float = 1.0,
    constant: float | None = None,
    nodata: str | None = None,
    dtype: str = "double",
    tile: int = TILE,
    band: int = BAND,
) -> DataFrame:
    """target_id, rel_frame, image_id, y and, for each channel, an array of the line's values.

    Channels that a frame lacks are NaN; pixels outside of an image are `constant`, else NaN where nodata is "float" or "auto", else 0.
    interpolation: linear (also for "auto" and null) or nearest. dtype is a Spark type; whole-number types have 0 for NaN.
    """
    wanted = channels_of(assets, channels)
    lines = aligned_frames(placed_frames(resolved, data, scale), tiles, assets, wanted, interpolation, constant, nodata, tile, band)
    return lines.select(F.col("sample_id").alias("target_id"), "rel_frame", F.col("gid").alias("image_id"), "y", *[cast_values(F.col(f"`{c}`"), dtype).alias(c) for c in wanted])


def cast_values(values: Column, dtype: str) -> Column:
    """Arrays of doubles as arrays of a Spark type; whole-number types have 0 for NaN."""
    whole = dtype in ("byte", "tinyint", "short", "smallint", "int", "integer", "long", "bigint")
    return values if dtype == "double" else F.transform(values, lambda v: (F.nanvl(v, F.lit(0.0)) if whole else v).cast(dtype))


def aligned_frames(frames: DataFrame, tiles: DataFrame | MadeTiles, assets: DataFrame, wanted: list[str], interpolation: str | None, constant: float | None, nodata: str | None, tile: int, band: int, by_frame: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """aligned_channels for placed frames; see sample_lines. Every line of every frame is there, so frames without any of the channels come out as NaN."""
    kind = interpolation or "auto"
    if kind not in ("auto", "linear", "nearest"):
        raise ValueError(f"unknown interpolation {kind!r}")
    fill = constant if constant is not None else NAN if nodata in ("float", "auto") else 0.0
    if not wanted:
        raise ValueError("no channel is asked for")
    grids = sample_grids(frames, assets.where(F.col("channel").isin(*wanted)), *more)
    return aligned_channels(tiles, grids, wanted, kind != "nearest", fill, tile, band, by_frame, more)


def load_pixels(
    resolved: DataFrame,
    data: Dataset,
    tiles: DataFrame | MadeTiles,
    assets: DataFrame,
    with_annots: str | None = "boxes",
    visible: float = 0.0,
    scale: float = 1.0,
    channels: str | None = None,
    interpolation: str | None = None,
    constant: float | None = None,
    nodata: str | None = None,
    dtype: str = "double",
    tile: int = TILE,
    band: int = BAND,
) -> DataFrame:
    """One row for each frame of each sample: target_id, rel_frame, image_id, its slice and offset, lines and annots.

    lines is an array of structs (y and an array a channel) from top to bottom; annots an array as listed_annotations gives it, of that frame only
    (null without any; no column if with_annots is none), in the sample's pixels. channels to band: see sample_lines.
    """
    if with_annots:
        resolved = staged(resolved, "resolved")  # read twice
    wanted, own = channels_of(assets, channels), ("category_id", "y0", "y1", "x0", "x1", "pad_y", "pad_x", "dx", "dy")
    frames, more = placed_frames(resolved, data, scale, own), ("sample", *(["annots"] if with_annots else []))
    if with_annots:
        listed = listed_annotations(resolved, data, with_annots, visible, scale)
        frames = frames.join(listed, ["target_id", "rel_frame"], "left")
    rows = aligned_frames(frames, tiles, assets, wanted, interpolation, constant, nodata, tile, band, True, more)
    lines = F.col("lines") if dtype == "double" else F.transform("lines", lambda s: F.struct(s["y"].alias("y"), *[cast_values(s[c], dtype).alias(c) for c in wanted]))
    return rows.select(F.col("sample_id").alias("target_id"), "rel_frame", F.col("gid").alias("image_id"), lines.alias("lines"), *[F.col("sample")[c].alias(c) for c in own], *more[1:])
