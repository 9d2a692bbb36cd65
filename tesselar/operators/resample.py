"""Channels resampled onto a sample's grid: linear with smoothing, or nearest, as separable weighted sums on arrays in tasks.

A grid is cut into bands of at most BAND lines. A band's source region is what its pixels take weight from, so it reaches past
tile borders (its halo); the tiles it meets are joined once, by image, channel and tile, and dealt by bands. A task puts the parts of a band together,
resamples its source lines along x and sums them along y. So a row is a band or a line, never a pixel, and no row grows with
the height of an image.

A pixel of the grid has its centre at u + 0.5, which the map takes to c in the channel. Linear weights fall from c to both sides, to nothing at a distance of
one pixel, or of one grid pixel where that is larger (the channel is shrunk), so that every source pixel counts. Weights
outside the channel are left out and the rest brought to one. A pixel whose c is outside the channel has the fill value.
Maps may scale, shift and flip; those that turn or shear are for rasters.aligned_pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .rasters import TILE, MadeTiles, Parts, Rows, Summary, largest_part, listed, pictures_by_band, spots, starts_of

BAND = 64
NAN = float("nan")


#: Bands are resampled by shape where there are so many times as many of them as of shapes.
ALIKE = 3
#: What a band's lines are named by.
KEYS = ["sample_id", "rel_frame", "channel", "ya", "x0"]
#: What the bands of a frame's channels at one place have in common.
PLACE = ["sample_id", "rel_frame", "ya", "x0"]
FRAME = ["sample_id", "rel_frame"]


def taps(u: np.ndarray, a: np.ndarray, t: np.ndarray, n: np.ndarray, linear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pixels u of grids: whether they are inside of 0 .. n - 1, their first source pixels, weights (0 past the last) and sums of these."""
    c = a * (u + 0.5) + t
    inside = (c >= 0) & (c < n)
    c = np.where(inside, c, 0.5)
    if not linear:
        return inside, np.floor(c).astype(np.int64), np.ones((len(c), 1)), np.ones(len(c))
    half = np.maximum(np.abs(a), 1.0)
    first = np.maximum(np.floor(c - half - 0.5) + 1, 0).astype(np.int64)
    last = np.minimum(np.ceil(c + half - 0.5) - 1, n - 1).astype(np.int64)
    j = first[:, None] + np.arange((last - first).max(initial=0) + 1)
    weights = np.where(j <= last[:, None], 1 - np.abs(j + 0.5 - c[:, None]) / half[:, None], 0.0)
    weights[first == last] = np.arange(weights.shape[1]) == 0  # a lone pixel is taken as it is
    total = np.zeros(len(c))
    for k in range(weights.shape[1]):
        total = total + weights[:, k]
    return inside, first, weights, total


def along(values: np.ndarray, gone: np.ndarray | None, start: np.ndarray, step: np.ndarray | int, most: np.ndarray, first: np.ndarray, own: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Weighted means along an axis, and which are null: result i is of the values at start[i] + step * (first[i] + k), k counting on to at most most[i], by the weights of own[i]."""
    out = np.zeros(len(own))
    lost = None if gone is None else np.zeros(len(own), bool)
    for k in range(weights.shape[1]):
        weight = weights[own, k]
        used = weight != 0
        at = start + step * np.clip(first + k, 0, most)
        part = values[at] * weight
        out = out + (part if used.all() else np.where(used, part, 0.0))
        if lost is not None:
            lost |= gone[at] & used
    return out / sums[own], lost


def axis(some: dict, names: tuple[str, ...], linear: bool) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Along one axis of bands: taps of all pixels, where a band's begin, and from where to where (0 and 0 where no pixel is inside) these reach in the source."""
    lo, hi, s, t, n = (some[c] for c in names)
    size = (hi - lo).astype(np.int64)
    base = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size)), size)
    found = taps(np.arange(len(which)) - base[which] + lo[which], s[which], t[which], n[which], linear)
    inside, first, weights, _ = found
    far = np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.where(inside, first, far), base)
    most = np.maximum.reduceat(np.where(inside, first + (weights != 0).sum(1), 0), base)
    return found, base, np.where(least == far, 0, least), most


def together(values: np.ndarray, axis: int, found: tuple, start: int) -> np.ndarray:
    """What `along` gives, along an axis of windows of one shape whose pixels have the same taps."""
    _, first, weights, sums = found
    shape = [-1 if i == axis else 1 for i in range(3)]
    out = 0.0
    for k in range(weights.shape[1]):
        weight = weights[:, k]
        used = weight != 0
        part = values.take(np.clip(first - start + k, 0, values.shape[axis] - 1), axis) * weight.reshape(shape)
        out = out + (part if used.all() else np.where(used.reshape(shape), part, 0.0))
    return out / sums.reshape(shape)


def resampled(some: dict, parts: Parts, linear: bool, fill: float) -> np.ndarray:
    """The pixels of bands, one after the other, from the parts of tiles that they take weight from."""
    names = (("ya", "yb", "sy", "ty_", "height"), ("x0", "x1", "sx", "tx_", "width"))
    # Bands of one shape, place and map have the same weights.
    _, one, kind = np.unique(np.column_stack([some[c] for c in (*names[0], *names[1])]).astype(np.float64), axis=0, return_index=True, return_inverse=True)
    kind = kind.ravel()
    (wy, row, top, bottom), (wx, column, left, right) = ((found, *(v[kind] for v in more)) for found, *more in (axis({c: some[c][one] for c in own}, own, linear) for own in names))
    live = (bottom > top) & (right > left)
    top, bottom, left, right = (np.where(live, v, 0) for v in (top, bottom, left, right))
    source, there, gone = parts.pasted(top, bottom, left, right, 0.0)
    high, wide = bottom - top, right - left
    if not (there == 1).all():
        bad = int(np.flatnonzero(there != 1)[0])
        band = int(np.searchsorted(np.cumsum(high * wide), bad, "right"))
        raise ValueError(f"tiles are {'repeated' if there[bad] else 'missing'} for { {c: v[band] for c, v in some.items()} }")
    grid_high, grid_wide = ((some[b] - some[a]).astype(np.int64) for a, b in (("ya", "yb"), ("x0", "x1")))
    out = np.full((grid_high * grid_wide).sum(), float(fill))
    keep = np.repeat(live, grid_high * grid_wide)
    if not live.any():
        return out
    begin = lambda size: np.cumsum(size) - size
    if gone is None and ALIKE * len(one) <= len(kind):
        start, end = begin(high * wide), begin(grid_high * grid_wide)
        for i in range(len(one)):
            same = np.flatnonzero(kind == i)
            b = same[0]
            if live[b]:
                whole = source[start[same][:, None] + np.arange(high[b] * wide[b])].reshape(len(same), high[b], wide[b])
                y, x = (tuple(v[at : at + n] for v in w) for w, at, n in ((wy, row[b], grid_high[b]), (wx, column[b], grid_wide[b])))
                made = together(together(whole, 2, x, left[b]), 1, y, top[b])
                good = y[0][:, None] & x[0]
                out[end[same][:, None] + np.arange(good.size)] = (made if good.all() else np.where(good, made, fill)).reshape(len(same), -1)
        return out
    # Along x for each line of the source, then along y.
    which, i, x = spots(np.where(live, high, 0), grid_wide)
    own = column[which] + x
    lines, lost = along(source, gone, begin(high * wide)[which] + i * wide[which], 1, wide[which] - 1, wx[1][own] - left[which], own, wx[2], wx[3])
    which, y, x = spots(np.where(live, grid_high, 0), grid_wide)
    own = row[which] + y
    made, lost = along(lines, lost, begin(np.where(live, high, 0) * grid_wide)[which] + x, grid_wide[which], high[which] - 1, wy[1][own] - top[which], own, wy[2], wy[3])
    good = wy[0][own] & wx[0][column[which] + x]
    if lost is not None:
        good &= ~lost
    out[keep] = np.where(good, made, fill)
    return out


def bands_of(grids: DataFrame, linear: bool, band: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Grids (sample_id, rel_frame, gid, channel, y0, y1, x0, x1, warp, height, width) cut into bands; top .. right hold all that their pixels may take weight from, null if nothing does.

    A grid's first band has its other columns `more`, the others nulls.
    """
    a, b, c, d, e, f = g.affine(F.col("warp"))
    turned = F.raise_error(F.lit("a map that turns or shears can't be resampled along lines")).cast("double")
    rows = grids.where("y1 > y0 and x1 > x0").withColumns({"sx": F.when((b == 0) & (d == 0), a).otherwise(turned), "tx_": c, "sy": e, "ty_": f})
    rows = rows.withColumn("ya", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1, F.lit(band).cast("long")))).withColumn("yb", F.least(F.col("ya") + band, F.col("y1")))

    def reach(lo: str, hi: str, s: str, t: str, n: str) -> tuple[Column, Column]:
        own, size = F.col(s), F.col(n)
        ends = [own * (u + 0.5) + F.col(t) for u in (F.col(lo), F.col(hi) - 1)]
        least, most = F.least(*ends), F.greatest(*ends)
        near, far = F.greatest(least, F.lit(0.0)), F.least(most, size.cast("double"))
        half = F.greatest(F.abs(own), F.lit(1.0))
        first = F.greatest(F.floor(near - half - 0.5) + 1, F.lit(0)) if linear else F.floor(near)
        last = F.ceil(far + half - 0.5) if linear else F.floor(far) + 1
        return tuple(F.when((most >= 0) & (least < size), v).cast("long") for v in (first, F.least(last, size)))

    (top, bottom), (left, right) = reach("ya", "yb", "sy", "ty_", "height"), reach("x0", "x1", "sx", "tx_", "width")
    both = lambda v: F.when(top.isNotNull() & left.isNotNull(), v)
    rows = rows.withColumns({"top": both(top), "bottom": both(bottom), "left": both(left), "right": both(right)})
    return rows.select(*KEYS, "yb", "x1", "gid", "height", "width", "sx", "tx_", "sy", "ty_", "top", "bottom", "left", "right", *[F.when(F.col("ya") == F.col("y0"), F.col(c)).alias(c) for c in more])


def aligned_lines(tiles: DataFrame | MadeTiles, grids: DataFrame, linear: bool = True, fill: float = NAN, tile: int = TILE, band: int = BAND, then: Summary | None = None) -> DataFrame:
    """sample_id, rel_frame, channel, y, x (of the first pixel) and values of every line of every grid.

    grids: sample_id, rel_frame, gid, channel, y0, y1, x0, x1 (of the grid; one gid for each sample, frame and channel), warp (six numbers, grid to channel coordinates, pixel centres at halves), height and width of the channel.
    A band whose tiles are not all there is an error. `then` puts a summary in place of values.
    """
    picture = lambda some, parts: resampled(some, parts, linear, float(fill))
    return pictures_by_band(tiles, bands_of(grids, linear, band), KEYS, ("ya", "x0"), ("yb", "x1"), picture, tile, then).drop("ya", "x0")


def fused_lines(lines: DataFrame, channels: list[str]) -> DataFrame:
    """One row a line (sample_id, rel_frame, y, x) with a column of values for each channel; NaN where a frame lacks it."""
    wide = lines.groupBy("sample_id", "rel_frame", "y", "x").pivot("channel", channels).agg(F.first("values"))
    own = [F.col(f"`{c}`") for c in channels]
    width = F.greatest(*[F.coalesce(F.size(c), F.lit(-1)) for c in own], F.lit(0), F.lit(0))
    return wide.select("sample_id", "rel_frame", "y", "x", *[F.coalesce(c, F.array_repeat(F.lit(NAN), width)).alias(n) for c, n in zip(own, channels)])


def side_by_side(channels: list[str], own: list[str], by_frame: bool) -> Callable:
    """What makes one row of the lines of several channels at one place, or of all lines of a frame: columns own of heads, y and an array a channel, or an array of structs of these; NaN for a channel without a band."""

    def of(heads: pa.RecordBatch, y: np.ndarray, high: np.ndarray, wide: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        slot = starts_of(heads, PLACE)
        at = np.repeat(np.arange(len(slot)), np.diff(np.append(slot, heads.num_rows)))
        begin = lambda n: np.cumsum(n) - n
        size, rows = high * wide, high[slot]
        source, target = begin(size), begin(size[slot])
        line = np.repeat(slot, rows)
        columns = [pa.array(y[line] + np.arange(len(line)) - np.repeat(begin(rows), rows))]
        for channel in channels:
            mine = np.flatnonzero(pc.fill_null(pc.equal(heads.column("channel"), channel), False).to_numpy(zero_copy_only=False))
            made, n = np.full(size[slot].sum(), NAN), size[mine]
            step = np.arange(n.sum()) - np.repeat(begin(n), n)
            made[np.repeat(target[at[mine]], n) + step] = values[np.repeat(source[mine], n) + step]
            columns.append(listed(made, wide[line]))
        names = ["y", *channels]
        if by_frame:
            frame = starts_of(heads, FRAME)
            lines = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(line, frame), len(line)).astype(np.int32)), pa.StructArray.from_arrays(columns, names))
            line, columns, names = frame, [lines], ["lines"]
        return pa.RecordBatch.from_arrays([*heads.select(own).take(pa.array(line)).columns, *columns], names=[*own, *names])

    return of


def aligned_channels(tiles: DataFrame | MadeTiles, grids: DataFrame, channels: list[str], linear: bool = True, fill: float = NAN, tile: int = TILE, band: int = BAND, by_frame: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """fused_lines of aligned_lines, put together by the tasks that resample: sample_id, rel_frame, gid, y and an array for each channel, NaN where a frame lacks it.

    The grids of a frame are of one image and size; one with null as channel gives rows to a frame that has none. by_frame: a row a frame, with
    lines, an array of structs of y and the channels' arrays, and columns `more` of grids.
    """
    bands = bands_of(grids, linear, band, more)
    own = [*FRAME, "gid", *more]
    arrays = [T.StructField("y", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels]]
    schema = [*bands.select(*own).schema.fields, *([T.StructField("lines", T.ArrayType(T.StructType(arrays)))] if by_frame else arrays)]
    then = Rows(side_by_side(channels, own, by_frame), T.StructType(schema), [*PLACE, "channel", "gid", *more], FRAME if by_frame else PLACE)
    picture = lambda some, parts: resampled(some, parts, linear, float(fill))
    return pictures_by_band(tiles, bands, [*PLACE, "channel"], ("ya", "x0"), ("yb", "x1"), picture, tile, then)


def realigned(tiles: DataFrame | MadeTiles, parts: DataFrame, linear: bool = True, tile: int = TILE, band: int = BAND, then: Summary | None = None) -> DataFrame:
    """All channels of each image on the grid of its largest one, as lines (sample_id is the image).

    parts: gid, channel, height, width and warp (part to image) of every channel; the map from the largest part's grid to a part goes by the image.
    """
    big = largest_part(parts).select("gid", F.col("channel").alias("big_channel"), F.col("height").alias("big_height"), F.col("width").alias("big_width"))
    maps = parts.select(F.col("gid").alias("big_gid"), F.col("channel").alias("of"), F.col("warp").alias("big_warp"))
    big = big.join(maps, (F.col("gid") == F.col("big_gid")) & (F.col("big_channel") == F.col("of"))).drop("big_gid", "of", "big_channel")
    between = g.compose(g.invert(g.affine(F.col("warp"))), g.affine(F.col("big_warp")))
    zero = F.lit(0).cast("long")
    grids = parts.join(big, "gid").select(
        F.col("gid").alias("sample_id"), F.lit(0).alias("rel_frame"), "gid", "channel", zero.alias("y0"), F.col("big_height").cast("long").alias("y1"), zero.alias("x0"), F.col("big_width").cast("long").alias("x1"), F.array(*between).alias("warp"), "height", "width"
    )
    return aligned_lines(tiles, grids, linear, NAN, tile, band, then)
