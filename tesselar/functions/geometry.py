"""Box, slice and window arithmetic as Column functions. Boxes are (x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
Box = tuple[Column, Column, Column, Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used; a plain expression in a lambda is evaluated at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def xywh_box(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def touches(a: Box, b: Box) -> Column:
    """Closed overlap: boxes with a common edge count."""
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def shared_area(a: Box, b: Box) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side(0, 2) * side(1, 3)


def iou(a: Box, b: Box) -> Column:
    s = shared_area(a, b)
    return F.coalesce(F.try_divide(s, area(a) + area(b) - s), F.lit(0.0))


def iooa(a: Box, b: Box) -> Column:
    """Share of b that a covers."""
    return shared_area(a, b) / (area(b) + F.lit(EPS))


def scale(a: Box, by: Column) -> Box:
    return tuple(c * by for c in a)


def centred_slice(centre: Column, extent: Column) -> tuple[Column, Column]:
    """Whole-number bounds of `extent` around a centre."""
    lo = F.floor(centre - extent / 2)
    return lo, lo + extent


def window_extent(mode: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(height, width) of a window: "extent" is the box rounded up, "square" its longer side."""
    up_w, up_h = F.ceil(w), F.ceil(h)
    side = F.greatest(up_w, up_h)
    other = F.raise_error(F.concat(F.lit("unknown window: "), mode)).cast("long")
    pick = lambda own: F.when(mode == "extent", own).when(mode == "square", side).otherwise(other)
    return pick(up_h), pick(up_w)


def embed(start: Column, stop: Column, size: Column) -> tuple[Column, Column, Column, Column]:
    """(start, stop, pad before, pad after) of a slice inside [0, size)."""
    zero = F.lit(0)
    lo, hi = F.least(F.greatest(zero, start), size), F.greatest(F.least(size, stop), zero)
    return lo, F.greatest(lo, hi), F.greatest(zero, -start), F.greatest(zero, stop - size)


def rectify(start: Column, stop: Column, size: Column) -> tuple[Column, Column]:
    """A reader's slice: null is open, a negative stop counts from the end."""
    lo = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    hi = F.coalesce(stop, size)
    return lo, F.when(hi < 0, size + hi).otherwise(F.least(hi, size))


def rectify_at(place: Column) -> tuple[Column, Column]:
    """A reader's slice of one line."""
    return place, place + 1


def window_starts(size: Column, window: int | None, overlap: float) -> Column:
    """Array of starts of sliding windows; the last one ends at the edge."""
    if window is None:
        return F.array(F.lit(0))
    stride = max(1, round(window * (1 - overlap)))
    last = F.greatest(size - window, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def starts_around(place: Column, size: Column, window: int, overlap: float) -> Column:
    """Array of the starts of those sliding windows over 0 .. size - 1 that hold a place."""
    stride = max(1, round(window * (1 - overlap)))
    last = F.greatest(size - window, F.lit(0))
    low, high = F.greatest(F.ceil((place - window + 1) / stride), F.lit(0)).cast("int"), F.floor(F.least(place, last) / stride).cast("int")
    even = F.when(high >= low, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(even, F.when(place >= last, F.array(last)).otherwise(F.array().cast("array<int>"))))


def portable_hash(key: Column, seed: int) -> Column:
    """0 .. 2^31 - 2, the same in any engine; two rounds make neighbours independent."""
    once = (key + F.lit(seed * 7919)) * F.lit(48271).cast("long") % F.lit(2147483647)
    return (once + F.lit(seed * 7919)) * F.lit(48271).cast("long") % F.lit(2147483647)


#: An affine map (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f.
Affine = tuple[Column, Column, Column, Column, Column, Column]


def affine(values: Column | None) -> Affine:
    """The six numbers of an array; null is the identity."""
    one = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return tuple(F.lit(v) if values is None else F.coalesce(F.get(values, F.lit(i)).cast("double"), F.lit(v)) for i, v in enumerate(one))


def scaling(by: Column) -> Affine:
    zero = F.lit(0.0)
    return by, zero, zero, zero, by, zero


def translation(dx: Column, dy: Column) -> Affine:
    zero, one = F.lit(0.0), F.lit(1.0)
    return one, zero, dx, zero, one, dy


def compose(m: Affine, n: Affine) -> Affine:
    """The map that applies n first, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f


def invert(m: Affine) -> Affine:
    """The inverse map; null where there is none."""
    a, b, c, d, e, f = m
    det = F.nullif(a * e - b * d, F.lit(0.0))
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def warp(box_: Box, m: Affine) -> Box:
    """The axis-aligned box around the four mapped corners."""
    x1, y1, x2, y2 = box_
    a, b, c, d, e, f = m
    xs = [a * x + b * y + c for x in (x1, x2) for y in (y1, y2)]
    ys = [d * x + e * y + f for x in (x1, x2) for y in (y1, y2)]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def quantize(box_: Box) -> Box:
    """Whole-number box around a box."""
    return F.floor(box_[0]), F.floor(box_[1]), F.ceil(box_[2]), F.ceil(box_[3])


def padded(box_: Box, pad_y: Column, pad_x: Column) -> Box:
    return box_[0] - pad_x, box_[1] - pad_y, box_[2] + pad_x, box_[3] + pad_y


def coerce_pad(pad: Column, dims: int = 2) -> Column:
    """Padding before and after each dimension from an array: null is none, one number is for all dimensions,
    one number a dimension is for both its ends, two numbers a dimension are before and after."""
    n = F.size(pad)
    same = lambda i: F.struct(F.get(pad, F.lit(i)).alias("lo"), F.get(pad, F.lit(i)).alias("hi"))
    zero = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    each = F.array(*[same(i) for i in range(dims)])
    both = F.array(*[F.struct(F.get(pad, F.lit(2 * i)).alias("lo"), F.get(pad, F.lit(2 * i + 1)).alias("hi")) for i in range(dims)])
    wrong = F.raise_error(F.lit("padding does not fit the dimensions")).cast("array<struct<lo:bigint,hi:bigint>>")
    return F.when(pad.isNull(), F.array(*[zero] * dims)).when(n == 1, F.array(*[same(0)] * dims)).when(n == dims, each).when(n == 2 * dims, both).otherwise(wrong)


def fill_value(constant: Column, nodata: Column) -> Column:
    """Value of pixels outside an image: the given one, else NaN for float data without values, else 0."""
    return F.coalesce(constant.cast("double"), F.when(nodata.isin("float", "auto"), F.lit(float("nan"))).otherwise(F.lit(0.0)))


def resampling(interpolation: Column, antialias: Column) -> tuple[Column, Column]:
    """(interpolation, antialias) with defaults: linear, and smoothing for all but nearest."""
    kind = F.when(interpolation.isNull() | (interpolation == "auto"), "linear").otherwise(interpolation)
    return kind, F.coalesce(antialias, kind != "nearest")
