"""Pools of training items, negatives relative to anchors, spread-out positives."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import Dataset
from ..sources.staging import dropped, staged
from .ordinals import with_ordinal
from .overlap import boxed
from .targets import TARGET

BACKGROUND = 0
ITEM = ("aid", "gid", "category_id", "cx", "cy", "width", "height")


class MissingNegatives(LookupError):
    """Negatives are asked for where no pool of them was made, or fewer exist than asked for."""


def numbered_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (w, h relative to the shorter image side) with at, their place; there are at most as many as negative_anchors gives."""
    return anchors.select("w", "h", (F.row_number().over(W.orderBy(g.portable_hash(F.col("aid"), 0), "aid")) - 1).alias("at"))


def relative_negatives(data: Dataset, anchors: DataFrame, num: int, thresh: float = 0.0, tries: int = 2, rounds: int = 5, exact: bool | str = "warn", seed: int = 0) -> DataFrame:
    """num windows sized by hashed anchors that cover less than thresh of any annotation (0: touch none).

    Up to `rounds` rounds of `tries` places an image are drawn until num windows are free; with
    fewer, exact=True raises, "warn" warns and False keeps silent.
    """
    listed = staged(numbered_anchors(anchors), "anchors")  # a few rows of a whole join, read in each round
    n = listed.count()
    a = boxed(data.annots).withColumnRenamed("image_id", "a_image")
    on = (F.col("image_id") == F.col("a_image")) & g.touches(g.box("a"), g.box())
    if thresh > 0:
        on = on & (g.iooa(g.box(), g.box("a")) >= thresh)
    kept, have = None, 0
    for k in range(rounds if n else 0):
        tried = data.images.withColumn("try", F.explode(F.sequence(F.lit(k * tries), F.lit(k * tries + tries - 1))))
        tried = tried.withColumn("cand", F.col("id") * (tries * rounds) + F.col("try"))
        tried = tried.withColumn("at", (g.portable_hash(F.col("cand"), seed + 4) % n).cast("int")).join(F.broadcast(listed), "at")
        side = F.least("width", "height")
        size = lambda c: F.least(F.greatest(F.floor(F.col(c) * side), F.lit(1)), F.col("width" if c == "w" else "height")).cast("long")
        tried = tried.select("cand", F.col("id").alias("image_id"), "width", "height", size("w").alias("bw"), size("h").alias("bh"))
        place = lambda s, whole, own: (g.portable_hash(F.col("cand"), seed + s) % (F.col(whole) - F.col(own) + 1)).cast("double")
        tried = tried.select("cand", "image_id", place(1, "width", "bw").alias("x1"), place(2, "height", "bh").alias("y1"), "bw", "bh")
        tried = tried.withColumns({"x2": F.col("x1") + F.col("bw"), "y2": F.col("y1") + F.col("bh")}).drop("bw", "bh")
        free = staged(tried.join(a, on, "left_anti"), "free-windows")
        kept = free if kept is None else kept.unionByName(free)
        have += free.count()
        if have >= num:
            break
    if kept is None or have < num:
        if exact is True:
            raise MissingNegatives(f"{have} of {num} negatives found")
        if exact:
            warnings.warn(f"{have} of {num} negatives found", stacklevel=2)
    if kept is None:
        kept = data.images.sparkSession.createDataFrame([], "cand long, image_id long, x1 double, y1 double, x2 double, y2 double")
    return kept.orderBy(g.portable_hash(F.col("cand"), seed + 3), "cand").limit(num)


def negative_items(negatives: DataFrame) -> DataFrame:
    """Negatives as items of a pool: aid -1, the background class, centre form."""
    c = lambda lo, hi: ((F.col(lo) + F.col(hi)) / 2).cast("float")
    d = lambda lo, hi: (F.col(hi) - F.col(lo)).cast("float")
    return negatives.select("cand", F.lit(-1).cast("long").alias("aid"), F.col("image_id").alias("gid"), F.lit(BACKGROUND).alias("category_id"), c("x1", "x2").alias("cx"), c("y1", "y2").alias("cy"), d("x1", "x2").alias("width"), d("y1", "y2").alias("height"))


def item_pool(positives: DataFrame, negatives: DataFrame | None) -> DataFrame:
    """Positives by aid, then negatives by candidate, each with its ordinal and is_positive."""
    pos = with_ordinal(positives.select(*ITEM), ["aid"]).withColumn("is_positive", F.lit(True))
    if negatives is None:
        return pos
    neg = with_ordinal(negative_items(negatives), ["cand"]).withColumn("is_positive", F.lit(False)).drop("cand")
    return pos.unionByName(neg.withColumn("ordinal", F.col("ordinal") + pos.count()))  # of the staged rows, not of what made them


def items_at(pool: DataFrame, wanted: DataFrame, kind: str = "item") -> DataFrame:
    """The pool's items at the ordinals of wanted; kind counts all items, or the positives or negatives alone."""
    if kind == "negative":
        first = pool.where("not is_positive").agg(F.min("ordinal")).first()[0]
        if first is None:
            raise MissingNegatives("the pool has no negatives")
        pool = pool.where("not is_positive").withColumn("ordinal", F.col("ordinal") - first)
    elif kind == "positive":
        pool = pool.where("is_positive")
    return pool.join(wanted.select("ordinal"), "ordinal")


def preselect(positives: DataFrame, negatives: Callable[[int], DataFrame] | None = None, n_pos: int | None = None, n_neg: int | None = None, ratio: float | None = None, seed: int = 0) -> DataFrame:
    """A pool of n_pos positives in hashed order (all without it) and as many negatives as n_neg, or ratio times the positives, says.

    negatives(n) makes n of them. With neither n_neg nor ratio there are none.
    """
    chosen = positives
    if n_pos is not None:
        chosen = staged(positives.orderBy(g.portable_hash(F.col("aid"), seed + 7), "aid").limit(n_pos), "positives")
    if n_neg is None and ratio is not None:
        n_neg = int(ratio * chosen.count())
    if n_neg and negatives is None:
        raise MissingNegatives("nothing makes negatives")
    return item_pool(chosen, negatives(n_neg) if n_neg else None)


def pool_counts(pool: DataFrame) -> DataFrame:
    """One row: n_positives, n_negatives and n_samples of a pool."""
    return pool.agg(F.count_if("is_positive").alias("n_positives"), F.count_if(~F.col("is_positive")).alias("n_negatives"), F.count("*").alias("n_samples"))


def drawn_images(windows: DataFrame) -> DataFrame:
    """image_id and n, the number of windows drawn on it, of images that have any."""
    return windows.groupBy("image_id").agg(F.count("*").alias("n"))


def drawn_ordinals(spark: SparkSession, num: int, size: int, seed: int = 0) -> DataFrame:
    """num rows (target_id, ordinal), each ordinal drawn by hash from 0 to size - 1, with repeats."""
    if size <= 0:
        raise LookupError("nothing to draw from")
    rows = spark.range(num).withColumnRenamed("id", "target_id")
    return rows.withColumn("ordinal", g.portable_hash(F.col("target_id"), seed + 8) % size)


def item_targets(pool: DataFrame, wanted: DataFrame, kind: str = "item") -> DataFrame:
    """Targets of the pool's items at the ordinals of wanted (target_id, ordinal), for targets.resolve.

    Further columns of wanted that a target may have win over the item's where they are not null. kind counts all
    items, or the positives or negatives alone. Ordinals go round: one past the last is the first again, -1 the last.
    """
    if kind not in ("item", "positive", "negative"):
        raise ValueError(f"unknown kind {kind!r}")
    counted = pool.agg(F.count_if("is_positive").alias("positive"), F.count("*").alias("item")).first()
    first = counted["positive"] if kind == "negative" else 0
    size = counted["item"] - counted["positive"] if kind == "negative" else counted[kind]
    if not size:
        if kind == "negative":
            raise MissingNegatives("the pool has no negatives")
        raise LookupError(f"the pool has no {kind}")
    own = set(wanted.columns)
    at = wanted.withColumn("_at", F.pmod("ordinal", F.lit(size)) + first).withColumnsRenamed({c: f"_new_{c}" for c in ITEM if c in own})
    rows = at.join(pool.select(F.col("ordinal").alias("_at"), "is_positive", *ITEM), "_at")
    return rows.withColumns({c: F.coalesce(F.col(f"_new_{c}").cast(TARGET[c]), F.col(c).cast(TARGET[c])) for c in ITEM if c in own}).drop("_at", *[f"_new_{c}" for c in ITEM])


#: Targets of an image up to which they are looked at one after the other, as an array.
CROWDED = 2000


def spread_positives(targets: DataFrame, window: tuple[int, int], thresh: float = 0.0, seed: int = 0, crowded: int = CROWDED) -> DataFrame:
    """aid and gid of targets whose windows (height, width), centred on them, overlap at most thresh (IoU).

    Greedy in each image by hashed scores: a window stays if it overlaps no better one that stayed too much. Images of more than
    `crowded` targets get the same result in rounds over cells.
    """
    h, w = float(window[0]), float(window[1])
    scored = targets.select("gid", "aid", g.portable_hash(F.col("aid"), seed + 5).alias("score"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    scored = staged(scored, "scored")  # read several times
    sizes, many = scored.groupBy("gid").count(), (F.col("count") > crowded) & F.col("gid").isNotNull()
    images, n_large = sizes.agg(F.count("*"), F.count_if(many)).first()
    if images and n_large == images:
        return spread_in_rounds(scored, w, h, thresh)
    large = staged(sizes.where(many).select("gid"), "crowded") if n_large else None
    few = scored if large is None else scored.join(large, "gid", "left_anti")
    one = F.struct("score", "aid", "x", "y")
    rows = few.groupBy("gid").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.array().cast("array<struct<score:bigint,aid:bigint,x:double,y:double>>")
    kept = F.aggregate("all", none, lambda have, p: F.when(F.exists(have, lambda q: window_iou(p["x"] - q["x"], p["y"] - q["y"], w, h) > thresh), have).otherwise(F.concat(have, F.array(p))))
    found = rows.select("gid", F.explode(kept).alias("p")).select(F.col("p.aid").alias("aid"), "gid")
    return found if large is None else found.unionByName(spread_in_rounds(scored.join(large, "gid", "left_semi"), w, h, thresh))


def window_iou(dx: Column, dy: Column, w: float, h: float) -> Column:
    """IoU of two windows of one size whose centres are so far apart."""
    both = F.greatest(F.lit(w) - F.abs(dx), F.lit(0.0)) * F.greatest(F.lit(h) - F.abs(dy), F.lit(0.0))
    return both / (F.lit(2 * w * h) - both)


#: Cells along a side of a block, and how many windows of a block a round looks at.
SIDE, LISTED = 16, 256


def spread_in_rounds(scored: DataFrame, w: float, h: float, thresh: float, side: int = SIDE, listed: int = LISTED) -> DataFrame:
    """aid and gid of what greedy selection keeps of scored (gid, aid, score, x, y), without an image in one task.

    Cells are as large as a window, so only windows of adjacent cells overlap; a block has side x side cells, and a rim of one cell that it shares
    with its neighbours. A round takes the best `listed` windows of each block and its rim. All that are better than one of these are listed
    with it, so its fate is known unless it hangs on one of the rim, or on one that does. Those left over, and those not listed, that no
    kept window overlaps too much go to the next round. The best window of an image is always kept, so rounds end.
    """
    block = lambda c: F.floor((F.col(c) + side // 2) / side)  # noqa: E731  (images up to half a block each way lie in one)
    reached = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + (side // 2 + i)) / side) for i in (-1, 0, 1)])))
    in_cells = lambda rows: rows.withColumns({"cx": F.floor(F.col("x") / w), "cy": F.floor(F.col("y") / h)})
    types = dict(scored.dtypes)
    none = F.array().cast(f"array<struct<score:bigint,aid:{types['aid']},x:double,y:double,own:boolean>>")

    def step(state: Column, p: Column) -> Column:
        meets = lambda name: F.coalesce(F.exists(state[name], lambda q: window_iou(p["x"] - q["x"], p["y"] - q["y"], w, h) > thresh), F.lit(False))
        grown = lambda name, on: F.when(on, F.concat(state[name], F.array(p))).otherwise(state[name]).alias(name)
        open_ = ~p["own"] | meets("unsure")
        return F.struct(grown("kept", ~open_ & ~meets("kept")), grown("unsure", open_ & ~meets("kept")))

    left, rounds = scored, []
    while True:
        seen = in_cells(left).withColumn("bx", reached("cx")).withColumn("by", reached("cy"))
        seen = seen.select("gid", "bx", "by", "score", "aid", "x", "y", ((F.col("bx") == block("cx")) & (F.col("by") == block("cy"))).alias("own"))
        best = seen.withColumn("nth", F.row_number().over(W.partitionBy("gid", "bx", "by").orderBy("score", "aid"))).where(F.col("nth") <= listed)
        blocks = best.groupBy("gid", "bx", "by").agg(F.array_sort(F.collect_list(F.struct("score", "aid", "x", "y", "own"))).alias("all"))
        last = F.element_at("all", -1)
        state = F.aggregate("all", F.struct(none.alias("kept"), none.alias("unsure")), step)
        until = F.when(F.size("all") == listed, F.struct(last["score"].alias("score"), last["aid"].alias("aid"))).alias("until")
        blocks = blocks.select("gid", "bx", "by", state.alias("s"), until).select("gid", "bx", "by", "s.kept", F.filter("s.unsure", lambda p: p["own"]).alias("unsure"), "until")
        final = staged(blocks.where("size(kept) + size(unsure) > 0 OR until IS NOT NULL"), "kept")
        rounds.append(final)
        unsure, full = final.agg(F.sum(F.size("unsure")), F.count("until")).first()
        rest = None
        if unsure or full:
            rest = final.select("gid", F.inline("unsure")).drop("own")
            if full:
                more = in_cells(left).withColumns({"bx": block("cx"), "by": block("cy")}).join(final.where("until IS NOT NULL").select("gid", "bx", "by", "until"), ["gid", "bx", "by"])
                rest = rest.unionByName(more.where(F.struct("score", "aid") > F.col("until")).select(*rest.columns))
            shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            going_on = final.where("size(unsure) > 0 OR until IS NOT NULL").select("gid").distinct()
            near = in_cells(final.join(going_on, "gid", "left_semi").select("gid", F.inline("kept"))).withColumn("s", F.explode(shifts))
            near = near.select(F.col("gid").alias("k_gid"), (F.col("cx") + F.col("s.i")).alias("k_cx"), (F.col("cy") + F.col("s.j")).alias("k_cy"), F.col("x").alias("k_x"), F.col("y").alias("k_y"))
            over = window_iou(F.col("x") - F.col("k_x"), F.col("y") - F.col("k_y"), w, h) > thresh
            rest = in_cells(rest).join(near, (F.col("gid") == F.col("k_gid")) & (F.col("cx") == F.col("k_cx")) & (F.col("cy") == F.col("k_cy")) & over, "left_anti")
            rest = staged(rest.drop("cx", "cy"), "undecided")
        if left is not scored:
            dropped(left)
        if rest is None or rest.isEmpty():
            break
        left = rest
    found = [final.select("gid", F.inline("kept")).select("aid", "gid") for final in rounds]
    return reduce(DataFrame.unionByName, found)


def toy_samples(indices: DataFrame, size: tuple[int, int] = (416, 416), classes: int = 3, most: int = 4, seed: int = 0) -> DataFrame:
    """Made-up boxes for each index of a table: index, k, category_id and the box, the same for the same seed, made where they are read."""
    h, w = size
    rows = indices.select(F.col("index").cast("long").alias("index")).withColumn("n", g.portable_hash(F.col("index"), seed) % most + 1)
    rows = rows.select("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    key = F.col("index") * most + F.col("k")
    r = lambda s: g.portable_hash(key, seed * 31 + s)
    rows = rows.select("index", "k", (r(1) % classes + 1).alias("category_id"), (r(2) % (w // 2) + 8).alias("w"), (r(3) % (h // 2) + 8).alias("h"), r(4).alias("rx"), r(5).alias("ry"))
    return rows.select("index", "k", "category_id", (F.col("rx") % (w - F.col("w"))).alias("x"), (F.col("ry") % (h - F.col("h"))).alias("y"), "w", "h")
