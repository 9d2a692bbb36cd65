"""Stratified folds of images: no image is in two folds, and each class is spread evenly over all of them.

`greedy_folds` is the sequential rule: largest image first, each to the fold where class ratios suffer least. It looks at one image
after the other, so it is for scopes of at most MOST_GROUPS images (a video, a small dataset), each folded as one array.

`stratified_folds` is for datasets of any size. Classes are taken from the rarest one on; the images whose rarest class it is are
dealt to the folds that hold fewest images of it so far. A round is one aggregate over the images of its class. What that leaves uneven in
classes that were never the rarest one is mended with a bounded number of images, which change folds, one by one or in
pairs, as long as that evens out the counts of all images.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import bound
from ..sources.staging import staged
from .ordinals import with_ordinal

MOST_GROUPS = 5000
#: Rounds of single classes; images whose rarest class is beyond them are dealt by their number alone.
ROUNDS = 64
#: Images that may change folds in the end, in hashed order.
SWING = 4096
#: Losses are compared at so many digits, which keeps equal ones equal whatever order they were added up in.
DIGITS = 10


def greedy_folds(annots: DataFrame, k: int = 3, scope: str | None = None, most: int = MOST_GROUPS) -> DataFrame:
    """(scope,) image_id and fold: in each scope images by number of annotations, then id, both falling; each goes to the fold of least loss.

    The loss of a fold is the squared distance of its class ratios from the scope's, with the image in it, plus the distances of the
    other folds, plus its share of all annotations so far; the first fold wins ties. A scope of more than `most` images is an error.
    """
    key = F.lit(0).alias("scope") if scope is None else F.col(scope).alias("scope")
    counts = annots.where("category_id is not null").select(key, "image_id", "category_id").groupBy("scope", "image_id", "category_id").agg(F.count("*").cast("double").alias("n"))
    images = counts.groupBy("scope", "image_id").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("category_id", "n"))).alias("of"))
    images = staged(images, "histograms")  # read twice
    sizes = images.groupBy("scope").agg(F.count("*").alias("images"))
    if (large := sizes.where(F.col("images") > most).limit(1).collect()) != []:
        raise ValueError(f"{large[0]['images']} images in one scope, at most {most} can be folded one after the other; use stratified_folds")
    rows = images.groupBy("scope").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "image_id", "of")))).alias("all"))
    rows = rows.withColumn("classes", F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda i: i["of"]["category_id"])))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    vector = lambda i: bound(F.map_from_entries(i["of"]), lambda n: F.transform("classes", lambda c: F.coalesce(F.try_element_at(n, c), F.lit(0.0))))
    rows = rows.withColumn("all", F.transform("all", lambda i: F.struct(i["image_id"].alias("image_id"), vector(i).alias("v"))))
    sums = F.aggregate("all", F.transform("classes", lambda c: F.lit(0.0)), lambda a, i: F.zip_with(a, i["v"], lambda x, y: x + y))
    rows = rows.withColumn("sums", sums)
    rows = rows.withColumn("target", F.transform("sums", lambda x: x / total(F.col("sums"))))

    def distance(freq: Column) -> Column:
        """Of a fold's class ratios from the scope's."""
        gaps = lambda of: F.zip_with(freq, F.col("target"), lambda x, t: (x / of - t) * (x / of - t))
        return total(bound(total(freq), gaps))

    first = total(F.transform("target", lambda t: t * t))
    start = F.struct(
        F.array_repeat(F.transform("classes", lambda c: F.lit(0.0)), k).alias("freq"),
        F.array_repeat(first, k).alias("far"),
        F.array().cast(f"array<struct<image_id:{dict(images.dtypes)['image_id']},fold:int>>").alias("folds"),
    )

    def step(state: Column, image: Column) -> Column:
        joined = F.transform(state["freq"], lambda f: bound(F.zip_with(f, image["v"], lambda x, y: x + y), lambda v: F.struct(v.alias("v"), distance(v).alias("far"))))

        def chosen(tried: Column, sums: Column, all_far: Column) -> Column:
            """The first fold of the least loss."""
            part = lambda i: F.when(sums["all"] > 0, F.get(sums["each"], i) / sums["all"]).otherwise(0.0)
            losses = F.transform(tried, lambda x, i: F.struct(F.round(all_far - F.get(state["far"], i) + x["far"] + part(i), DIGITS).alias("loss"), i.alias("fold")))
            return F.array_min(losses)["fold"]

        def after(tried: Column, best: Column) -> Column:
            keep = lambda old, name: F.transform(old, lambda x, i: F.when(i == best, F.get(tried, i)[name]).otherwise(x))
            return F.struct(keep(state["freq"], "v").alias("freq"), keep(state["far"], "far").alias("far"), F.concat(state["folds"], F.array(F.struct(image["image_id"].alias("image_id"), best.cast("int").alias("fold")))).alias("folds"))

        sums = F.struct(total(F.flatten(state["freq"])).alias("all"), F.transform(state["freq"], total).alias("each"))
        best = lambda tried: bound(sums, lambda s: bound(total(state["far"]), lambda a: chosen(tried, s, a)))
        return bound(joined, lambda tried: bound(best(tried), lambda fold: after(tried, fold)))

    found = rows.select("scope", F.inline(F.aggregate("all", start, step, lambda s: s["folds"])))
    return found.drop("scope") if scope is None else found.withColumnRenamed("scope", scope)


def segments(have: list[int]) -> list[tuple[int, int | None, list[int]]]:
    """How places 0, 1, ... go to folds that have so many already, fewest first: from, to (None: on), and the folds that take turns in between."""
    levels, found, at = sorted(set(have)), [], 0
    for low, high in zip(levels, [*levels[1:], None]):
        turn = [f for f, n in enumerate(have) if n <= low]
        end = None if high is None else at + (high - low) * len(turn)
        found.append((at, end, turn))
        at = end
    return found


def dealt(rows: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """rows (key, place, more) with the fold that the plan of their key gives to their place."""
    inside = (F.col("key") == F.col("plan_key")) & (F.col("place") >= F.col("low")) & (F.col("high").isNull() | (F.col("place") < F.col("high")))
    fold = F.get("turn", ((F.col("place") - F.col("low")) % F.size("turn")).cast("int"))
    return rows.join(F.broadcast(plan), inside).withColumn("fold", fold).drop("plan_key", "low", "high", "turn")


PLAN = "plan_key int, low long, high long, turn array<int>"


def settle(images: np.ndarray, folds: np.ndarray, excess: np.ndarray, steps: int = 20_000, beam: int = 400) -> np.ndarray:
    """Folds of some images (rows of 0 and 1 by class), changed so that the excess (fold by class, over all images) gets small.

    The change that lessens the sum of the excesses' fourth powers most is made as long as one does: an image goes to another fold, or two
    change places, of which the `beam` best ones of each fold are paired. Then the same with higher powers, which see the largest excess alone.
    """
    folds, excess, k, powers = folds.copy(), excess.astype(float), len(excess), [4, 8, 16, 32]
    for _ in range(steps):
        if np.abs(excess).max(initial=0) <= 1:
            break
        # Powers after one more or one less, less those before; for a row of classes these add up.
        more, less = (excess + 1) ** powers[0] - excess ** powers[0], (excess - 1) ** powers[0] - excess ** powers[0]
        gain_in, gain_out = images @ more.T, np.take_along_axis(images @ less.T, folds[:, None], 1)
        change = gain_in + gain_out
        change[np.arange(len(folds)), folds] = np.inf
        best = np.unravel_index(np.argmin(change), change.shape)
        option = change[best], [(best[0], best[1])]
        for f in np.argsort(-np.abs(excess).max(1), kind="stable"):  # pairs with the least even fold; with the next one where none helps
            for h in range(k):
                a, b = np.flatnonzero(folds == f), np.flatnonzero(folds == h)
                a, b = a[np.argsort(change[a, h], kind="stable")[:beam]], b[np.argsort(change[b, f], kind="stable")[:beam]]
                if h == f or not len(a) or not len(b):
                    continue
                stays = more[h] + less[f] + more[f] + less[h]  # of a class that both have nothing changes
                both = change[a, h][:, None] + change[b, f] - images[a] @ (stays[:, None] * images[b].T)
                i, j = np.unravel_index(np.argmin(both), both.shape)
                if both[i, j] < option[0]:
                    option = both[i, j], [(a[i], h), (b[j], f)]
            if option[0] < -1e-9:
                break
        if not option[0] < -1e-9:
            powers = powers[1:]
            if not powers:
                break
            continue
        for i, h in option[1]:
            excess[folds[i]] -= images[i]
            excess[h] += images[i]
            folds[i] = h
    return folds


def stratified_folds(annots: DataFrame, k: int = 3, seed: int = 0, rounds: int = ROUNDS, swing: int = SWING) -> DataFrame:
    """image_id and its fold 0 .. k - 1; images without annotations are in no fold. With swing = 0 folds stay as they were dealt."""
    pairs = annots.where("category_id is not null").select("image_id", "category_id").distinct()
    frequent = pairs.groupBy("category_id").agg(F.count("*").alias("images")).orderBy("images", "category_id").collect()  # one row a class
    classes, spark = len(frequent), annots.sparkSession
    ranks = spark.createDataFrame([(r["category_id"], i) for i, r in enumerate(frequent)], f"category_id {dict(annots.dtypes)['category_id']}, r int")
    images = pairs.join(F.broadcast(ranks), "category_id").groupBy("image_id").agg(F.array_sort(F.collect_list("r")).alias("ranks"))
    images = images.withColumn("key", F.least(F.get("ranks", F.lit(0)), F.lit(rounds)))
    mixed = g.portable_hash(F.col("image_id"), seed + 6)
    placed = with_ordinal(images.withColumn("mixed", mixed), ["key", "mixed", "image_id"])
    of_key = dict(placed.groupBy("key").count().collect())  # at most rounds + 1 rows
    starts, before = [], 0
    for key in sorted(of_key):
        starts.append((key, before))
        before += of_key[key]
    starts = spark.createDataFrame(starts, "start_key int, start long")
    placed = placed.join(F.broadcast(starts), F.col("key") == F.col("start_key")).select("image_id", "key", "ranks", "mixed", (F.col("ordinal") - F.col("start")).alias("place"))
    placed = staged(placed, "folds")
    counts, plan = np.zeros((k, classes + 1), np.int64), []  # the last column counts images
    for key in sorted(of_key):
        mine = [(key, low, high, turn) for low, high, turn in segments(counts[:, key if key < rounds else classes].tolist())]
        plan += mine
        now = dealt(placed.where(F.col("key") == key), spark.createDataFrame(mine, PLAN), k)
        for fold, r, n in now.select("fold", F.explode(F.concat("ranks", F.array(F.lit(classes)))).alias("r")).groupBy("fold", "r").count().collect():
            counts[fold, r] += n
    if not plan:
        return placed.select("image_id", F.lit(0).alias("fold"))
    found = dealt(placed, spark.createDataFrame(plan, PLAN), k).select("image_id", "fold", "ranks", "mixed")
    excess = counts[:, :classes] - counts[:, :classes].sum(0) / k
    if swing and np.abs(excess).max(initial=0) > 1:
        some = found.orderBy("mixed", "image_id").limit(swing).collect()
        has = np.zeros((len(some), classes))
        for i, r in enumerate(some):
            has[i, r["ranks"]] = 1
        old = np.array([r["fold"] for r in some])
        new = settle(has, old, excess)
        moved = [(some[i]["image_id"], int(new[i])) for i in np.flatnonzero(old != new)]
        moved = spark.createDataFrame(moved, f"image_id {dict(annots.dtypes)['image_id']}, settled int")  # at most `swing` rows
        found = found.join(F.broadcast(moved), "image_id", "left").withColumn("fold", F.coalesce("settled", "fold"))
    return found.select("image_id", "fold")


def split_images(annots: DataFrame, factor: int = 3, **options) -> DataFrame:
    """image_id and split: fold 0 is test; of the rest, folded anew, fold 0 is vali, all others train."""
    first = staged(stratified_folds(annots, factor, **options), "split")
    rest = annots.join(first.where("fold > 0").select("image_id"), "image_id", "left_semi")
    second = stratified_folds(rest, factor, seed=1, **options)
    test = first.where("fold = 0").select("image_id", F.lit("test").alias("split"))
    return test.unionAll(second.select("image_id", F.when(F.col("fold") == 0, "vali").otherwise("train")))
