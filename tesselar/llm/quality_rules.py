"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Counts of every text feed a fixed base rule and five ratios. For each stratum
(language), cutoffs of all ratios are chosen together on the labelled documents. Junk alone
sets the order in which they are tightened, from the loosest cutoff of each ratio on and those that
catch most junk first; a cutoff that catches no further junk is left out. The good documents are
independent of that order, so it is tested as a fixed sequence: a step is valid if an exact binomial
test bounds the share of good documents that all its cutoffs reject together by ALPHA, and the first
step that fails ends the sequence. DELTA is shared out over the strata (Bonferroni), so that with
probability 1 - DELTA no stratum loses more than ALPHA of its good documents to the cutoffs. Of the valid
steps the one with most junk caught less good documents lost is taken (the earlier
on ties); a stratum without a valid and useful step rejects nothing. With S strata that takes at least
log(S / DELTA) / -log(1 - ALPHA) good documents: 149 for one, 217 for four.

The labelled documents are a holdout as the grid of cutoffs is fixed beforehand
and their order does not look at good ones.
Statistics are over all labelled documents, however many there are.

Edge cases: null or empty text has no words and fails the base rule; a null language
is a stratum of its own; repeated rows are judged one by one (a repeated label counts
once, the lower quality holds); without labels every document that passes the base
rule is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE_SPACE, stage, table, words_of

ALPHA = 0.02
DELTA = 0.05
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SHARES = [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8]
GRIDS = {
    "symbols": SHARES,
    "dup_lines": SHARES,
    "repeats": SHARES,
    "shouts": SHARES,
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0, 40.0, 60.0, 80.0, 100.0],
}
#: Strata up to which the chosen cutoffs are broadcast; beyond, they are joined.
BROADCAST_STRATA = 10_000


def count_features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Key, stratum, hash and the counts of each row's whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.xxhash64(F.col(text)).alias("twin"), t.alias("t"))
    df = df.select(
        "doc_id",
        "stratum",
        "twin",
        words_of(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(WHITE_SPACE)) != "").alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )
    df = df.select(
        "doc_id",
        "stratum",
        "twin",
        "n_symbols",
        "n_shouts",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Each window's hash; the size is taken from the same column, so that it is computed once a row.
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("hashes") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
    )
    df = df.withColumn("windows", windows).drop("hashes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("by_hash", by_hash).drop("windows")
    same = lambda e, at: F.coalesce(F.get("by_hash", at)["h"] == e["h"], F.lit(False))
    starts = F.array_sort(
        F.array_compact(F.transform("by_hash", lambda e, i: F.when(same(e, i - F.lit(1)) | same(e, i + F.lit(1)), e["i"])))
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
    covered = F.aggregate(
        starts,
        none,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + F.lit(WINDOW) - a["end"])).alias("n"), (p + F.lit(WINDOW)).alias("end")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("by_hash").isNotNull(), covered), F.lit(0)).cast("long")).drop("by_hash")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbols": over("n_symbols", "word_chars"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "shouts": over("n_shouts", "word_chars"),
        "word_length": over("word_chars", "n_words"),
    }


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Bin(n, p), summed exactly in log space."""
    step = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + F.lit(1)) / i) + step
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    return F.exp(F.aggregate(F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>")), start, add, lambda a: a["total"]))


def choose_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum: a map from the ratio's name to its cutoff."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    grids = F.create_map(*[x for name, grid in GRIDS.items() for x in (F.lit(name), F.array(*map(F.lit, grid)))])
    # So many cutoffs of each ratio reject a document.
    overs = F.array(*[F.size(F.filter(F.array(*map(F.lit, GRIDS[name])), lambda c: v > c)) for name, v in ratios().items()])
    cells = (
        features.where(~base_failed())
        .join(labels, "doc_id")
        .groupBy("stratum", overs.alias("overs"))
        .agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    )
    cells = stage(cells, "quality-cells")
    # Each junk document counts for one ratio, of those that reject it the one that rejects most junk.
    junk = cells.where("bad > 0").withColumn("cell", F.monotonically_increasing_id())
    junk = stage(junk, "quality-junk").select("stratum", "cell", "bad", F.posexplode("overs").alias("at", "over")).where("over > 0")
    weight = junk.groupBy("stratum", "at").agg(F.sum("bad").alias("weight"))
    own = junk.join(weight, ["stratum", "at"]).groupBy("stratum", "cell", "bad").agg(F.max_by(F.struct("at", "over"), F.struct("weight", -F.col("at"))).alias("own"))
    gains = own.groupBy("stratum", "own.at", "own.over").agg(F.sum("bad").alias("gain"))
    tighter = W.partitionBy("stratum", "at").orderBy("over").rowsBetween(W.unboundedPreceding, W.currentRow)
    order = W.partitionBy("stratum").orderBy(F.desc("most"), "at", F.desc("over"))
    steps = stage(gains.withColumn("most", F.max("gain").over(tighter)).select("stratum", "at", "over", F.row_number().over(order).alias("step")), "quality-steps")
    listed = steps.groupBy("stratum").agg(F.collect_list(F.struct("at", "over", "step")).alias("steps"))
    n_strata = max(1, steps.select("stratum").distinct().count())
    if n_strata <= BROADCAST_STRATA:
        listed = F.broadcast(listed)
    # The first step that rejects a cell; null where none does.
    first = F.array_min(F.transform(F.filter("steps", lambda s: F.get("overs", s["at"]) >= s["over"]), lambda s: s["step"]))
    seen = cells.join(listed, "stratum").groupBy("stratum", first.alias("step")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    so_far = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias
    tests = steps.join(seen, ["stratum", "step"], "left").select("stratum", "step", "at", "over", total("good")("lost"), total("bad")("caught"))
    tests = tests.join(seen.groupBy("stratum").agg(F.sum("good").alias("n")), "stratum")
    passed = F.when(F.col("lost") <= F.col("n") * alpha, binomial_tail(F.col("lost"), F.col("n"), alpha) <= delta / n_strata).otherwise(False)
    valid = tests.withColumn("passed", passed).withColumn("valid", F.min("passed").over(so_far)).where("valid")
    best = valid.where("caught > lost").groupBy("stratum").agg(F.max_by("step", F.struct(F.col("caught") - F.col("lost"), -F.col("step"))).alias("last"))
    name = F.get(F.array(*map(F.lit, GRIDS)), F.col("at"))
    return (
        valid.join(best, "stratum")
        .where("step <= last")
        .groupBy("stratum", name.alias("ratio"))
        .agg(F.min("over").alias("over"))
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("ratio", F.get(grids[F.col("ratio")], F.col("over") - 1).alias("cutoff")))).alias("cutoffs"))
    )


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, keys: bool = False) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs; with keys also stratum and twin (xxhash64 of the text), which decide."""
    features = stage(count_features(docs), "quality-counts")
    cutoffs = stage(choose_cutoffs(features, labels, alpha, delta), "quality-cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    beyond = F.lit(False)
    for name, value in ratios().items():
        beyond = beyond | F.coalesce(value > F.col("cutoffs")[name], F.lit(False))
    return features.join(cutoffs, "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~beyond).alias("kept"),
        *(["stratum", "twin"] if keys else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
