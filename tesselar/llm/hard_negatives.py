"""Hard-negative mining by bit-sliced integer products.

Components are floor(256 * x), so scores are exact integers. Read as two's complement, a vector is a stack of bit planes, each
a few 64-bit words. With the planes down to bit t known, the unknown rest of each component is between 0 and 2^t - 1, which bounds a score
from both sides. The leading planes of a block of rows are multiplied with a block of anchors at once; pairs whose interval
can't qualify are dropped; the others get the next plane by AND and population count over the words, and so on to
exact scores. First each anchor's positives are found (a pair qualifies if it can still beat the fifth best), then, with the
positives' scores known, its negatives (a pair qualifies if its interval still meets some positive's band, above that band's third best).

Anchors are a stated query set: they go to the tasks in blocks of ANCHORS, each block one pass over the staged rows, so that neither
driver nor tasks hold more than a block of them. A task keeps only its best few per anchor and sends those; Spark ranks what the tasks
found. No pair is shuffled, and a frequent label or vector makes no task larger.

Edge cases: a row with a null label, vector or id, or a null or non-finite component, takes no part; shorter vectors count as filled up with
zeros; of rows that share an id the one with the smallest label, then vector, takes part; equal scores go by the smaller id; an anchor without
another row of its label, and a positive without a row in its band, give no rows; an empty table gives no rows; extra
columns are ignored. Components so large that a score overflows 53 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .vectors import matrix, usable, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is within these percentages of the positive's.
FLOOR, CEILING, PER = 50, 95, 100
#: Anchors of a pass over all rows; rows that a task multiplies at once.
ANCHORS, ROWS = 8192, 1024
#: Planes that are left for the second step; the first one multiplies all others together.
LATE = 3


class Anchors(NamedTuple):
    """A block of the query set as arrays: one entry an anchor."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    #: Scores of the positives, best first; nan where there are fewer.
    positives: np.ndarray


class Planes(NamedTuple):
    """Bit planes of some vectors, least significant first, as words: planes x rows x words. The last one is the sign."""

    words: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Planes:
        top = int(np.maximum(values, ~values).max(initial=0)).bit_length()
        width = -(-values.shape[1] // 64) * 64
        planes = []
        for t in range(top + 1):
            bits = np.zeros((len(values), width), np.uint8)
            bits[:, : values.shape[1]] = (values >> t) & 1
            planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        return cls(np.stack(planes))

    def weight(self, t: int) -> int:
        return -(1 << t) if t == len(self.words) - 1 else 1 << t


def plane_product(left: Planes, a: np.ndarray, right: Planes, b: np.ndarray, t: int) -> np.ndarray:
    """What plane t of right[b] adds to the products of left[a] and right[b]."""
    plane, total = right.words[t][b], np.zeros(len(a), np.int64)
    for s in range(len(left.words)):
        total += left.weight(s) * np.bitwise_count(left.words[s][a] & plane).sum(1, dtype=np.int64)
    return right.weight(t) * total


def product_type(a: np.ndarray, b: np.ndarray) -> type:
    """The smallest float in which products of these are exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most >= 1 << 53:
        raise ValueError(f"scores up to {most} are beyond 53 bits")
    return np.float32 if most < 1 << 24 else np.float64


class Block:
    """Anchors with their planes and what bounds a score: the sums of their negative and of their positive components."""

    def __init__(self, anchors: Anchors):
        self.anchors, self.planes = anchors, Planes.of(anchors.values)
        self.below, self.above = np.minimum(anchors.values, 0).sum(1), np.maximum(anchors.values, 0).sum(1)

    def survivors(self, values: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, narrow=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, rows and exact scores of the allowed pairs whose score may lie in [least, most] of the anchor.

        allowed: anchors x rows. `narrow(anchors, low, high)` may say which pairs still qualify, given their intervals.
        """
        kind, planes = product_type(self.anchors.values, values), Planes.of(values)
        late = min(LATE, len(planes.words) - 1)
        known = self.anchors.values.astype(kind) @ ((values >> late) << late).T.astype(kind)
        slack = (1 << late) - 1
        may = (known >= np.nextafter((least - slack * self.above).astype(kind), kind(-np.inf))[:, None]) & (known <= np.nextafter((most - slack * self.below).astype(kind), kind(np.inf))[:, None]) & allowed
        a, b = np.nonzero(may)
        score = known[a, b].astype(np.int64)
        for t in range(late - 1, -2, -1):
            slack = (1 << (t + 1)) - 1
            low, high = score + slack * self.below[a], score + slack * self.above[a]
            keep = (high >= least[a]) & (low <= most[a])
            if narrow is not None:
                keep &= narrow(a, low, high)
            a, b, score = a[keep], b[keep], score[keep]
            if t < 0 or not len(a):
                break
            score = score + plane_product(self.planes, a, planes, b, t)
        return a, b, score


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each group: by score, then the smaller id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    first = np.searchsorted(ordered, ordered, "left")
    return order[np.arange(len(order)) - first < n]


class Best:
    """The n best of each group so far, and the score that a new one must reach."""

    def __init__(self, groups: int, n: int):
        self.n, self.group, self.score, self.ids = n, *(np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.zeros(len(self.least), bool)
        touched[group] = True
        old = touched[self.group]
        group, score, ids = (np.concatenate([x[old], y]) for x, y in ((self.group, group), (self.score, score), (self.ids, ids)))
        kept = best_of(group, score, ids, self.n)
        group, score, ids = group[kept], score[kept], ids[kept]
        filled = np.flatnonzero(np.bincount(group, minlength=len(self.least)) == self.n)
        self.least[filled] = score[np.searchsorted(group, filled, "right") - 1]
        self.group, self.score, self.ids = (np.concatenate([x[~old], y]) for x, y in ((self.group, group), (self.score, score), (self.ids, ids)))


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and components of up to ROWS rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            yield part["id"].to_numpy(), part["label"].to_numpy(), matrix(part["v"], width)


def find_positives(rows: DataFrame, shared, width: int, n: int) -> DataFrame:
    """anchor, id and score of the n best rows of the anchor's label that each task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        best, parts = Best(len(anchors.ids), n), {}
        for label in np.unique(anchors.labels):  # only pairs of a label are multiplied
            mine = np.flatnonzero(anchors.labels == label)
            parts[int(label)] = mine, Block(Anchors(*(x[mine] for x in anchors)))
        for ids, labels, values in blocks_of(batches, width):
            found = [[np.zeros(0, np.int64)] * 3]
            for label in np.unique(labels):
                if int(label) in parts:
                    mine, block = parts[int(label)]
                    theirs = np.flatnonzero(labels == label)
                    other = block.anchors.ids[:, None] != ids[theirs]
                    a, b, score = block.survivors(values[theirs], other, best.least[mine], np.full(len(mine), np.inf))
                    found.append([mine[a], score, ids[theirs[b]]])
            best.add(*(np.concatenate(x) for x in zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.group]), pa.array(best.ids), pa.array(best.score)], ["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor long, id long, score long")


def find_negatives(rows: DataFrame, shared, width: int, n: int) -> DataFrame:
    """anchor, nth (of the positive, from 0), id and score of the n best rows of other labels in each band that each task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        block, bands = Block(anchors), anchors.positives.shape[1]
        with np.errstate(invalid="ignore"):
            low_end, high_end = np.ceil(FLOOR * anchors.positives / PER), np.floor(CEILING * anchors.positives / PER)
        low_end, high_end = np.where(np.isnan(low_end), np.inf, low_end), np.where(np.isnan(high_end), -np.inf, high_end)
        best = Best(len(anchors.ids) * bands, n)
        for ids, labels, values in blocks_of(batches, width):
            floor = np.maximum(low_end, best.least.reshape(-1, bands))  # of each band: its end, or its n-th best
            open_band = floor <= high_end
            least, most = np.where(open_band, floor, np.inf).min(1, initial=np.inf), np.where(open_band, high_end, -np.inf).max(1, initial=-np.inf)

            def narrow(a, low, high, floor=floor):
                return ((high[:, None] >= floor[a]) & (low[:, None] <= high_end[a])).any(1)

            a, b, score = block.survivors(values, anchors.labels[:, None] != labels, least, most, narrow)
            pair, band = np.nonzero((score[:, None] >= floor[a]) & (score[:, None] <= high_end[a]))
            best.add(a[pair] * bands + band, score[pair], ids[b[pair]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.group // bands]), pa.array((best.group % bands).astype(np.int32)), pa.array(best.ids), pa.array(best.score)], ["anchor", "nth", "id", "score"])

    return rows.mapInArrow(run, "anchor long, nth int, id long, score long")


def ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n best of each group, with their rank from 1; a group has n rows a task at most."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def one_of_each(rows: DataFrame) -> DataFrame:
    """Rows with ids of their own: those whose id is shared are told apart in a shuffle of their own."""
    shared = rows.groupBy("id").count().where("count > 1").select("id")
    if not shared.limit(1).count():
        return rows
    shared = stage(shared, "shared-ids")
    some = rows.join(shared, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    return rows.join(shared, "id", "left_anti").unionByName(some)


def mine(rows: DataFrame, is_anchor: Column, key: str = "id", label: str = "label", vector: str = "v", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for each anchor and positive up to `negatives` rows.

    is_anchor is a condition on the columns id and label; key, label and vector name columns of rows, vector holding whole numbers.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    rows = stage(one_of_each(rows), "vectors")
    width = max(1, rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0)
    spark = rows.sparkSession
    queries = rows.where(is_anchor)
    parts = max(1, -(-queries.count() // ANCHORS))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    found, last = [], None
    for part in range(parts):
        block = queries.where(F.col("part") == part).drop("part").toArrow().combine_chunks()
        if not len(block):
            continue
        batch = block.to_batches(max_chunksize=len(block))[0]
        anchors = Anchors(batch["id"].to_numpy(), batch["label"].to_numpy(), matrix(batch["v"], width), np.zeros((len(batch), 0)))
        shared = spark.sparkContext.broadcast(anchors)
        near = stage(ranked(find_positives(rows, shared, width, positives), ["anchor"], positives), "positives")
        place = {a: i for i, a in enumerate(anchors.ids.tolist())}
        scores = np.full((len(batch), positives), np.nan)
        for r in near.select("anchor", "rank", "score").collect():  # a few numbers for each anchor of the block
            scores[place[r["anchor"]], r["rank"] - 1] = r["score"]
        shared.destroy()
        shared = spark.sparkContext.broadcast(anchors._replace(positives=scores))
        hard = ranked(find_negatives(rows, shared, width, negatives), ["anchor", "nth"], negatives)
        hard = hard.select("anchor", F.col("nth") + 1, F.col("rank").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).toDF("anchor", "rank", "place", "negative_id", "negative_score")
        last = stage(hard.join(near, ["anchor", "rank"]).select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("place").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"), "hard-negatives")
        shared.destroy()
        unstage(near)
        found.append(last)
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    unstage(rows)
    paths = [f for x in found for f in {p.rsplit("/", 1)[0] for p in x.inputFiles()}]
    return spark.read.schema(last.schema).parquet(*paths) if paths else last


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole(F.col("embedding"), SCALE).alias("v"))
    return mine(rows, F.col("id") % 50 == 0, key="vec_id")


SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM x a, x b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same),
m AS (SELECT p.a, p.b AS positive, s.b AS negative, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS n
  FROM p JOIN s ON p.a = s.a WHERE p.n <= {POSITIVES} AND NOT s.same AND {FLOOR} * p.score <= {PER} * s.score AND {PER} * s.score <= {CEILING} * p.score)
SELECT a AS anchor_id, positive AS positive_id, n::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM m WHERE n <= {NEGATIVES}
"""
