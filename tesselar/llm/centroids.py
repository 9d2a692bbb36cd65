"""Centroid clustering with Drake's adaptive bounds, in exact integers.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds for its several
nearest other centroids, and one lower bound for all the rest. After a round the bounds move
by what the centroids moved. A vector whose upper bound is below all lower ones stays where it is, without a look at its
components; else its own distance is taken exactly, then those of the near centroids, and if even
the remainder bound can't be told from the best one, all are scanned. The number of near bounds shrinks to what the last round
used. A bound certifies only what is strictly nearer, so ties always get exact distances and go to the smaller number.

A round is one pass over the staged vectors and bounds, without a shuffle: tasks write the new bounds beside the
vectors, and what joined or left each cluster as a few rows of sums. The driver sees only those sums, added up by Spark: as many numbers
as the centroids have. The table of the round before is deleted.

Edge cases: a vector that is null, of another length, or with a null or non-finite component takes no part and
gets no row; an empty table gives no rows; fewer vectors than centroids give one centroid each; repeated rows are vectors of their own; equal start vectors give
equal centroids, of which the later ones stay empty and unmoved; a null key is kept and starts no centroid while others can; extra columns
are ignored. Components so large that a squared distance overflows 63 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .vectors import lists, matrix, usable, whole

CENTROIDS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3
#: Lower bounds that a vector keeps one by one: so many at first, and never fewer than the second.
NEAR, LEAST_NEAR = 3, 2
#: Bounds give way by this share, more than rounding can add to them.
MARGIN = 1e-6
STATE = "key long, v array<long>, cluster int, upper float, near array<int>, low array<float>, rest float, part int, moved array<long>"
ARROW = pa.schema([("key", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float32()), ("near", pa.list_(pa.int32())), ("low", pa.list_(pa.float32())), ("rest", pa.float32()), ("part", pa.int32()), ("moved", pa.list_(pa.int64()))])


class Clustering(NamedTuple):
    """rows: key, cluster, distance (squared); centroids: of each number; work: per round the vectors certified by bounds, settled by near centroids, and scanned in full."""

    rows: DataFrame
    centroids: list[tuple[int, ...]]
    work: list[tuple[int, int, int]]


def raised(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * MARGIN


def lowered(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * MARGIN


def check_size(*values: np.ndarray) -> int:
    """Bits that squared distances between these can take."""
    top = max((int(np.abs(v).max()) for v in values if v.size), default=0)
    if (bits := (4 * values[0].shape[1] * top * top).bit_length()) > 63:
        raise ValueError(f"components up to {top} give squared distances of more than 63 bits")
    return bits


def to_all(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centroids."""
    kind = np.float64 if check_size(x, centres) < 53 else np.int64
    a, b = x.astype(kind), centres.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def to_some(x: np.ndarray, centres: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the centroids that it names."""
    check_size(x, centres)
    gaps = x[:, None, :] - centres[which]
    return np.einsum("nbd,nbd->nb", gaps, gaps)


class Bounds:
    """Clusters and bounds of some vectors; `assign` makes them right for given centroids."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.low, self.rest = cluster, upper, near, low, rest

    @classmethod
    def none(cls, n: int, near: int) -> Bounds:
        """Of vectors that have no cluster yet."""
        return cls(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, near), np.int32), np.full((n, near), -np.inf), np.full(n, -np.inf))

    def drop_to(self, near: int) -> None:
        """Keep fewer near bounds; the others join the remainder."""
        if self.low.shape[1] > near:
            self.rest = np.minimum(self.rest, self.low[:, near:].min(1))
            self.near, self.low = self.near[:, :near], self.low[:, :near]

    def drift(self, by: np.ndarray) -> None:
        """Allow for centroids that moved by so much."""
        own = np.concatenate([self.cluster[:, None], self.near], axis=1)
        most, left = np.zeros(len(own)), np.ones(len(own), bool)
        for c in np.argsort(-by):  # the farthest move of those that only the remainder stands for
            if not left.any():
                break
            outside = left & (own != c).all(1)
            most[outside] = by[c]
            left &= ~outside
        self.upper = self.upper + by[self.cluster]
        self.low = self.low - by[self.near]
        self.rest = self.rest - most

    def doubtful(self, rows: np.ndarray) -> np.ndarray:
        """Those of the rows whose own centroid is not certainly the nearest one."""
        least = np.minimum(self.low[rows].min(1, initial=np.inf), self.rest[rows])
        return rows[~(self.upper[rows] < least)]

    def assign(self, x: np.ndarray, centres: np.ndarray) -> tuple[int, int, int]:
        """Make every row's cluster the nearest centroid. Returns the rows that near centroids settled, those scanned in full, and the most near bounds that were needed."""
        near = self.near.shape[1]
        rows = self.doubtful(np.arange(len(x)))
        known = rows[self.cluster[rows] >= 0]
        if len(known):  # the own distance first: it may be all that is needed
            self.upper[known] = raised(np.sqrt(to_some(x[known], centres, self.cluster[known, None])[:, 0]))
            rows = np.concatenate([rows[self.cluster[rows] < 0], self.doubtful(known)])
        known = rows[(self.cluster[rows] >= 0) & (self.upper[rows] < self.rest[rows])]
        settled = deepest = 0
        if len(known):
            within = ~(self.low[known] > self.upper[known, None])
            deepest = int((within * np.arange(1, near + 1)).max(initial=0))
            some = np.sort(np.concatenate([self.cluster[known, None], self.near[known]], axis=1), axis=1)
            self.rank(known, some, to_some(x[known], centres, some))
            settled = len(known)
        full = rows[(self.cluster[rows] < 0) | ~(self.upper[rows] < self.rest[rows])]
        if len(full):
            found = to_all(x[full], centres)
            self.rank(full, np.broadcast_to(np.arange(len(centres), dtype=np.int32), found.shape), found, True)
            deepest = near
        return settled, len(full), deepest

    def rank(self, rows: np.ndarray, numbers: np.ndarray, squares: np.ndarray, full: bool = False) -> None:
        """Set clusters and bounds from exact distances to centroids, whose numbers ascend in each row."""
        order = np.argsort(squares, axis=1, kind="stable")
        number, length = np.take_along_axis(numbers, order, 1), np.sqrt(np.take_along_axis(squares, order, 1))
        near = self.near.shape[1]
        self.cluster[rows], self.upper[rows] = number[:, 0], raised(length[:, 0])
        self.near[rows], self.low[rows] = number[:, 1 : near + 1], lowered(length[:, 1 : near + 1])
        if full:
            self.rest[rows] = lowered(length[:, near + 1]) if length.shape[1] > near + 1 else np.inf


def read_bounds(batch: pa.RecordBatch, near: int) -> Bounds:
    if "cluster" not in batch.schema.names:
        return Bounds.none(len(batch), near)
    width = len(batch["near"].flatten()) // max(1, len(batch))
    number = lambda c: batch[c].to_numpy(zero_copy_only=False)
    wide = lambda c: batch[c].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
    found = Bounds(number("cluster").copy(), number("upper").astype(float), wide("near").copy(), wide("low").astype(float), number("rest").astype(float))
    found.drop_to(near)
    return found


def one_round(rows: DataFrame, centres: np.ndarray, drift: np.ndarray, near: int) -> DataFrame:
    """The rows with clusters and bounds for these centroids, and rows of sums (part: the cluster, -1 for counts of the work)."""
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((k, d + 1), object)
        work = [0, 0, 0, 0]
        for batch in batches:
            if not len(batch):
                continue
            x, bounds = matrix(batch["v"], d), read_bounds(batch, near)
            before = bounds.cluster.copy()
            bounds.drift(drift)
            settled, full, deepest = bounds.assign(x, centres)
            work = [work[0] + len(x) - settled - full, work[1] + settled, work[2] + full, max(work[3], deepest)]
            changed = np.flatnonzero(before != bounds.cluster)
            for sign, numbers in ((1, bounds.cluster[changed]), (-1, before[changed])):
                for c in np.unique(numbers[numbers >= 0]):
                    these = x[changed[numbers == c]]
                    moved[c, 0] += sign * len(these)
                    moved[c, 1:] += sign * these.sum(0).astype(object)
            nothing = lambda kind: pa.nulls(len(x), kind)
            columns = [batch["key"], batch["v"], pa.array(bounds.cluster, pa.int32()), raised(bounds.upper), lists(bounds.near, pa.int32()), lists(lowered(bounds.low).astype(np.float32), pa.float32()), lowered(bounds.rest), nothing(pa.int32()), nothing(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.float32), pa.float32()) for c in columns], schema=ARROW)
        parts = [(c, moved[c].tolist()) for c in range(k) if any(moved[c])] + [(-1, work)]
        yield pa.RecordBatch.from_pylist([{"part": c, "moved": numbers} for c, numbers in parts], schema=ARROW)

    return rows.mapInArrow(run, STATE)


def last_round(rows: DataFrame, centres: np.ndarray, drift: np.ndarray, near: int) -> DataFrame:
    """key, cluster and distance of each row."""
    d = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, bounds = matrix(batch["v"], d), read_bounds(batch, near)
            bounds.drift(drift)
            bounds.assign(x, centres)
            distance = to_some(x, centres, bounds.cluster[:, None])[:, 0]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(bounds.cluster, pa.int32()), pa.array(distance)], ["key", "cluster", "distance"])

    return rows.mapInArrow(run, "key long, cluster int, distance long")


def vectors_of(state: DataFrame) -> DataFrame:
    """Without the rows of sums."""
    return state.where("part is null").drop("part", "moved") if "part" in state.columns else state


def sums_of(state: DataFrame) -> tuple[dict[int, list[int]], list[int]]:
    """Of a written round: what each cluster's count and sums grew by, and the counts of the work."""
    parts = state.where("part is not null").select("part", F.posexplode("moved"))
    rows = parts.groupBy("part", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"), F.max("col").alias("most")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["part"], {})[r["pos"]] = int(r["most"] if (r["part"], r["pos"]) == (-1, 3) else r["total"])
    listed = {c: [v for _, v in sorted(x.items())] for c, x in found.items()}
    return listed, listed.pop(-1, [0, 0, 0, 0])


def cluster_vectors(rows: DataFrame, key: str, vector: str, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED) -> Clustering:
    """Lloyd's rounds over floor(scale * x) from the k vectors with the smallest sha256 of "seed:key"; means are rounded down."""
    vectors = rows.where((F.size(vector) == dimensions) & usable(F.col(vector))).select(F.col(key).cast("long").alias("key"), whole(F.col(vector), scale).alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    starts = vectors.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return Clustering(vectors.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [])
    centres = [list(r["v"]) for r in starts]
    totals = [[0] * (dimensions + 1) for _ in centres]
    drift, near, work, state = [0.0] * len(centres), max(0, min(NEAR, len(centres) - 1)), [], vectors
    as_array = lambda: (np.array(centres, np.int64), raised(np.array(drift)), near)
    for n in range(rounds):
        after = stage(one_round(vectors_of(state), *as_array()), f"centroids-{n}")
        if n:
            unstage(state)
        state = after
        grown, done = sums_of(state)
        work.append(tuple(done[:3]))
        near = min(near, max(done[3], LEAST_NEAR))
        for c, numbers in grown.items():
            totals[c] = [a + b for a, b in zip(totals[c], numbers)]
        moved = [[s // t[0] for s in t[1:]] if t[0] else c for c, t in zip(centres, totals)]
        drift = [float(sum((a - b) ** 2 for a, b in zip(x, y))) ** 0.5 for x, y in zip(centres, moved)]
        centres = moved
    last = stage(last_round(vectors_of(state), *as_array()), "centroids-last")
    if rounds:
        unstage(state)
    return Clustering(last, [tuple(c) for c in centres], work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with its cluster's inertia and centroid and the inertia of all."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    total = sum(int(r["s"]) for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()
    about = spark.createDataFrame([(r["cluster"], int(r["s"]), total, digest(r["cluster"])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.withColumnRenamed("key", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    gap = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    floor = "((s - ((s % n) + n) % n) // n)"
    parts = [f"""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM x ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance FROM (SELECT x.*, cluster, {gap}::BIGINT AS d FROM x, c{r}) GROUP BY vec_id)")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT cluster, list({floor}::BIGINT ORDER BY i) AS c FROM (
  SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


SQL = _sql()
