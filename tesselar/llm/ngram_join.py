"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected groups.

A document's set holds its distinct shingles of SHINGLE words (A-Z lower-cased); fewer words make one
shingle. Two documents link at a Jaccard similarity of PERCENT or more.

Shingles have one global order, rare ones first: how often each is in the corpus is
counted over all documents in hash buckets (the order only
steers cost, never the result). If two sets are similar, then with a prefix of n - overlap + l
shingles of each they share at least l prefix shingles. Each document picks its l: it lengthens its
prefix while the estimated cost of candidates, divided by l, falls faster than
rows are added. A pair is a candidate if it shares the smaller l of the two and, as what one prefix does not share
is missing from the other set, as many shingles as the sizes ask for beyond the prefixes; the places of a
shared shingle bound the overlap too.

Groups need no expansion into pairs: equal sets are one class from the start. In a few turns, classes outside the
main group of a shingle are compared with leaders from that group, so that groups of near copies fall together; then all candidates
between different groups are listed, but for the pairs already compared. On a shingle with many groups, members of its
largest group are met by all others but not by each other. All candidates are verified on their whole sets.
Sets and classes are named by 64-bit hashes (wrong with odds of 2^-64 a pair).

Edge cases: null texts and texts without words have an empty set and link with nothing;
a null doc_id sorts before all others; repeated rows are rows of one class;
rows with one doc_id and different texts are judged apart; of equally many shared shingles the smaller class
is the leader; long texts are worked on one at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hinted, stage, table, unstage
from .hashing import mix, spans, word_hashes
from .packing import pieces_of

SHINGLE = 5
PERCENT = 80
#: Buckets of the frequency count, in blocks for the shuffle; its broadcast has this many bytes.
BUCKETS, BLOCK = 1 << 22, 1 << 12
#: Longest extension of a prefix, and the cost of a candidate in rows.
MAX_MATCHES, VERIFY_COST = 8, 10.0
#: Turns of comparing classes with leaders, and leaders of a shingle in all but the first; they only spare candidates, what they leave is met in full.
TURNS, LEADERS = 2, 4
#: Texts that a task works on at a time have about so many bytes.
PIECE_CHARS = 500_000
FIRST = -(2**63)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each row's set of shingles."""
    words, cuts = word_hashes(texts, folded=True)
    n = np.diff(cuts)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(words))
    end = np.minimum(start + size, cuts[row + 1])
    whole = (end - start == size) | ((n[row] < size) & (start == cuts[row]))
    hashes = spans(words, start[whole], end[whole])
    counts = np.cumsum(np.where(n < size, np.minimum(n, 1), n - size + 1))
    return [np.unique(x) for x in np.split(hashes, counts[:-1])] if len(n) else []


def class_of(shingles: np.ndarray) -> int:
    """Name of a set: a hash of its members, as a signed number."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def _profile(size: int, buckets: int):
    """A row for each text: doc, twin, n, class; at the end of each task its counts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint32)
        names = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("block", pa.int32()), ("counts", pa.binary()), ("width", pa.int32())])
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
            sets = shingle_sets(batch.column(1), size)
            if sets:
                np.add.at(counts, (np.concatenate(sets) & np.uint64(buckets - 1)).astype(np.int64), 1)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int32())],
                schema=names,
            )
        if counts.any():
            width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << (8 * w))
            blocks = counts.astype(f"<u{width}").reshape(-1, BLOCK)
            rows = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(rows, pa.int64()) for _ in range(4)), pa.array(np.arange(rows, dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array(np.full(rows, width, np.int32))],
                schema=names,
            )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each block, as levels of 8 to a doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts, width in zip(*(c.to_pylist() for c in batch.columns)):
            total[block] = total.get(block, 0) + np.frombuffer(counts, f"<u{width}").astype(np.int64)
    levels = [np.minimum(255, np.rint(8 * np.log2(1 + t))).astype(np.uint8).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "levels": pa.array(levels, pa.binary())})


def prefix_of(shingles: np.ndarray, level: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """Prefix shingles of a set in the global order, and its l.

    shingles are sorted by hash; level has their frequency levels.
    """
    n = len(shingles)
    order = np.argsort(level, kind="stable")
    need = -(-percent * n // 100)  # overlap with any partner that is not larger
    most = min(MAX_MATCHES, need)
    often = np.maximum(0.0, np.exp2(level[order[: n - need + most]] / 8.0) - 1 - noise)
    cost = [n - need + m + VERIFY_COST * often[: n - need + m].sum() / m for m in range(1, most + 1)]
    matches = int(np.argmin(cost)) + 1
    return shingles[order[: n - need + matches]], matches


def _prefixes(levels, noise: float, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, seen = np.frombuffer(levels.value, np.uint8), set()  # a class is listed once a task
        mask = np.uint64(len(table_) - 1)
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
            tokens, classes, infos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(batch.column(1), size):
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                prefix, matches = prefix_of(s, table_[(s & mask).astype(np.int64)], noise, percent)
                tokens.append(prefix)
                classes.append(np.full(len(prefix), name))
                infos.append(np.arange(len(prefix)) << 8 | len(s) << 36 | matches)
            yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).view(np.int64), "class": np.concatenate(classes), "info": np.concatenate(infos)})

    return run


def _similar(size: int, percent: int):
    """The pairs whose whole sets, made anew from the two texts, are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS // 2)):
            x, y = (batch.column(name).to_numpy() for name in ("x", "y"))
            texts = pa.chunked_array([batch.column("tx"), batch.column("ty")])
            names, at = np.unique(np.concatenate([x, y]), return_index=True)  # a leader is in many pairs
            sets = dict(zip(names.tolist(), shingle_sets(texts.take(pa.array(at)).combine_chunks(), size), strict=True))
            near = []
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                near.append(100 * shared >= percent * (len(sets[u]) + len(sets[v]) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    return run


def n_of(info: Column) -> Column:
    return F.shiftright(info, 36)


def at_of(info: Column) -> Column:
    return F.shiftright(info, 8).bitwiseAND(F.lit((1 << 28) - 1))


def matches_of(info: Column) -> Column:
    return info.bitwiseAND(F.lit(255))


def can_be_similar(ix: Column, iy: Column, percent: int) -> Column:
    """Whether the sizes, and the places of a shared shingle, leave room for enough shared shingles."""
    nx, ny, ax, ay = n_of(ix), n_of(iy), at_of(ix), at_of(iy)
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & ((F.least(ax, ay) + F.least(nx - ax, ny - ay)) * (100 + percent) >= percent * (nx + ny))


def needed(ix: Column, iy: Column, percent: int) -> Column:
    """How many prefix shingles a similar pair shares at least.

    One of the two prefixes ends first in the global order; what of it is not shared is missing from the other set.
    """
    nx, ny, lx, ly = n_of(ix), n_of(iy), matches_of(ix), matches_of(iy)
    ceil = lambda a, b: F.floor((a + F.lit(b - 1)) / F.lit(b))
    rest = F.greatest(ceil(nx * percent, 100) - lx, ceil(ny * percent, 100) - ly)
    return F.greatest(F.least(lx, ly), ceil((nx + ny) * percent, 100 + percent) - rest)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar; a short list of staged pairs travels to the texts."""
    pairs = hinted(pairs)
    wanted = texts.join(hinted(pairs.select(F.col("y").alias("class")).distinct()), "class", "left_semi")
    a, b = texts.select(F.col("class").alias("x"), F.col("text").alias("tx")), wanted.select(F.col("class").alias("y"), F.col("text").alias("ty"))
    return pairs.join(a, "x").join(b, "y").select("x", "tx", "y", "ty").mapInArrow(_similar(size, percent), "x long, y long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; large-star and small-star steps until nothing moves."""
    edges = stage(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct(), label)
    before = None
    while True:
        # A fingerprint of the edges, as two sums.
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), label)


def with_roots(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def star_pairs(rows: DataFrame, turn: int, leaders: int, percent: int) -> DataFrame:
    """Pairs (x, y) of a class outside the main group of its shingles (in the first turn, of any class) with leaders of these.

    rows: token, class, info, root and main. The first leader of a shingle is the class of its main group in which the fewest
    shingles are rarer, as a copy with few changes of its own is near to most others; the rest have
    the smallest hashes, of other hashes each turn. Each x gets the leaders that it shares most with, one less than a shingle has.
    """
    by_token = W.partitionBy("token")
    ranked = lambda i: F.struct((F.lit(0) if i else at_of(F.col("info"))).cast("long").alias("at"), F.xxhash64(F.lit(turn), F.lit(i), "class").alias("h"), "class", "info")
    among = F.lit(True) if turn == 0 else F.col("root") == F.col("main")
    lead = [F.min(F.when(among, ranked(i))).over(by_token) for i in range(leaders)]
    led = F.array_distinct(F.transform(F.array(*lead), lambda c: F.struct(c["class"].alias("class"), c["info"].alias("info"))))
    x = rows.repartition("token").withColumn("led", led).where(F.lit(turn == 0) | (F.col("root") != F.col("main"))).select("class", "info", F.explode("led").alias("lead"))
    x = x.where((F.col("class") != F.col("lead.class")) & can_be_similar(F.col("info"), F.col("lead.info"), percent))
    shared = x.groupBy(F.col("class").alias("x"), F.col("lead.class").alias("y")).agg(F.count("*").alias("shared"), F.max("info").alias("ix"), F.max("lead.info").alias("iy"))
    shared = shared.where(F.col("shared") >= needed(F.col("ix"), F.col("iy"), percent))
    best = W.partitionBy("x").orderBy(F.desc("shared"), "y")
    return shared.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= leaders - 1).select("x", "y")


def mixed_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the shingles that several groups share: token, class, info, its root, the token's main (largest) group and number of classes."""
    grouped = with_roots(rows, groups).repartition("token")
    counted = grouped.withColumn("same", F.count("*").over(W.partitionBy("token", "root")))
    by_token = W.partitionBy("token")
    mixed = counted.select("token", "class", "info", "root", F.max(F.struct("same", "root")).over(by_token)["root"].alias("main"), F.count("*").over(by_token).alias("classes"), (F.min("root").over(by_token) != F.max("root").over(by_token)).alias("several"))
    return stage(mixed.where("several").drop("several"), "ngram-mixed")


def candidates(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of classes of different groups that share enough prefix shingles.

    What two classes have to share is known from their sizes, so a pair is met on those of its shingles
    only that few classes have: with the shingles of each class in one order, the first shared one
    has as many behind it in both lists. What the pair shares in all is then counted once.
    """
    own = W.partitionBy("class")
    ranked = mixed.withColumns({"nth": F.row_number().over(own.orderBy("classes", "token")), "of": F.count("*").over(own)})
    ranked = ranked.select("token", "class", "root", "info", (F.col("of") - F.col("nth") + 1).alias("left"), (F.col("root") == F.col("main")).alias("in_main")).where(F.col("left") >= 1)
    side = lambda c: ranked.select("token", F.col("class").alias(c), F.col("root").alias(f"r{c}"), F.col("info").alias(f"i{c}"), F.col("left").alias(f"l{c}"), F.col("in_main").alias(f"m{c}"))
    ix, iy = F.col("ix"), F.col("iy")
    met = side("x").where("not mx").join(side("y"), "token").where(
        (F.col("rx") != F.col("ry")) & (F.col("my") | (F.col("x") < F.col("y"))) & can_be_similar(ix, iy, percent) & (F.least("lx", "ly") >= needed(ix, iy, percent))
    )
    # Which of the two is in the main group differs from shingle to shingle: one order for both.
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    lists = mixed.groupBy("class").agg(F.collect_list("token").alias("tokens"), F.max("info").alias("info"))
    a = lists.select(F.col("class").alias("x"), F.col("tokens").alias("tx"), F.col("info").alias("ix"))
    b = lists.select(F.col("class").alias("y"), F.col("tokens").alias("ty"), F.col("info").alias("iy"))
    shared = F.size(F.array_intersect("tx", "ty"))
    return pairs.join(a, "x").join(b, "y").where(shared >= needed(ix, iy, percent)).select("x", "y")


def texts_of(rows: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """class and text, once for each class of rows."""
    homes = known.join(rows.select("class").distinct(), "class", "left_semi").groupBy("class", "doc", "twin").count()
    homes = homes.groupBy("class").agg(F.min(F.struct("doc", "twin", "count")).alias("home")).select("class", "home.*")
    homes = stage(homes, "ngram-homes")
    found = texts.withColumn("twin", F.xxhash64("text")).join(hinted(homes), ["doc", "twin"]).select("class", "text")
    if not homes.where("count > 1").isEmpty():
        found = found.dropDuplicates(["class"])
    return stage(found, "ngram-texts")


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, twin (xxhash64 of the text), n_shingles, component_id and group (null without words) for each row of docs.

    buckets (a power of two) are those of the frequency count: more of them tell rare shingles apart in larger corpora.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.col("text").cast("string").alias("text"))
    profiled = stage(texts.withColumn("twin", F.xxhash64("text")).mapInArrow(_profile(size, buckets), "doc long, twin long, n long, class long, block int, counts binary, width int"), "ngram-profile")
    known = profiled.where("block is null").select("doc", "twin", "n", "class")
    levels = bytearray(buckets)
    summed = profiled.where("block is not null").select("block", "counts", "width").repartition("block").mapInArrow(_add_counts, "block int, levels binary")
    for block, level in summed.collect():  # `buckets` bytes, whatever the input
        levels[block * BLOCK : (block + 1) * BLOCK] = level
    mean = (known.agg(F.sum("n")).first()[0] or 0) / buckets
    shared = spark.sparkContext.broadcast(bytes(levels))
    listed = texts.mapInArrow(_prefixes(shared, mean + 3 * mean**0.5, size, percent), "token long, class long, info long")
    # One shuffle by shingle serves the distinct classes and the count; shingles of one class only can't make a pair.
    once = listed.repartition("token").groupBy("token", "class").agg(F.min("info").alias("info"))
    rows = once.withColumn("classes", F.count("*").over(W.partitionBy("token"))).where("classes > 1").drop("classes")
    rows = stage(rows, "ngram-rows")
    kept = texts_of(rows, known, texts)
    groups = spark.createDataFrame([], "node long, root long")
    tested = spark.createDataFrame([], "x long, y long")
    for turn in range(TURNS + 1):
        mixed = mixed_rows(rows, groups)
        unstage(rows)
        rows = mixed.select("token", "class", "info")  # a shingle of one group stays one
        if turn == TURNS:
            break
        pairs = star_pairs(mixed, turn, LEADERS if turn else 2, percent).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        pairs = stage(pairs.join(tested, ["x", "y"], "left_anti"), "ngram-stars")
        tested = tested.unionAll(pairs)
        near = stage(verified(pairs, kept, percent, size), "ngram-near")
        if near.isEmpty():
            break
        groups = components(groups.toDF("x", "y").unionAll(near), "ngram-groups")
    more = stage(candidates(mixed, percent).join(tested, ["x", "y"], "left_anti"), "ngram-candidates")
    found = stage(verified(more, kept, percent, size), "ngram-found")
    unstage(mixed)
    unstage(kept)
    roots = groups if found.isEmpty() else components(groups.toDF("x", "y").unionAll(found), "ngram-components")
    firsts = known.where("n > 0").groupBy("class").agg(F.min("doc").alias("doc")).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = firsts.select("class", "root", "doc")
    least = firsts.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = firsts.join(least, "root").select("class", "component_id", F.col("root").alias("group"))
    out = known.join(named, "class", "left")
    plain = lambda c: F.nullif(c, F.lit(FIRST))
    return out.select(plain(F.col("doc")).alias("doc_id"), "twin", F.col("n").alias("n_shingles"), plain(F.coalesce("component_id", "doc")).alias("component_id"), "group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("twin", "group")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) AS k FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + {SHINGLE - 1}], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
