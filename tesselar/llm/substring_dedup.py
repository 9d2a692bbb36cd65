"""Substring dedup: words of passages that occur earlier in the corpus are removed.

A passage counts from `length` words (20). Each window of that many words is named
by its anchor: the run of ANCHOR words in it with the smallest hash, so equal windows share it.
Anchors that occur once can't lie in a repeated window and go first. The windows
around one occurrence of an anchor form its context. Equal contexts are grouped: all but the first are
removed whole. The first ones of an anchor with several contexts are dealt to shards
by anchor. Each shard has a compressed FM-index over its contexts (Burrows-Wheeler transform in
a wavelet matrix of packed bits, a bit a suffix for the bounds of parent intervals, no suffix array);
contexts are streamed through it by backward search, which
gives their matching statistics, cut at the threshold: one step to the left for each
window, between steps the interval widens to all suffixes with the same length - 1 words. A window is
reported if an earlier one came to the same interval.
An anchor with more than HOT contexts would fill a shard alone; its windows are
compared by their hashes in a grouped aggregation instead, which is exact too.

Words are runs of characters other than ASCII white space. "Earlier" is a smaller doc_id, or
the same document and a smaller start; windows are judged on the input, not on what is left.
Removal works on words: kept words are joined by one blank.

Edge cases: null and empty texts have no words; texts shorter than the threshold stay
whole; a null doc_id sorts first; rows that repeat a doc_id and its text count
as one document and get the same result, rows with the same doc_id and other texts are
documents ordered by a hash of the text; an empty table gives no rows; of the input's
columns remove_repeats returns doc_id alone, whatever other names there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .hashing import runs, spans, word_hashes
from .packing import pieces_of

LENGTH = 20
ANCHOR = 8
#: Contexts of one anchor beyond which its windows are compared by hash, and contexts in a shard.
HOT = 10_000
SHARD = 20_000
#: A key with more than one in HEAVY of a join's rows is dealt to several tasks.
HEAVY = 1_000
#: Texts that a task works on at a time have about so many bytes.
PIECE_CHARS = 2_000_000
FIRST = -(2**63)


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of `width` elements."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def find_anchors(words: np.ndarray, cuts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(hash, row, first word, end) of the context of each anchor occurrence."""
    n, none = len(words), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    width = length - ANCHOR + 1
    grams = runs(words, ANCHOR)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    least = sliding(np.minimum, grams, width)
    least[row[: n - length + 1] != row[length - 1 :]] = 0  # no window of one row
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == sliding(np.maximum, np.concatenate([pad, least, pad]), width))
    first, last = at + 1, at - width
    for back in range(width):  # the windows that the anchor stands for follow each other
        start = at - back
        own = (start >= 0) & (start < len(least))
        own[own] = least[start[own]] == grams[at[own]]
        first = np.where(own, np.minimum(first, start), first)
        last = np.where(own, np.maximum(last, start), last)
    own = last >= first
    return grams[at[own]], row[at[own]], first[own], last[own] + length


class Bits:
    """A packed row of bits, with a count of ones in front of each 64."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones in front of a position."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Position of a one, counted from 0: its block by bisection, its place there by halving."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        left, word, at = nth - self.before[block], self.words[block], block << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1))
            above = left >= low
            left = np.where(above, left - low, left)
            word = np.where(above, word >> np.uint64(half), word)
            at = at + half * above
        return at


class FmIndex:
    """FM-index of a text of word numbers; 0 separates passages.

    It holds bits only: the Burrows-Wheeler transform as a wavelet matrix, and one bit a suffix that tells
    whether it shares length - 1 words with its neighbour. The suffix array lives while it is built.
    """

    def __init__(self, text: np.ndarray, length: int):
        n = len(text)
        gaps = text == 0
        order = text + int(gaps.sum())
        order[gaps] = np.arange(gaps.sum())  # each separator is a symbol of its own when suffixes are sorted
        depth, power = 1, 1 << ((length - 1).bit_length() - 1)
        while True:
            if depth == power:
                at_power = order
            sa = np.argsort(order, kind="stable")
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = order[depth:] + 1
            key = order * (n + 2 + int(order.max())) + ahead
            sa = np.argsort(key, kind="stable")
            order = np.zeros(n, np.int64)
            order[sa] = np.cumsum(np.diff(key[sa], prepend=key[sa[:1]]) != 0)
            depth *= 2
            if depth > power and order[sa[-1]] == n - 1:
                break
        if depth == power:
            at_power = order
        # Suffixes that share length - 1 words are neighbours: bits at their bounds stand for the parent interval.
        step = length - 1 - power
        tail = np.full(n, -1, np.int64)
        tail[: max(0, n - step)] = at_power[step:]
        new = np.ones(n + 1, bool)
        new[1:-1] = (at_power[sa[1:]] != at_power[sa[:-1]]) | (tail[sa[1:]] != tail[sa[:-1]])
        self.n, self.bounds = n, Bits(new)
        left = text[sa - 1]
        letters = int(text.max()) + 1
        self.levels = []
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        for bit in range(max(1, (letters - 1).bit_length()) - 1, -1, -1):
            ones = (left >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), n - int(ones.sum())))
            left = np.concatenate([left[~ones], left[ones]])
        every = np.arange(letters)
        self.base = smaller[:-1] - self.down(np.zeros(letters, np.int64), every)

    def down(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Place of position `at` in the lowest level of the wavelet matrix, on the letter's way."""
        for bit, row, zeros in self.levels:
            ones = row.rank(at)
            at = np.where(letter >> bit & 1, zeros + ones, at - ones).astype(np.int64)
        return at

    def extend(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of letter + match from those of the matches."""
        base = self.base[letter]
        return base + self.down(lo, letter), base + self.down(hi, letter)

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = self.bounds.rank(lo + 1) - 1
        return self.bounds.select(group), self.bounds.select(group + 1)


def earlier_windows(passages: list[np.ndarray], places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(passage, offset) of each window of the passages that also occurs at an earlier place.

    places: a row (document, twin, first word) for each passage. All passages are streamed, so the places
    that were seen in an interval are those of its suffixes, and the index need not keep them.
    """
    sizes = np.array([len(p) for p in passages])
    flat = np.concatenate(passages)
    number = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(len(flat) + len(passages), np.int64)
    of = np.repeat(np.arange(len(passages)), sizes)
    text[starts[of] + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = number
    index = FmIndex(text, length)
    live = np.arange(len(passages))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    for back in range(1, length + 1):
        lo, hi = index.extend(lo, hi, text[starts + sizes - back])
    steps, offset = [], sizes - length
    while len(live):
        shared = hi - lo > 1
        steps.append((live[shared], offset[shared], lo[shared]))
        more = offset > 0
        live, lo, offset = live[more], lo[more], offset[more] - 1
        if len(live):
            lo, hi = index.parent(lo)
            lo, hi = index.extend(lo, hi, text[starts[live] + offset])
    passage, offset, lo = (np.concatenate(c) for c in zip(*steps))
    place = np.stack([lo, places[passage, 0], places[passage, 1], places[passage, 2] + offset])
    by = np.lexsort(place[::-1])
    place = place[:, by]
    first = np.flatnonzero(np.diff(place[0], prepend=-1))
    earliest = np.repeat(place[:, first], np.diff(first, append=len(by)), axis=1)
    hit = by[np.any(place != earliest, axis=0)]
    return passage[hit], offset[hit]


def with_key(docs: DataFrame) -> DataFrame:
    """docs with __doc and __twin, which name a document; __twin is 0 where every doc_id is unique."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    repeated = docs.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    return docs.withColumns({"__doc": doc, "__twin": F.xxhash64("text") if repeated else F.lit(0).cast("long")})


def _count_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
            found = find_anchors(*word_hashes(batch.column(1)), length)[0]
            anchor, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "n": n})

    return run


def _list_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
            words, cuts = word_hashes(batch.column(1))
            anchor, row, start, end = find_anchors(words, cuts, length)
            doc, twin = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 2))
            yield pa.RecordBatch.from_pydict(
                {"anchor": anchor.view(np.int64), "context": spans(words, start, end).view(np.int64), "doc": doc, "twin": twin, "start": (start - cuts[row]).astype(np.int32), "size": (end - start).astype(np.int32)}
            )

    return run


def _cut_contexts(length: int):
    """Contexts with their words; of hot anchors the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
            words, cuts = word_hashes(batch.column(1))
            lists = {name: batch.column(name) for name in ("start", "size", "anchor", "hot")}
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists["start"].offsets.to_numpy()))
            start, size, anchor, hot = (lists[name].flatten().to_numpy(zero_copy_only=False) for name in lists)
            start = start.astype(np.int64) + cuts[row]
            doc, twin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            cold = np.flatnonzero(~hot)
            yield pa.RecordBatch.from_pydict(
                {
                    "route": pa.array(anchor[cold], pa.int64()),
                    "words": pa.array([words[a : a + n].tobytes() for a, n in zip(start[cold].tolist(), size[cold].tolist())], pa.binary()),
                    "doc": doc[row[cold]],
                    "twin": twin[row[cold]],
                    "start": (start[cold] - cuts[row[cold]]).astype(np.int32),
                }
            )
            many = np.flatnonzero(hot)
            windows = size[many] - length + 1
            of = np.repeat(many, windows)
            at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            yield pa.RecordBatch.from_pydict(
                {"route": spans(words, at, at + length).view(np.int64), "words": pa.nulls(len(of), pa.binary()), "doc": doc[row[of]], "twin": twin[row[of]], "start": (at - cuts[row[of]]).astype(np.int32)}
            )

    return run


def _search(length: int):
    def run(shard: pa.Table) -> pa.Table:
        passages = [np.frombuffer(x, np.uint64) for x in shard["words"].to_pylist()]
        places = np.stack([shard[c].to_numpy().astype(np.int64) for c in ("doc", "twin", "start")], 1)
        passage, offset = earlier_windows(passages, places, length)
        place = places[passage]
        return pa.table({"doc": place[:, 0], "twin": place[:, 1], "start": (place[:, 2] + offset).astype(np.int32), "size": np.full(len(passage), length, np.int32)})

    return run


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with keyed (each key once, with n, its number of rows), so that no task gets many more than total / HEAVY rows of one key.

    A key with more rows than that is dealt to several tasks by a hash of the columns `by`. Fewer than HEAVY keys have so
    many; they alone are broadcast, and repeated fewer than 2 * HEAVY times in all.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 1
    parts = F.least("n", F.ceil(F.col("n") * HEAVY / total))
    heavy = keyed.where(parts > 1)
    marked = rows.join(F.broadcast(heavy.select(*keys, parts.alias("parts"))), keys, "left")
    dealt = marked.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), "parts"), F.lit(0))).drop("parts")
    copies = keyed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    return dealt.join(copies, [*keys, "part"]).drop("part")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, twin, start and size (in words) of passages to remove; docs is keyed by with_key."""
    texts = docs.select(F.col("__doc").alias("doc"), "text", F.col("__twin").alias("twin"))
    counted = texts.mapInArrow(_count_anchors(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = stage(counted.where("n > 1"), "substring-anchors")
    listed = texts.mapInArrow(_list_anchors(length), "anchor long, context long, doc long, twin long, start int, size int")
    seen = stage(spread_join(listed, repeated, ["anchor"], ["doc", "start"]), "substring-seen")
    unstage(repeated)
    firsts = stage(
        seen.groupBy("anchor", "context").agg(F.min(F.struct("doc", "twin", "start")).alias("first"), F.min("size").alias("size"), F.count("*").alias("n")),
        "substring-firsts",
    )
    copied = firsts.where("n > 1").select("anchor", "context", "first", "n")
    later = spread_join(seen, copied, ["anchor", "context"], ["doc", "start"]).where(F.struct("doc", "twin", "start") != F.col("first")).select("doc", "twin", "start", "size")
    several = stage(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") > HOT), "substring-several")
    open_ = spread_join(firsts.drop("n"), several, ["anchor"], ["first"]).select("first.*", "size", "anchor", "hot")
    by_doc = open_.groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "size", "anchor", "hot")).alias("at"))
    cut = texts.join(by_doc, ["doc", "twin"]).select("doc", "text", "twin", "at.start", "at.size", "at.anchor", "at.hot")
    contexts = stage(cut.mapInArrow(_cut_contexts(length), "route long, words binary, doc long, twin long, start int"), "substring-contexts")
    cold, hot = contexts.where("words is not null"), contexts.where("words is null").drop("words")
    shards = cold.count() // SHARD + 1
    searched = cold.groupBy(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")).applyInArrow(_search(length), "doc long, twin long, start int, size int")
    earliest = stage(hot.groupBy("route").agg(F.min(F.struct("doc", "twin", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "substring-hot")
    compared = spread_join(hot, earliest, ["route"], ["doc", "start"]).where(F.struct("doc", "twin", "start") != F.col("first")).select("doc", "twin", "start", F.lit(length).alias("size"))
    found = stage(later.unionByName(searched).unionByName(compared), "substring-repeats")
    for done in (seen, firsts, several, contexts, earliest):
        unstage(done)
    return found


def cut_words(text: str | None, starts: list[int] | None, sizes: list[int] | None) -> tuple[str, int, int]:
    """(kept words, number of words, number removed)."""
    words = text.encode().split() if text else []
    if not starts:
        return b" ".join(words).decode(), len(words), 0
    kept, at = [], 0
    for start, size in sorted(zip(starts, sizes)):
        if start > at:
            kept += words[at:start]
        at = max(at, start + size)
    kept += words[at:]
    return b" ".join(kept).decode(), len(words), len(words) - len(kept)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces_of(whole, PIECE_CHARS)):
        rows = [cut_words(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_pydict({"row": batch.column(0), "kept": pa.array(columns[0], pa.string()), "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64())})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the words left, joined by blanks), n_words and n_removed for each row."""
    keyed = with_key(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    marks = find_repeats(keyed, length).groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "size")).alias("at"))
    marked = keyed.join(marks, (F.col("__doc") == F.col("doc")) & (F.col("__twin") == F.col("twin")), "left")
    rows = marked.select(F.col("doc_id").cast("long").alias("row"), "text", "at.start", "at.size").mapInArrow(_remove, "row long, kept string, n_words long, n_removed long")
    return rows.withColumnRenamed("row", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(words) - {LENGTH - 1})) AS start, words FROM d WHERE len(words) >= {LENGTH}),
h AS (SELECT doc_id, start, array_to_string(words[start : start + {LENGTH - 1}], ' ') AS win FROM w),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS nth FROM h) WHERE nth > 1),
cut AS (SELECT DISTINCT doc_id, unnest(generate_series(start, start + {LENGTH - 1})) AS pos FROM r),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
k AS (SELECT x.doc_id, count(*) AS n_words, count(cut.pos) AS n_removed,
  coalesce(string_agg(word, ' ' ORDER BY x.pos) FILTER (cut.pos IS NULL), '') AS kept FROM x LEFT JOIN cut USING (doc_id, pos) GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
