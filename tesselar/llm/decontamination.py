"""Benchmark decontamination by pigeonhole edit matching on words.

Texts and test items are lower-cased and reduced to words of letters and digits; each letter of a script without
blanks (SEPARATE) is a word of its own. An
item of n words may have e = floor(RATE * n) word edits (insert, delete, replace), none below MIN_WORDS words. It is split
into e + 1 pieces; a copy within the budget has at least one piece unharmed, so
every text is searched for exact pieces by one Aho-Corasick automaton, and around each hit
Myers' bit-parallel algorithm finds the least edit distance of the item to any
passage there. Pieces and items are broadcast in chunks of at most CHUNK_CHARS
characters; a larger benchmark takes one scan of the documents for each chunk.

Edge cases: null or empty texts and items match nothing; items of fewer than
MIN_WORDS words are found as exact copies only; null ids of documents and items are reported as such; long
texts are searched whole; of equally close passages the first is reported; repeated document rows are reported for each row, repeated items under each
of their ids; an empty benchmark gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

RATE = 0.2
MIN_WORDS = 6
CHUNK_CHARS = 8_000_000
BATCH_ROWS = 500
SEPARATE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
SCHEMA = "doc_id long, item_id long, distance int, budget int, item_words int, start_word int, end_word int"


def normalized(text: Column) -> Column:
    """Lower-case words of letters and digits, each followed by one blank, after a leading blank."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATE, " $0 ")
    return F.concat(F.lit(" "), F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def split_item(words: list[str], budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of nearly equal length."""
    n, k = len(words), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(pattern: list[str], text: list[str], anchored: bool = False) -> Iterator[tuple[int, int]]:
    """(j, distance) for j = 0..len(text): pattern against the text that ends before j.

    The passage may begin anywhere, or with anchored at the text's start.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    yield 0, score
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        score += bool(ph & high) - bool(mh & high)
        ph = ph << 1 | anchored
        mh <<= 1
        up = (mh | ~(xv | ph)) & full
        down = ph & xv & full
        yield j, score


def best_passage(pattern: list[str], text: list[str], budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest passage: least distance, then earliest end, then shortest."""
    distance, end = min((d, j) for j, d in myers(pattern, text))
    if distance > budget:
        return None
    back = text[max(0, end - len(pattern) - budget) : end][::-1]
    length = next(j for j, d in myers(pattern[::-1], back, anchored=True) if d == distance)
    return distance, end - length, end


class Searcher:
    """Automaton over the pieces of a chunk of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.pieces, pieces = [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            words = text.split()
            if not words:
                continue
            budget = int(rate * len(words)) if len(words) >= MIN_WORDS else 0
            for a, b in split_item(words, budget):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.items), a))
            self.items.append((item_id, words, budget))
        for piece, homes in pieces.items():
            self.pieces.add_word(piece, (len(piece), homes))
        self.empty = not pieces
        if pieces:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item_id, distance, budget, item_words, start, end) for each item that the text holds."""
        if self.empty:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        seen_at, seen_words = 0, 0
        for at, (length, homes) in self.pieces.iter(text):
            first = at - length + 1  # the blank before the piece
            if first < seen_at:
                seen_at, seen_words = 0, 0
            seen_words += text.count(" ", seen_at, first)
            seen_at = first
            for item, offset in homes:
                _, words, budget = self.items[item]
                start = seen_words - offset - budget
                near.setdefault(item, []).append((max(0, start), start + len(words) + 2 * budget))
        if not near:
            return []
        words, found = text.split(), []
        for item, spans in near.items():
            item_id, pattern, budget = self.items[item]
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            hits = [(hit[0], a + hit[1], a + hit[2]) for a, b in merged if (hit := best_passage(pattern, words[a:b], budget))]
            if hits:
                distance, start, end = min(hits)
                found.append((item_id, distance, budget, len(pattern), start, end))
        return found


def chunks(items: DataFrame, limit: int = CHUNK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most `limit` characters (a longer item alone)."""
    some, held = [], 0
    for item_id, text in items.select("item_id", normalized(F.col("text")).alias("text")).toLocalIterator():
        if some and held + len(text) > limit:
            yield some
            some, held = [], 0
        some.append((item_id, text))
        held += len(text)
    if some:
        yield some


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, limit: int = CHUNK_CHARS) -> DataFrame:
    """One row for each document row and test item that it holds within the item's error budget."""
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("t"))
    for some in chunks(items, limit):
        shared = spark.sparkContext.broadcast(some)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            searcher, names = Searcher(shared.value, rate), [c.split()[0] for c in SCHEMA.split(", ")]
            for pdf in batches(frames, BATCH_ROWS):
                rows = [(doc, *hit) for doc, text in zip(pdf["doc_id"], pdf["t"], strict=True) for hit in searcher.find(text)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = texts.mapInPandas(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _is_clean(shared, rate: float):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(shared.value, rate)
        for series in texts:
            yield pd.Series([not searcher.find(t) for t in series], dtype=bool)

    return clean


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, limit: int = CHUNK_CHARS) -> DataFrame:
    """docs without the rows that hold a test item; columns stay as they are."""
    for some in chunks(items, limit):
        docs = docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(some), rate)(normalized(F.col("text"))))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
