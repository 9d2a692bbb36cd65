"""Hierarchical multi-length packing of token ids into training sequences.

Documents are tokenised and packed in one pass of each Spark partition, without a
shuffle. Whole windows of the longest context are cut off first; the tail of each
document is routed to the smallest context tier that holds it. When a bounded pool
of tails is full, each tier is packed longest first: a tail opens a window of its
tier, and the gap is filled with the best-fitting tails of shorter tiers, the last of
them cut to size. Every window is thus exactly as long as its tier; what is left when
a partition ends is cut into powers of two, so no sequence needs padding. Windows of
a tier are dealt to step groups of step_tokens; those that fill no group by the end of a partition are put together, longest first. So
all step groups of a partition hold the same number of tokens, but for its last one (tiers and step_tokens being powers of two).

Edge cases: null text is empty and yields only the end id; repeated rows are packed
as documents of their own; long texts and words count whole (a text's ids are held at once); tails of equal length go by the smaller id; an empty table gives no rows; extra columns are ignored.
A partition's order of rows is that of its file split, so a rerun after a lost
executor gives the same sequences.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END_ID = 1
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
#: A task holds at most so many tokens of tails, and so many words and characters of its word cache.
POOL_TOKENS = 2_000_000
CACHE_WORDS, CACHE_CHARS = 600_000, 20_000_000
BATCH_ROWS, BATCH_CHARS = 2_000, 8_000_000
#: Letters whose lower case and normal form are known beforehand, and how the vocabulary writes their bytes.
PLAIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: A mark that ends a word is a piece of its own, and is set apart so that fewer words differ.
MARK = r"([A-Za-z])([.,])( |$)"
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts; words between blanks are encoded once and kept in a bounded cache.

    The vocabulary's pre-tokenizer never joins text across white space, so the ids
    of a text are those of its words in a row. A word of plain Latin letters is one
    piece: it goes to the merges in lower case, past normalizer and pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def slow(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def fast(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of plain letters."""
        found: list[bytes] = []
        for at in range(0, len(words), 5000):
            joined = " ".join(words[at : at + 5000])
            if not joined.isascii():
                joined = joined.encode().decode("latin-1").translate(BYTE_LETTERS)
            made = self.merges.encode(joined, add_special_tokens=False)
            ids, of = array("I", made.ids).tobytes(), made.word_ids
            ends = [4 * i for i, (p, q) in enumerate(zip(of, of[1:]), 1) if p != q] + [len(ids)]
            found += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            known.clear()
            self.chars = 0
        new = [w for w in words if w not in known]
        if new:
            self.chars += sum(map(len, new))
            plain = {w: w.lower() for w in new if PLAIN.fullmatch(w)}
            lower = sorted({v for v in plain.values() if v not in known}, key=str.isascii)
            known.update(zip(lower, self.fast(lower), strict=True))
            for word, v in plain.items():
                known[word] = known[v]
            odd = [w for w in new if w not in plain]
            known.update(zip(odd, self.slow(odd), strict=True))
        return list(map(known.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        lists = pc.split_pattern(pc.replace_substring_regex(texts, MARK, r"\1 \2\3"), " ")
        flat = lists.flatten().dictionary_encode()
        found = np.array([*self.ids_of(flat.dictionary.to_pylist()), None], object)[:-1]
        ids = found[flat.indices.to_numpy()].tolist()
        cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder per Python worker, which keeps its cache from task to task."""
    return WordEncoder(path)


class TierPacker:
    """Packs tails of documents; emits (doc_id, start, ids, doc_tokens, sequence, offset, tier, step)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.pool: dict[int, list] = {t: [] for t in tiers}
        self.held, self.first = 0, first_id
        self.sequences, self.steps = 0, 0
        self.open: dict[int, list[list[tuple]]] = {}  # windows of each tier that wait for a whole step group
        self.out: list[tuple] = []

    def window(self, parts: list, tier: int) -> None:
        at, rows = 0, []
        for _, doc, start, ids, total in parts:
            rows.append((doc, start, ids, total, self.first + self.sequences, at, tier))
            at += len(ids) // 4
        self.sequences += 1
        group = self.open.setdefault(tier, [])
        group.append(rows)
        if (len(group) + 1) * tier > self.step_tokens:
            self.step(self.open.pop(tier))

    def step(self, windows: list[list[tuple]]) -> None:
        self.out += [(*row, self.first + self.steps) for rows in windows for row in rows]
        self.steps += 1

    def finish(self) -> None:
        """Deal the windows that are left to groups of all tiers, longest first: powers of two fill each group, but for the last one."""
        group, room = [], self.step_tokens
        for tier in sorted(self.open, reverse=True):
            for rows in self.open[tier]:
                if group and tier > room:
                    self.step(group)
                    group, room = [], self.step_tokens
                group.append(rows)
                room -= tier
        if group:
            self.step(group)
        self.open = {}

    def add(self, doc: int, ids: bytes) -> None:
        total, longest, start = len(ids) // 4, self.tiers[-1], 0
        while total - start >= longest:
            self.window([(longest, doc, start, ids[4 * start : 4 * (start + longest)], total)], longest)
            start += longest
        if start < total:
            self.route((total - start, doc, start, ids[4 * start :], total))
            self.held += total - start

    def route(self, part: tuple) -> None:
        self.pool[self.tiers[bisect.bisect_left(self.tiers, part[0])]].append(part)

    def flush(self) -> None:
        """Pack the pool; the last window, if it can't be filled, is cut into powers of two."""
        for tier in self.tiers:
            self.pool[tier].sort(key=lambda p: p[:3])
        for at in range(len(self.tiers) - 1, -1, -1):
            tier, lower = self.tiers[at], self.tiers[:at]
            while self.pool[tier]:
                parts = [self.pool[tier].pop()]
                gap = tier - parts[0][0]
                while gap and (part := self.fitting(gap, lower if at else (tier,))):
                    parts.append(part)
                    gap -= part[0]
                if gap:  # only shorter tails are left
                    self.leave(parts, tier)
                else:
                    self.window(parts, tier)
        self.held = 0

    def fitting(self, gap: int, tiers: tuple[int, ...]) -> tuple | None:
        """The longest tail that fits the gap, or else the shortest one cut to it."""
        for tier in reversed(tiers):
            have = self.pool[tier]
            if (k := bisect.bisect_right(have, gap, key=lambda p: p[0])) > 0:
                return have.pop(k - 1)
        for tier in tiers:
            if self.pool[tier]:
                n, doc, start, ids, total = self.pool[tier].pop(0)
                rest = (n - gap, doc, start + gap, ids[4 * gap :], total)
                home = self.pool[self.tiers[bisect.bisect_left(self.tiers, rest[0])]]
                bisect.insort(home, rest, key=lambda p: p[:3])
                return gap, doc, start, ids[: 4 * gap], total
        return None

    def leave(self, parts: list, tier: int) -> None:
        """A window that could not be filled: cut into full windows of powers of two (shorter tiers first)."""
        parts, size = [list(p) for p in parts], tier // 2
        while parts:
            have = sum(p[0] for p in parts)
            while size > have:
                size //= 2
            taken, room = [], size
            while room:
                n, doc, start, ids, total = parts[0]
                cut = min(n, room)
                taken.append((cut, doc, start, ids[: 4 * cut], total))
                room -= cut
                parts[0] = [n - cut, doc, start + cut, ids[4 * cut :], total]
                if n == cut:
                    parts.pop(0)
            self.window(taken, size)

    def rows(self, with_ids: bool) -> pa.RecordBatch:
        rows, self.out = self.out, []
        doc, start, ids, total, sequence, at, tier, step = zip(*rows, strict=True)
        columns = {
            "doc_id": pa.array(doc, pa.int64()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64()),
            "doc_tokens": pa.array(total, pa.int64()),
            "sequence_id": pa.array(sequence, pa.int64()),
            "offset": pa.array(at, pa.int64()),
            "tier": pa.array(tier, pa.int32()),
            "step_group": pa.array(step, pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))


def pieces_of(batch: pa.RecordBatch, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and about `chars` bytes of text, which is the second column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars))
        end = max(at + 1, min(at + BATCH_ROWS, end))
        yield batch.slice(at, end - at)
        at = end


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: SCHEMA, and with_ids the ids as little-endian 32-bit bytes.

    tiers are powers of two in rising order; tokenizer is a path that every executor has.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), array("I", [END_ID]).tobytes()
        packer = TierPacker(tiers, step_tokens, TaskContext.get().partitionId() << 36)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(pc.fill_null(batch.column(1), "")), strict=True):
                packer.add(doc, ids + end)
                if packer.held >= POOL_TOKENS:
                    packer.flush()
            if packer.out:
                yield packer.rows(with_ids)
        packer.flush()
        packer.finish()
        if packer.out:
            yield packer.rows(with_ids)

    # The words are cut at blanks; a line's end counts as one.
    texts = docs.select(F.col("doc_id").cast("long"), F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(" ")).alias("text"))
    return texts.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
