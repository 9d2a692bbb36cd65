"""64-bit hashes of words and word runs, computed for whole Arrow columns at once.

A word's hash is a polynomial over random numbers for its bytes, taken from prefix sums, so the
cost is a few array operations a byte and no string is built. Different words (or
runs of words) get the same hash with odds of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed in one go, which bounds the arrays.
CHUNK = 1 << 19
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_FACTOR))
#: The same with A-Z read as a-z.
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]


def powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor^0..factor^n modulo 2^64, and the same of its inverse."""
    have = _powers.get(factor)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        rows = []
        for f in (factor, pow(factor, -1, 1 << 64)):
            row = np.full(size, f, np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        have = _powers[factor] = rows[0], rows[1]
    return have


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of hashes[start:end] for each pair; equal runs of words have equal hashes."""
    up, down = powers(WORD_FACTOR, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return spans(hashes, at, at + k)


def word_hashes(texts: pa.Array, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, in order, and the bounds of each row's words in them."""
    texts = pc.fill_null(texts, "")
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or texts.buffers()[2] is None or cuts[-1] == cuts[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    cuts -= cuts[0]
    table, found, begun, at = FOLDED if folded else EXACT, [], [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):  # cut behind a white byte or at a row's start
            tail = np.flatnonzero(WHITE[data[at:end]])
            row = cuts[np.searchsorted(cuts, end, "right") - 1]
            end = max(at + tail[-1] + 1 if len(tail) else at, row)
            if end == at:  # a word longer than CHUNK
                later = np.flatnonzero(WHITE[data[at + CHUNK :]])
                end = at + CHUNK + later[0] if len(later) else len(data)
                end = min(end, cuts[np.searchsorted(cuts, at, "right")])
        x = data[at:end]
        n = len(x)
        end = at + n
        up, down = powers(BYTE_FACTOR, n)
        white = WHITE[x]
        edge = np.ones(n + 1, bool)  # a word can't go on across these places
        edge[1:n] = white[:-1]
        rows = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end, "right")] - at
        edge[rows] = True
        starts = np.flatnonzero(~white & edge[:-1])
        edge[:n] = white
        edge[rows] = True
        ends = np.flatnonzero(~white & edge[1:]) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[x] * up[:n], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        begun.append(starts + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(begun), cuts)
