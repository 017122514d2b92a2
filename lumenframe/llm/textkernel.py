"""Vectorised word splitting and hashing over Arrow string buffers.

Every function works on the UTF-8 bytes of many texts at once, so the per-word
cost is a few numpy instructions and no Python objects are made.  All the word
classes used by the operators are unions of ASCII bytes and bytes >= 0x80, so
splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD1342543DE82EF95)
_INV = U64(pow(int(_BASE), -1, 1 << 64))

#: Bytes of one slice of work; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if lower:
        codes[65:91] += U64(32)
    return mix64(codes * _ODD + U64(0x1234567))


_LETTERS = {flag: _letters(flag) for flag in (False, True)}

#: Bytes outside words: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters and digits: [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] (capitals count as their small letters).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x41] = NOT_ALNUM[0x5B:0x61] = NOT_ALNUM[0x7B:0x80] = True

_powers = (np.ones(1, dtype=U64), np.ones(1, dtype=U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept for slices of the usual size."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1) if n <= SLICE_BYTES + 1 else n
        tables = []
        for base in (_BASE, _INV):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size <= 4 * SLICE_BYTES:
            _powers = tuple(tables)
        return tuple(tables)
    return _powers


@dataclass
class Words:
    """Words of a run of texts, in order.  Offsets are bytes into ``data``."""

    data: np.ndarray
    offsets: np.ndarray  # of the texts, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than there are texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_string()).fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of texts of at most ``most`` bytes together; a longer text alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, outside: np.ndarray = SPACE, hashes: bool = True) -> Words:
    """Words of each text: the longest runs of bytes that are not ``outside``."""
    n = len(data)
    inside = ~outside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    start = np.flatnonzero(inside & before)
    after = np.ones(n, dtype=bool)
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    end = np.flatnonzero(inside & after) + 1
    h = np.zeros(0, dtype=U64)
    if hashes:
        power, inverse = _power_tables(n)
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_LETTERS[lower][data] * power[:n], out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        h = mix64(h + (end - start).astype(U64) * _ODD)
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def word_hash(word: str | bytes) -> int:
    """The hash that split() gives this word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    power, _ = _power_tables(len(raw))
    h = np.sum(_LETTERS[False][raw] * power[: len(raw)], dtype=U64, keepdims=True)
    return int(mix64(h + np.array([len(raw)], dtype=U64) * _ODD)[0])


def split_batches(column: pa.Array, lower: bool = False, outside: np.ndarray = SPACE, hashes: bool = True, most: int = SLICE_BYTES):
    """Yields (first text, past the last text, Words) over bounded slices of a column."""
    data, offsets = buffers(column)
    for a, b in slices(offsets, most):
        part = data[offsets[a] : offsets[b]]
        yield a, b, split(part, offsets[a : b + 1] - offsets[a], lower, outside, hashes)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values; those that cross texts are the caller's to leave out."""
    n = max(0, len(hashes) - width + 1)
    g = np.zeros(n, dtype=U64)
    for k in range(width):
        g *= _BASE
        g += hashes[k : k + n]
    return mix64(g)


def gram_counts(first: np.ndarray, width: int) -> np.ndarray:
    """Runs of ``width`` words that each text has."""
    return np.maximum(np.diff(first) - width + 1, 0)


def gram_index(first: np.ndarray, width: int) -> np.ndarray:
    """Index of the first word of each run of ``width`` words that lies within one text."""
    counts = gram_counts(first, width)
    total = int(counts.sum())
    skip = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else np.zeros(0, dtype=np.int64)
    return np.arange(total) + skip


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(x, dtype=np.int64)).view(U64)
