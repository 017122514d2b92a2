"""Sorted 64-bit keys with values, packed for a shuffle.

A map task sorts and sums its keys, cuts them by key range into shards, and
sends one packed row per shard instead of one row per key: about six bytes a key
where a row would take over twenty.  Keys are spread by mix64, so that shards
are of like size whatever the keys' frequencies.
"""

from __future__ import annotations

import numpy as np
import zstandard

from .textkernel import U64


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit values by significance: high ones, mostly zero, pack to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw), dtype=U64)


def pack_values(values: np.ndarray) -> bytes:
    """A matrix of counts, one row per key."""
    return _planes(np.ascontiguousarray(values.T).reshape(-1))


def unpack_values(raw: bytes, columns: int) -> np.ndarray:
    return _unplanes(raw).reshape(columns, -1).T


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key; grows with the key, so shards are ranges of keys."""
    return (((keys >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int32)


def cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard of sorted keys begins, and their number at the end."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their rows of values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(values, at, axis=0)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros((0, 1), dtype=U64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(at, append=len(keys)).astype(U64)[:, None]
