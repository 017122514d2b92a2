"""Interpolated modified Kneser-Ney models, counted in Spark and looked up in sorted hash arrays.

An n-gram is a 64-bit key of ``order`` fields of ``bits`` bits, so no two
n-grams share a key.  Counting pre-aggregates in every map task and meets by
ranges of the spread keys; each range becomes one pair of files (sorted keys,
counts) in the shared folder.  The same reduction sends on what the next lower
order needs: continuation counts, and the totals of each context.  Workers map
the files into memory and look keys up in sorted blocks, so that a model larger
than memory is read range by range.

P(w|h) = max(c(hw) - D(c), 0) / c(h) + gamma(h) P(w|h'), with D1, D2, D3+ from
each order's counts of counts; below the highest order c counts the distinct
words seen to the left.  The last step down is uniform over the vocabulary and
one unknown word.  A context never seen leaves the lower order alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .sharedfs import map_array, write_array
from .textkernel import U64, mix64

SCHEMA = "shard int, kind string, keys binary, vals binary, stat string"
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("vals", pa.binary()), ("stat", pa.string())])
#: Keys that a map task holds before it sums and, if they stay, sends them.
HELD_KEYS = 3_000_000
#: Map tasks that send to one shard before groups of them are summed first.
FAN = 4096


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)


def _dealt(kind: str, keys: np.ndarray, values: np.ndarray, shards: int) -> list[tuple]:
    """Packed rows of sorted keys, one per shard that has any."""
    at = blobs.cut(keys, shards)
    return [(k, kind, blobs.pack_sorted(keys[a:b]), blobs.pack_values(values[a:b]), None) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def counting(keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], kind: str, shards: int, spread: bool = True):
    """Map side: counts the keys of each batch and sends sums by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return held[0] if len(held) == 1 else blobs.summed(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

        for batch in batches:
            for keys in keys_of(batch):
                held.append(blobs.counted(mix64(keys) if spread else keys))
                size += len(held[-1][0])
                if size > HELD_KEYS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_KEYS // 2:
                        yield _rows(_dealt(kind, *held[0], shards))
                        held, size = [], 0
        if held:
            yield _rows(_dealt(kind, *merged(), shards))

    return run


#: Columns of values: n-grams have a count, contexts the total and the numbers of counts 1, 2 and more.
_COLUMNS = {"g": 1, "c": 4}


class _Sums:
    """Sums runs of sorted keys as they come: holds about three times the distinct keys, however many runs there are."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.least = 0, 1 << 16

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.runs.append((keys, values))
        self.held += len(keys)
        if self.held > 2 * self.least:
            self.least = max(len(self.total()[0]), 1 << 16)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs) > 1:
            self.runs = [blobs.summed(np.concatenate([k for k, _ in self.runs]), np.concatenate([v for _, v in self.runs]))]
        self.held = len(self.runs[0][0])
        return self.runs[0]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray] | tuple[int, str, None, str]]:
    """(shard, kind, sorted distinct keys, their summed values) of a partition sorted by the first two; statistics as they are."""
    now, sums = None, _Sums()
    for batch in batches:
        for shard, kind, k, v, s in zip(*batch.columns, strict=True):
            if s.is_valid:
                yield -1, "stat", None, s.as_py()
                continue
            if (key := (shard.as_py(), kind.as_py())) != now:
                if now:
                    yield *now, *sums.total()
                now, sums = key, _Sums()
            sums.add(blobs.unpack_sorted(k.as_py()), blobs.unpack_values(v.as_py(), _COLUMNS[now[1][0]]))
    if now:
        yield *now, *sums.total()


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed row for each shard and kind of a partition sorted by them."""
    for shard, kind, keys, values in _grouped(batches):
        yield _rows([(shard, kind, blobs.pack_sorted(keys), blobs.pack_values(values), None)])


def gathered(counts: DataFrame, shards: int) -> DataFrame:
    """The packed counts themselves, or where more than ``FAN`` map tasks would send to each shard, sums of groups of tasks."""
    groups = -(-counts.rdd.getNumPartitions() // FAN)
    if groups < 2:
        return counts
    parted = counts.withColumn("part", F.spark_partition_id() % groups)
    return parted.repartitionById(groups * shards, F.col("shard") * groups + F.col("part")).sortWithinPartitions("shard", "kind").drop("part").mapInArrow(_merging, SCHEMA)


def _inverse_mix(x: np.ndarray) -> np.ndarray:
    """Undoes mix64."""
    x = x.astype(U64, copy=True)
    x ^= (x >> U64(31)) ^ (x >> U64(62))
    x *= U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> U64(27)) ^ (x >> U64(54))
    x *= U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> U64(30)) ^ (x >> U64(60))
    return x


def _reducing(order: int, bits: int, shards: int, folder: str):
    """Reduce side for the n-grams of one order and the contexts of the order above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kind, keys, values in _grouped(batches):
            if kind == "stat":
                yield _rows([(0, "stat", None, None, values)])
                continue
            write_array(f"{folder}/{kind}-{shard:05d}.key.npy", keys)
            write_array(f"{folder}/{kind}-{shard:05d}.val.npy", values)
            stat = {"kind": kind, "shard": shard, "n": len(keys), "sum": int(values[:, 0].sum())}
            out = []
            if kind[0] == "g":
                count = values[:, 0]
                stat["of"] = [int((count == k).sum()) for k in (1, 2, 3, 4)]
                stat["over"] = int((count >= 3).sum())
                if order > 1:
                    plain = _inverse_mix(keys)
                    below = plain & U64((1 << (bits * (order - 1))) - 1)
                    out += _dealt(f"g{order - 1}", *blobs.counted(mix64(below)), shards)
                    parts = np.stack([count, (count == 1).astype(U64), (count == 2).astype(U64), (count >= 3).astype(U64)], axis=1)
                    out += _dealt(f"c{order}", *blobs.summed(mix64(plain >> U64(bits)), parts), shards)
            yield _rows([*out, (0, "stat", None, None, json.dumps(stat))])

    return run


@dataclass
class SortedTable:
    """Sorted arrays of one kind, cut into ranges of keys."""

    folder: str
    kind: str
    shards: int
    sizes: dict[int, int]

    def find(self, keys: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, place in the whole table or -1) of sorted spread keys."""
        values, place = np.zeros((len(keys), columns), dtype=U64), np.full(len(keys), -1, dtype=np.int64)
        at, before = blobs.cut(keys, self.shards), 0
        for shard in range(self.shards):
            n = self.sizes.get(shard, 0)
            a, b = at[shard], at[shard + 1]
            if n and b > a:
                have = map_array(f"{self.folder}/{self.kind}-{shard:05d}.key.npy")
                i = np.minimum(np.searchsorted(have, keys[a:b]), n - 1)
                hit = have[i] == keys[a:b]
                values[a:b][hit] = map_array(f"{self.folder}/{self.kind}-{shard:05d}.val.npy")[i[hit]]
                place[a:b][hit] = before + i[hit]
            before += n
        return values, place

    def __len__(self) -> int:
        return sum(self.sizes.values())


def tables(stats: list[dict], folder: str, shards: int) -> dict[str, SortedTable]:
    found: dict[str, SortedTable] = {}
    for s in stats:
        found.setdefault(s["kind"], SortedTable(folder, s["kind"], shards, {})).sizes[s["shard"]] = s["n"]
    return found


def _exchange(df: DataFrame, shards: int) -> DataFrame:
    return df.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")


def _stats(df: DataFrame) -> list[dict]:
    """One short row per file: as many as there are ranges, whatever the corpus."""
    return [json.loads(r["stat"]) for r in df.where("kind = 'stat'").select("stat").collect()]


def count_table(counts: DataFrame, shards: int, folder: str) -> tuple[SortedTable, int]:
    """Sums packed counts of one kind ('g1') into a sorted table; also the sum of all counts."""
    stats = _stats(_exchange(gathered(counts, shards), shards).mapInArrow(_reducing(1, 64, shards, folder), SCHEMA))
    return tables(stats, folder, shards).get("g1", SortedTable(folder, "g1", shards, {})), sum(s["sum"] for s in stats)


@dataclass
class KneserNey:
    """A fitted model; small itself, its arrays stay in the shared folder."""

    order: int
    bits: int
    vocabulary: int
    grams: dict[int, SortedTable] = field(default_factory=dict)
    contexts: dict[int, SortedTable] = field(default_factory=dict)
    discounts: dict[int, list[float]] = field(default_factory=dict)
    base: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(last field | fields before) of each key of the full order."""
        distinct, back = np.unique(keys, return_inverse=True)
        return self._log10_distinct(distinct)[back]

    def _looked_up(self, table: SortedTable | None, keys: np.ndarray, columns: int) -> np.ndarray:
        if table is None:
            return np.zeros((len(keys), columns))
        spread = mix64(keys)
        order = np.argsort(spread)
        sorted_keys = spread[order]
        new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, bool)
        values, _ = table.find(sorted_keys[new], columns)
        out = np.empty((len(keys), columns))
        out[order] = values[np.cumsum(new) - 1]
        return out

    def _log10_distinct(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / (self.vocabulary + 1))
        for m in range(1, self.order + 1):
            part = keys & U64((1 << (self.bits * m)) - 1) if self.bits * m < 64 else keys
            d = np.array([0.0, *self.discounts[m]])
            c = self._looked_up(self.grams.get(m), part, 1)[:, 0]
            if m == 1:
                total, *n = (np.full(len(keys), x) for x in self.base)
            else:
                total, *n = self._looked_up(self.contexts.get(m), part >> U64(self.bits), 4).T
            seen = total > 0
            total = np.where(seen, total, 1.0)
            gamma = np.where(seen, (d[1] * n[0] + d[2] * n[1] + d[3] * n[2]) / total, 1.0)
            p = np.where(seen, np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total, 0.0) + gamma * p
        return np.log10(np.maximum(p, 1e-300))


def _discounts(of: list[int]) -> list[float]:
    """Chen and Goodman's estimates; where a count of counts is zero, the nearest value that stays within its bounds."""
    n1, n2, n3, n4 = of
    if not n1 or not n2:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def fit(spark: SparkSession, counts: DataFrame, order: int, bits: int, shards: int, folder: str, vocabulary: int) -> KneserNey:
    """A model from packed counts of the highest order's keys (kind ``g{order}``), in one job."""
    if order * bits > 64:
        raise ValueError("an n-gram must fit 64 bits")
    rows = gathered(counts, shards)
    for m in range(order, 0, -1):
        rows = _exchange(rows, shards).mapInArrow(_reducing(m, bits, shards, folder), SCHEMA)
    stats = _stats(rows)
    by_kind = tables(stats, folder, shards)
    model = KneserNey(order, bits, vocabulary)
    for m in range(1, order + 1):
        own = [s for s in stats if s["kind"] == f"g{m}"]
        of = [sum(s["of"][k] for s in own) for k in range(4)]
        model.discounts[m] = _discounts(of)
        if f"g{m}" in by_kind:
            model.grams[m] = by_kind[f"g{m}"]
        if f"c{m}" in by_kind:
            model.contexts[m] = by_kind[f"c{m}"]
        if m == 1:
            model.base = (float(sum(s["sum"] for s in own)), float(of[0]), float(of[1]), float(sum(s["over"] for s in own)))
    return model
