"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where the C library has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory, which the allocators of Arrow and C keep, to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def releasing(task: Task) -> Task:
    """The task, after whose end its worker keeps no freed memory: it waits beside the executor's next stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges_for(df: DataFrame, least: int = 4, most: int = 4096) -> int:
    """Number of key ranges for sums over a table: one per input split, so that a range stays of one size as the input grows.

    Each map task sends a row to each range, so there are at most ``most``; beyond it ranges grow with the distinct keys.
    """
    return min(max(df.rdd.getNumPartitions(), least), most)


def remainder(column: str, modulus: int):
    """crc32 of a column's text modulo ``modulus``; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def running(flags: np.ndarray) -> np.ndarray:
    """Number of true flags before each place, one longer than ``flags``."""
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True flags within each text."""
    return np.diff(running(flags)[offsets])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run values[bounds[i]:bounds[i+1]], each summed by itself."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def record_batch(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in ((columns[f.name], f) for f in schema)], schema=schema)
