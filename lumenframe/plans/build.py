"""Builds the design tensor: kernels, convolution, rebinning, one tile's rows at a time.

The templates and the rebinning operator, whose sizes the axes bound, go to every
task; the rows to build are a plain table, so tasks, retries and resumption are
Spark's.  A tile that is in the build log is not built again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spectral import convolve_arrays, guard_pixels, kernel_shifts, unit_kernel
from ..operators.support import pending
from ..sources.store import Store


def interpolation_matrix(grid: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(T, L) weights on the two grid points around each point."""
    j = np.clip(np.searchsorted(grid, points, side="right") - 1, 0, len(grid) - 2)
    w = (points - grid[j]) / (grid[j + 1] - grid[j])
    out = np.zeros((len(grid), len(points)))
    out[j, np.arange(len(points))] = 1 - w
    out[j + 1, np.arange(len(points))] += w
    return out


def check_coverage(template: np.ndarray, observed: np.ndarray, velocities: np.ndarray, pad: int) -> None:
    """Templates must reach beyond the data by the largest shift and the guard."""
    dlog = float(np.median(np.diff(template)))
    k = guard_pixels(float(np.abs(velocities).max()), dlog, pad)
    if template[0] > observed[0] - k * dlog + 1e-12 or template[-1] < observed[-1] + k * dlog - 1e-12:
        raise ValueError(f"templates must cover {k} pixels on either side of the data")


def models_of(losvd: DataFrame, templates: np.ndarray, template_log: np.ndarray, observed_log: np.ndarray, velocities: np.ndarray, tile_size: int = 128) -> DataFrame:
    """Rows (tile, s, c, p, m) of unit scale: max(0, convolution rebinned) for each histogram and population."""
    dlog = float(np.median(np.diff(template_log)))
    shifts = kernel_shifts(velocities, dlog)
    centre = int(np.searchsorted(shifts, 0))
    matrix = interpolation_matrix(template_log, observed_log)
    schema = pa.schema([("tile", pa.int32()), ("s", pa.int64()), ("c", pa.int32()), ("p", pa.int64()), ("m", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, c, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kernel = unit_kernel(np.array(h, dtype=float), velocities, shifts, dlog)
                m = np.maximum(convolve_arrays(templates, kernel, centre) @ matrix, 0.0).astype(np.float32)
                n = len(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s // tile_size), pa.int32()), pa.array(np.full(n, s), pa.int64()), pa.array(np.full(n, c), pa.int32()), pa.array(np.arange(n), pa.int64()), pa.array(list(m), pa.list_(pa.float32()))], schema=schema)

    return losvd.select(F.col("s").cast("long"), F.col("c").cast("int"), "h").mapInArrow(run, "tile int, s long, c int, p long, m array<float>")


def build(store: Store, pad: int = 64, tiles_at_once: int = 64) -> int:
    """Builds the tiles that are not yet in the log; the number of tiles built.

    Some tiles at a time are written and then logged, so that a build that is cut off goes on where it was.
    """
    if store.complete():
        return 0
    template_log, observed_log, velocities = (store.axis(n) for n in ("template", "observed", "velocity"))
    check_coverage(template_log, observed_log, velocities, pad)
    rows = store.table("templates").orderBy("p").select("flux").collect()  # populations x pixels: bounded by the grids
    templates = np.array([r["flux"] for r in rows])
    todo = sorted(r["tile"] for r in pending(store.tiles(), store.table("build_log"), ["tile"]).collect())  # a few thousand
    components = max(int(store.metadata().get("n_c", 1)), 1)
    for at in range(0, len(todo), tiles_at_once):
        some = todo[at : at + tiles_at_once]
        losvd = store.table("losvd").withColumn("tile", F.floor(F.col("s") / store.tile_size).cast("int")).where(F.col("tile").isin(some))
        # One task, and one file, for each component of a tile.
        spread = losvd.repartition(len(some) * components, "tile", "c").sortWithinPartitions("tile", "c", "s")
        store.write("models", models_of(spread, templates, template_log, observed_log, velocities, store.tile_size))
        store.write("build_log", store.spark.createDataFrame([(tile, 0, 0) for tile in some], "tile int, cb int, pb int"))
    store.set_metadata(complete=True, norm_mode="model")
    return len(todo)


def preflight(templates: np.ndarray, kernel: np.ndarray, centre: int) -> dict[str, float]:
    """How far the transform's convolution is from the direct one, and from flat for a flat spectrum inside."""
    fft = convolve_arrays(templates, kernel, centre)
    direct = np.stack([np.convolve(t, kernel)[centre : centre + len(t)] for t in templates])
    flat = convolve_arrays(np.ones((1, templates.shape[1])), kernel, centre)[0, len(kernel) : -len(kernel)]
    return {"relative": float(np.linalg.norm(fft - direct) / max(np.linalg.norm(direct), 1e-300)), "flat": float(np.abs(flat - 1).max(initial=0.0))}
