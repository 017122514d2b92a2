"""Spectral axes: bin edges, rebinning operators, kernels, convolution, shifts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import cumulative, parabola_peak


def bin_edges(axis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges of bins around centres: midpoints, the outer ones as far out as the inner ones are in."""
    w = W.partitionBy(*by).orderBy("idx")
    before, after = F.lag("coord").over(w), F.lead("coord").over(w)
    lo = F.when(before.isNull(), F.col("coord") - (after - F.col("coord")) / 2).otherwise((before + F.col("coord")) / 2)
    hi = F.when(after.isNull(), F.col("coord") + (F.col("coord") - before) / 2).otherwise((after + F.col("coord")) / 2)
    return axis.withColumns({"lo": lo, "hi": hi})


def overlap_operator(old: DataFrame, new: DataFrame, bucket: float | None = None) -> DataFrame:
    """Flux-conserving weights (t, l, w): the share of each new bin that an old bin covers.

    A range join.  With a ``bucket`` width both sides are laid out over the buckets they touch and meet by bucket, so
    that it is a hash join; a pair counts in the bucket where its overlap begins.
    """
    a = old.select(F.col("idx").alias("t"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    n = new.select(F.col("idx").alias("l"), F.col("lo").alias("u"), F.col("hi").alias("v"))
    meets = (F.col("a") < F.col("v")) & (F.col("u") < F.col("b"))
    if bucket:
        cell = lambda x: F.floor(F.col(x) / bucket)
        a = a.withColumn("k", F.explode(F.sequence(cell("a"), cell("b"))))
        n = n.withColumn("k", F.explode(F.sequence(cell("u"), cell("v"))))
        pairs = a.join(n, "k").where(meets & (F.col("k") == F.floor(F.greatest("a", "u") / bucket)))
    else:
        pairs = a.join(n, meets)
    return pairs.select("t", "l", ((F.least("b", "v") - F.greatest("a", "u")) / (F.col("v") - F.col("u"))).alias("w"))


def interpolation_operator(grid: DataFrame, points: DataFrame) -> DataFrame:
    """Linear interpolation weights (t, l, w) on the two grid points around each new point; the end pairs reach beyond the grid.

    An as-of join by windows over the union of both axes, which are single spectra's axes.
    """
    n = grid.agg(F.max("idx").alias("last"))
    both = grid.select(F.col("coord"), F.col("idx").alias("t"), F.lit(None).cast("long").alias("l"), F.lit(0).alias("side")).unionByName(points.select("coord", F.lit(None).cast("long").alias("t"), F.col("idx").alias("l"), F.lit(1).alias("side")))
    at = F.last("t", True).over(W.orderBy("coord", "side").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("j", at).where("side = 1").crossJoin(F.broadcast(n)).select("l", "coord", F.least(F.greatest(F.coalesce("j", F.lit(0)), F.lit(0)), F.col("last") - 1).alias("j"))
    left = grid.select(F.col("idx").alias("j"), F.col("coord").alias("x0"))
    right = grid.select((F.col("idx") - 1).alias("j"), F.col("coord").alias("x1"))
    w1 = (F.col("coord") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    rows = placed.join(left, "j").join(right, "j").select("l", F.explode(F.array(F.struct(F.col("j").alias("t"), (1 - w1).alias("w")), F.struct((F.col("j") + 1).alias("t"), w1.alias("w")))).alias("r"))
    return rows.select(F.col("r.t").cast("long").alias("t"), "l", F.col("r.w").alias("w"))


def inverse_cdf(density: DataFrame, points: Sequence[float], by: Sequence[str] = (), v: str = "v", h: str = "h") -> DataFrame:
    """Where the cumulative share of a histogram, linearly interpolated between its places, reaches each point."""
    c = cumulative(density, h, by, v)
    w = W.partitionBy(*by).orderBy(v)
    c = c.withColumns({"c0": F.lag("cdf").over(w), "v0": F.lag(v).over(w)})
    rows = c.withColumn("q", F.explode(F.array(*map(F.lit, points))))
    inside = rows.where((F.col("cdf") >= F.col("q")) & (F.col("c0").isNull() | (F.col("c0") < F.col("q"))))
    x = F.when(F.col("c0").isNull(), F.col(v)).otherwise(F.col("v0") + (F.col("q") - F.col("c0")) / (F.col("cdf") - F.col("c0")) * (F.col(v) - F.col("v0")))
    return inside.select(*by, "q", x.alias("x"))


def unit_kernel(h: np.ndarray, velocities: np.ndarray, shifts: np.ndarray, dlog: float, light: float = 299792.458) -> np.ndarray:
    """A histogram read at the velocities of whole pixel shifts: clipped at 0, unit sum; the centre alone if nothing is left."""
    at = light * np.expm1(shifts * dlog)
    k = np.interp(at, velocities, h, left=0.0, right=0.0)
    k[at >= velocities[-1]] = 0.0
    k = np.maximum(np.where(np.isfinite(k), k, 0.0), 0.0)
    if k.sum() <= 0:
        k = (shifts == 0).astype(float)
    return k / k.sum()


def kernel_shifts(velocities: np.ndarray, dlog: float, light: float = 299792.458) -> np.ndarray:
    low, high = np.log1p(velocities[0] / light) / dlog, np.log1p(velocities[-1] / light) / dlog
    return np.arange(int(np.floor(low)), int(np.ceil(high)) + 1)


def convolve_direct(values: DataFrame, kernel: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """y[n] = sum over k of h[k] x[n - k] for rows (keys, t, value) and a kernel (k, h), zero beyond the axis: a join and a sum."""
    spread = values.crossJoin(F.broadcast(kernel)) if "k" in kernel.columns and not set(kernel.columns) & set(keys) else values.join(kernel, [c for c in kernel.columns if c in keys])
    shifted = spread.withColumn("n", F.col("t") + F.col("k")).where(F.col("n").between(0, size - 1))
    return shifted.groupBy(*keys, F.col("n").alias("t")).agg(F.sum(F.col("value") * F.col("h")).alias("value"))


def convolve_arrays(arrays: np.ndarray, kernel: np.ndarray, centre: int) -> np.ndarray:
    """The same for rows of arrays, by Fourier transforms."""
    n = arrays.shape[1]
    size = 1 << (n + len(kernel) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(arrays, size) * np.fft.rfft(kernel, size), size)
    return full[:, centre : centre + n]


def convolve_fft(dense: DataFrame, key: str, array: str, shifts: Sequence[int], weights: Sequence[float]) -> DataFrame:
    """Rows (key, array) convolved with one kernel of whole-pixel shifts; a row is one spectrum, a batch one transform."""
    kernel = np.zeros(max(shifts) - min(shifts) + 1)
    for k, h in zip(shifts, weights, strict=True):
        kernel[k - min(shifts)] += h
    centre = -min(shifts)
    kind = dense.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                out = convolve_arrays(flat[np.repeat(sizes == width, sizes)].reshape(len(rows), width), kernel, centre)
                yield pa.RecordBatch.from_pydict({key: batch.column(0).take(pa.array(rows)), "value": pa.array(list(out), pa.list_(pa.float64()))})

    return dense.select(key, array).mapInArrow(run, f"{key} {kind}, value array<double>")


def fractional_shift(arrays: np.ndarray, shift: float) -> np.ndarray:
    """Circular shift by part of a pixel."""
    n = arrays.shape[-1]
    return np.fft.irfft(np.fft.rfft(arrays) * np.exp(-2j * np.pi * np.fft.rfftfreq(n) * shift), n)


def best_shift(data: DataFrame, template: DataFrame, lags: int, by: str = "s") -> DataFrame:
    """Lag of the largest normalised product of each spectrum with one template, refined by a parabola; between equals the first."""
    k = template.withColumn("k", F.explode(F.sequence(F.lit(-lags), F.lit(lags)).cast("array<long>"))).select((F.col("l") + F.col("k")).alias("l"), "k", "m")
    joined = data.join(k, "l").groupBy(by, "k").agg(F.sum(F.col("flux") * F.col("m")).alias("xy"), F.sum(F.col("flux") * F.col("flux")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("yy"))
    scores = joined.withColumn("score", F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0))
    return parabola_peak(scores, [by])


def guard_pixels(v_max: float, dlog: float, pad: int = 64, light: float = 299792.458) -> int:
    return int(np.ceil(np.log1p(abs(v_max) / light) / dlog)) + pad


def literal_axis(spark: SparkSession, coords: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(coords)], "idx long, coord double")
