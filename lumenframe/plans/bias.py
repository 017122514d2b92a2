"""Velocity offsets between data and models, before a build and after a fit, and bounds of the templates that a build needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import LIGHT_SPEED
from ..operators.aggregates import amplitude, weighted_stack
from ..operators.sampling import spaced_peaks
from ..operators.spectral import best_shift, convolve_arrays, guard_pixels, inverse_cdf, kernel_shifts, unit_kernel
from ..operators.windows import detrend, dilate, parabola_peak, reflect_mean
from ..sources.store import Store
from .build import interpolation_matrix


def reference_spectrum(store: Store) -> np.ndarray:
    """What the mean template looks like through the stacked velocity histograms: as long as the observed axis."""
    template_log, observed_log, velocities = (store.axis(n) for n in ("template", "observed", "velocity"))
    long = store.table("losvd").select("s", "c", F.posexplode("h").alias("v", "h"))
    stacked = weighted_stack(long, amplitude(long)).groupBy("v").agg(F.sum("h").alias("h"))
    h = np.zeros(len(velocities))
    for r in stacked.collect():  # one row for each velocity
        h[r["v"]] = r["h"] or 0.0
    mean = store.table("templates").select(F.posexplode("flux").alias("t", "x")).groupBy("t").agg(F.avg("x").alias("x")).orderBy("t").collect()
    dlog = float(np.median(np.diff(template_log)))
    shifts = kernel_shifts(velocities, dlog)
    kernel = unit_kernel(h, velocities, shifts, dlog)
    spectrum = convolve_arrays(np.array([[r["x"] for r in mean]]), kernel, int(np.searchsorted(shifts, 0)))
    return (spectrum @ interpolation_matrix(template_log, observed_log))[0]


def offset_before_build(store: Store, width: int = 31, lags: int = 12) -> float:
    """Median shift of the detrended data against the reference, in km/s."""
    reference = reference_spectrum(store)
    rows = store.spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(reference)], "g int, l long, m double")
    template = detrend(rows, "m", width, ["g"], name="d").select("l", F.col("d").alias("m"))
    data = store.table("spectra").select("s", F.posexplode("flux").alias("l", "flux")).withColumn("l", F.col("l").cast("long"))
    flat = detrend(data, "flux", width, ["s"], name="d").select("s", "l", F.col("d").alias("flux"))
    shift = best_shift(flat, template, lags).agg(F.median("peak")).first()[0] or 0.0
    dlog = float(np.median(np.diff(store.axis("observed"))))
    return LIGHT_SPEED * float(np.expm1(shift * dlog))


def offset_from_features(data: DataFrame, models: DataFrame, dlog: float, size: int, features: int = 24, half: int = 15, lags: int = 6, smooth: int = 7) -> float:
    """Shift of data (s, l, flux) against models (s, l, yhat) around the deepest features, in km/s.

    Both are standardised within the windows; the scores of all apertures are summed for each lag.
    """
    flat = reflect_mean(data, "flux", smooth, size, ["s"]).select("s", "l", F.col("smooth").alias("flux"))
    centres = spaced_peaks(flat, ["s"], features, half, "l", "flux").select("s", "l", F.lit(True).alias("centre"))
    marked = dilate(flat.join(centres, ["s", "l"], "left"), F.coalesce("centre", F.lit(False)), half, ["s"])
    both = marked.select("s", "l", "flux", "near").join(models, ["s", "l"])
    w = W.partitionBy("s")
    inside = both.where("near").withColumns({"y": (F.col("flux") - F.avg("flux").over(w)) / F.stddev_pop("flux").over(w), "m": (F.col("yhat") - F.avg("yhat").over(w)) / F.stddev_pop("yhat").over(w)})
    shifted = inside.select("s", "m", F.explode(F.sequence(F.lit(-lags), F.lit(lags)).cast("array<long>")).alias("k"), "l").select("s", "m", "k", (F.col("l") + F.col("k")).alias("l"))
    scores = inside.select("s", "l", "y").join(shifted, ["s", "l"]).groupBy("k").agg((F.sum(F.col("y") * F.col("m")) / F.count("*")).alias("score")).withColumn("g", F.lit(0))
    peak = parabola_peak(scores, ["g"]).first()
    return LIGHT_SPEED * float(np.expm1(dlog * peak["peak"])) if peak else 0.0


def template_bounds(store: Store, low: float = 0.001, high: float = 0.999, pad: int = 64) -> tuple[float, float]:
    """The least range of log wavelength that templates need for all but the outermost velocities."""
    velocities, observed, template = (store.axis(n) for n in ("velocity", "observed", "template"))
    marginal = store.table("losvd").select(F.posexplode("h").alias("v", "h")).groupBy("v").agg(F.sum("h").alias("h"))
    ends = [r["x"] for r in inverse_cdf(marginal, [low, high]).orderBy("q").collect()]
    reach = max(abs(float(np.interp(x, np.arange(len(velocities)), velocities))) for x in ends) if ends else float(np.abs(velocities).max())
    dlog = float(np.median(np.diff(template)))
    k = guard_pixels(reach, dlog, pad)
    return float(observed[0] - k * dlog), float(observed[-1] + k * dlog)
