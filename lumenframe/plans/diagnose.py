"""Checks and reports on a store, before and after a fit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_finite
from ..operators.aggregates import amplitude, moments
from ..operators.columns import best_and_median_cosine, template_cosines, triage
from ..operators.spectral import guard_pixels, kernel_shifts, unit_kernel
from ..sources.store import Store
from .build import interpolation_matrix, preflight
from .descend import System, _frozen
from .serve import issues

#: How far a convolution may be from the direct one, and from flat.
MOST_RELATIVE, MOST_FLAT = 2e-3, 3e-8


def gate(store: Store) -> None:
    """Raises unless the build is complete and no table has an issue."""
    if not store.complete():
        raise ValueError("the build is not complete")
    found = issues(store).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r[0]}: {r[1]} at {r[2]}" for r in found))


def convolution_gate(store: Store, s: int, c: int, populations: int = 4) -> dict[str, float]:
    """The preflight on one histogram and some templates of the store; raises beyond the bounds."""
    template, velocities = store.axis("template"), store.axis("velocity")
    step = float(np.median(np.diff(template)))
    rows = store.table("losvd").where((F.col("s") == s) & (F.col("c") == c)).collect()
    if not rows:
        raise ValueError(f"no histogram for aperture {s}, component {c}")
    shifts = kernel_shifts(velocities, step)
    kernel = unit_kernel(np.array(rows[0]["h"], dtype=float), velocities, shifts, step)
    fluxes = np.array([r["flux"] for r in store.table("templates").orderBy("p").limit(populations).collect()])
    found = preflight(fluxes, kernel, int(np.searchsorted(shifts, 0)))
    if found["relative"] > MOST_RELATIVE or found["flat"] > MOST_FLAT:
        raise ValueError(f"the convolution is off: {found}")
    return found


def column_energies(store: Store, strict: bool = True) -> DataFrame:
    """The stored energies of columns; with ``strict`` there must be one for each column of the tensor, finite and not negative."""
    table = store.table("column_stats")
    if strict:
        bad = table.where(~is_finite("energy") | (F.col("energy") < 0)).limit(1).collect()
        if bad:
            raise ValueError(f"energy of column {bad[0]['c'], bad[0]['p']} is not finite and positive")
        meta = store.metadata()
        expected = int(meta.get("n_c", 0)) * int(np.prod(meta.get("pop_shape", [0])))
        found = table.select("c", "p").distinct().count()
        if found != expected:
            raise ValueError(f"{found} columns have an energy, {expected} are expected")
    return table.select("c", "p", "energy")


def wavelength_checks(store: Store, s: int, populations: Sequence[int] | None = None) -> DataFrame:
    """One row: whether the axes rise, how far the templates reach beyond the data, the rebinning's largest error on a constant, and which template is most like the spectrum."""
    template, observed, velocities = (store.axis(n) for n in ("template", "observed", "velocity"))
    step = float(np.median(np.diff(template)))
    need = guard_pixels(float(np.abs(velocities).max()), step, 0)
    constant = float(np.abs(np.ones(len(template)) @ interpolation_matrix(template, observed) - 1).max())
    table = store.table("templates") if populations is None else store.table("templates").where(F.col("p").isin(list(populations)))
    matrix = interpolation_matrix(template, observed)
    fluxes = table.select("p", "flux").collect()  # bounded by the grids
    rows = [(int(r["p"]), l, float(v)) for r in fluxes for l, v in enumerate(np.array(r["flux"]) @ matrix)]
    templates = store.spark.createDataFrame(rows, "p long, l long, m double")
    kept = store.mask().where("keep").select(F.col("l").cast("long").alias("l"))
    data = store.spectrum(s).select("s", F.posexplode("flux").alias("l", "flux")).withColumn("l", F.col("l").cast("long")).join(kept, "l").where(is_finite("flux"))
    best = best_and_median_cosine(template_cosines(data, templates))
    told = (bool((np.diff(template) > 0).all() and (np.diff(observed) > 0).all()), float((observed[0] - template[0]) / step - need), float((template[-1] - observed[-1]) / step - need), constant)
    one = store.spark.createDataFrame([told], "rising boolean, spare_left double, spare_right double, constant_error double")
    return one.crossJoin(F.broadcast(best))  # one row each


def projector_test(system: System, seed: int = 7) -> float:
    """How far <A x, r> is from <x, A' r> for random weights and the data as r, relative to their size: the two passes must be each other's transpose."""
    x = np.random.default_rng(seed).random(len(system.columns))
    errors = system.residual(np.zeros(len(system.columns)))
    g, _ = system.gradient(errors)
    add = lambda s, v: s + v
    product = F.aggregate(F.zip_with(F.zip_with("r", "w", lambda r, w: r * w), "yhat", lambda r, y: r * y), F.lit(0.0), add)
    left = errors.join(system.predict(x), "s").select(product.alias("a")).agg(F.sum("a")).first()[0] or 0.0
    return float(abs(left - x @ g) / max(abs(left), abs(float(x @ g)), 1e-300))


def solution_report(system: System, x: np.ndarray) -> dict[str, float]:
    """A seed judged as a solution: error, best common factor and the error with it, columns in use, share of the largest component."""
    used = np.maximum(x, 0.0)
    errors, add = system.residual(np.zeros(len(system.columns))), lambda s, v: s + v
    joined = errors.join(system.predict(used), "s")
    cross = F.aggregate(F.zip_with(F.zip_with("r", "w", lambda r, w: r * w), "yhat", lambda r, y: r * y), F.lit(0.0), add)
    own = F.aggregate(F.zip_with(F.zip_with("yhat", "w", lambda y, w: y * w), "yhat", lambda a, b: a * b), F.lit(0.0), add)
    a, b = joined.select(cross.alias("a"), own.alias("b")).agg(F.sum("a"), F.sum("b")).first()
    alpha = float(a / b) if a is not None and b else 0.0
    mass = np.array([used[system.columns.c == c].sum() for c in np.unique(system.columns.c)])
    return {
        "rmse": system.error(system.residual(used)), "alpha": alpha, "rmse_scaled": system.error(system.residual(alpha * used)), "n_used": float((used > 0).sum()),
        "negative": float((x < 0).sum()), "largest_share": float(mass.max() / mass.sum()) if mass.sum() > 0 else 0.0,
    }


def probe_tile(system: System, tile: int, x: np.ndarray, trust: float = 0.5) -> dict[str, float]:
    """What a solver would do on one tile: its error and length, frozen columns, size of the step and of the part that the trust region leaves."""
    part = system.of_tiles([tile])
    errors = part.residual(x)
    g, d = part.gradient(errors)
    frozen = _frozen(d, part.columns.c, 1e-6)
    dx = np.where(frozen, 0.0, np.maximum(g / np.maximum(d, 1e-24), -x))
    size, norm = float(np.sqrt(np.sum(dx * dx * d))), part.norm()
    return {"rmse": part.error(errors), "norm": norm, "frozen": float(frozen.sum()), "step": size, "scale": min(1.0, trust * norm / size) if size > 0 else 1.0, "rising": float((g > 0).sum())}


def inspect(store: Store, apertures: Sequence[int]) -> DataFrame:
    """Per aperture and component: amplitude, mean velocity and dispersion of the histogram, and least, mean and largest flux of its models."""
    velocity = store.spark.createDataFrame([(i, float(v)) for i, v in enumerate(store.axis("velocity"))], "i int, v double")
    rows = store.table("losvd").where(F.col("s").isin(list(apertures))).select("s", "c", F.posexplode("h").alias("i", "h")).join(F.broadcast(velocity), "i")  # one axis
    total = F.aggregate("m", F.lit(0.0), lambda a, v: a + v.cast("double"))
    tiles = sorted({s // store.tile_size for s in apertures})
    models = store.table("models").where(F.col("tile").isin(tiles) & F.col("s").isin(list(apertures))).select("s", "c", total.alias("flux"))
    fluxes = models.groupBy("s", "c").agg(F.count("*").alias("models"), F.min("flux").alias("least"), F.avg("flux").alias("mean_flux"), F.max("flux").alias("largest"))
    return amplitude(rows, "sum").join(moments(rows), ["s", "c"], "left").join(fluxes, ["s", "c"], "left")


def weight_triage(store: Store, name: str) -> DataFrame:
    """Least, median, largest and finite weights of a saved solution."""
    return triage(store.table("solution").where(F.col("run_id") == name), "x")


def metrics(events: DataFrame) -> DataFrame:
    """(epoch, rmse) of a fit from its events: the last end of each epoch; where there are none, as in older runs, the mean of each epoch's batches."""
    ends = events.where("op = 'epoch_end'").groupBy("epoch").agg(F.max_by("value", "seq").alias("rmse"))
    batches = events.where("op = 'rmse_batch'").groupBy("epoch").agg(F.avg("value").alias("mean"))
    return batches.join(ends, "epoch", "full").select("epoch", F.coalesce("rmse", "mean").alias("rmse"))
