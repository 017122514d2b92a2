"""Normalisation of models and mixtures of components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import with_share


def data_scale(amplitudes: DataFrame, flux: DataFrame) -> DataFrame:
    """Scale of a component in an aperture in data mode: its share of the aperture's amplitude times the aperture's mean flux; 0 without either."""
    joined = with_share(amplitudes, "amp", ["s"]).join(flux, "s")
    return joined.select("s", "c", F.when(F.col("mean") > 0, F.col("share") * F.col("mean")).otherwise(0.0).alias("scale"))


def convert_factor(amplitude_totals: DataFrame, flux: DataFrame, to: str) -> DataFrame:
    """Factor of each aperture between the modes; 1 where it would not be finite and positive."""
    if to not in ("model", "data"):
        raise ValueError(f"no such mode: {to}")
    joined = amplitude_totals.join(flux, "s")
    up, down = F.col("total"), F.col("mean")
    f = up / F.greatest(down, F.lit(1e-30)) if to == "model" else down / F.greatest(up, F.lit(1e-30))
    return joined.select("s", F.when((f > 0) & (f < float("inf")), f).otherwise(1.0).alias("factor"))


def convert_models(models: DataFrame, factors: DataFrame) -> DataFrame:
    """Models, long (m) or dense (m array), times the factor of their aperture; an aperture without one is left as it is."""
    f = F.coalesce("factor", F.lit(1.0))
    dense = models.schema["m"].dataType.typeName() == "array"
    value = F.transform("m", lambda v: v * f) if dense else F.col("m") * f
    kind = models.schema["m"].dataType
    return models.join(factors.select("s", "factor"), "s", "left").withColumn("m", value.cast(kind)).select(*models.columns)


def unit_sum(df: DataFrame, value: str, by: list[str] | None = None, name: str = "unit") -> DataFrame:
    return with_share(df, value, by or [], name)


def usage(solution: DataFrame, energies: DataFrame | None = None) -> DataFrame:
    """Mass of each component, or its energy-weighted mass; negatives count as 0."""
    if energies is None:
        return solution.groupBy("c").agg(F.greatest(F.sum("x"), F.lit(0.0)).alias("usage"))
    return solution.join(energies, ["c", "p"]).groupBy("c").agg(F.greatest(F.sum(F.col("x") * F.col("energy")), F.lit(0.0)).alias("usage"))


def project_to_mix(solution: DataFrame, target: DataFrame, energies: DataFrame | None = None, beta: float = 0.2, least: float = 1e-12) -> DataFrame:
    """One step of each component's weights toward a target mix: x <- (1 - beta) x + beta F_c x, F_c = t_c S / s_c."""
    t = unit_sum(target.select("c", F.greatest("w", F.lit(least)).alias("w")), "w", name="t")
    s = usage(solution, energies)
    joined = with_share(s, "usage", [], "u").join(t, "c").withColumn("f", F.when(F.col("u") > 0, F.col("t") / F.col("u")).otherwise(1.0))
    return solution.join(joined.select("c", "f"), "c").select("c", "p", F.greatest((1 - beta) * F.col("x") + beta * F.col("f") * F.col("x"), F.lit(0.0)).alias("x"))


def softbox(solution: DataFrame, target: DataFrame, energies: DataFrame | None = None, band: float = 0.3, step: float = 0.2) -> DataFrame:
    """Draws the mass of a component part of the way back into a band around its target; inside the band nothing changes."""
    s = with_share(usage(solution, energies), "usage", [], "u").join(unit_sum(target, "w", name="t"), "c")
    t = F.greatest("t", F.lit(1e-10))
    f = F.when(F.col("u") > (1 + band) * t, (1 - step) + step * (1 + band) * t / F.col("u")).when((F.col("u") < (1 - band) * t) & (F.col("u") > 0), (1 - step) + step * (1 - band) * t / F.col("u")).otherwise(1.0)
    return solution.join(s.select("c", f.alias("f")), "c").select("c", "p", (F.col("x") * F.col("f")).alias("x"))


def softbox_schedule(epoch: int, epochs: int, first: tuple[float, float] = (0.30, 0.20), last: tuple[float, float] = (0.15, 0.30)) -> tuple[float, float]:
    """Band and step from the first to the last epoch along half a cosine."""
    part = 0.0 if epochs <= 1 else min(max((epoch - 1) / (epochs - 1), 0.0), 1.0)
    part = 0.5 * (1 - math.cos(math.pi * part))
    return tuple(a + (b - a) * part for a, b in zip(first, last, strict=True))


def ratio_update(solution: DataFrame, target: DataFrame, eta: float = 0.8, gamma: float = 1.3) -> DataFrame:
    """Multiplies components toward a target mix, at most by gamma, and restores the total mass."""
    s = with_share(usage(solution), "usage", [], "u").join(unit_sum(target, "w", name="t"), "c")
    raw = F.exp(-eta * (F.log(F.greatest("u", F.lit(1e-12))) - F.log(F.greatest("t", F.lit(1e-12)))))
    f = s.select("c", "u", F.least(F.greatest(raw, F.lit(1 / gamma)), F.lit(gamma)).alias("f"))
    mass = f.agg(F.sum(F.col("u") * F.col("f")).alias("mass"))
    return solution.join(f, "c").crossJoin(F.broadcast(mass)).select("c", "p", (F.col("x") * F.col("f") / F.col("mass")).alias("x"))
