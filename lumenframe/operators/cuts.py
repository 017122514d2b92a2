"""Windows of features, cropped grids, candidates and scale factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_finite
from .aggregates import with_share
from .sampling import top_per_group


def standardised(df: DataFrame, value: str, inside: Column, by: Sequence[str] = ("s",), name: str = "z") -> DataFrame:
    """(value - mean) / deviation of the finite values inside the windows, for the rows there; 0 where they do not vary."""
    kept = df.where(inside & is_finite(value))
    told = kept.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return kept.join(told, list(by)).withColumn(name, z).drop("_mean", "_sd")


def cropped(axis: DataFrame, low: float, high: float, guard: int, step: float, coord: str = "coord") -> DataFrame:
    """The part of a grid between two coordinates and a guard of pixels beyond them; refuses a grid that does not reach so far."""
    lo, hi = low - guard * step, high + guard * step
    found = axis.agg(F.min(coord).alias("a"), F.max(coord).alias("b")).first()
    if found["a"] is None or found["a"] > lo + 1e-9 or found["b"] < hi - 1e-9:
        raise ValueError(f"the grid must cover {lo:g} to {hi:g}")
    return axis.where(F.col(coord).between(lo - 1e-9, hi + 1e-9))


def deepest(df: DataFrame, value: str, n: int, by: Sequence[str] = ("s",), order: str = "l") -> DataFrame:
    """The n lowest values of each group, the first of equals."""
    return top_per_group(df, list(by), n, F.asc(value), F.asc(order))


def candidates(gradients: DataFrame, per_component: int, tol: float = 1e-6) -> DataFrame:
    """Columns that the optimality conditions name, the most negative gradients of each component first, at most so many of each."""
    named = gradients.where((F.col("g") < -tol) & (F.col("x") <= 0))
    return top_per_group(named, ["c"], per_component, F.asc("g"), F.asc("p"))


def correlation_rank(gradients: DataFrame, k: int) -> DataFrame:
    """The k columns of each component most like the data: by correlation over length."""
    score = F.when(F.col("d") > 0, F.col("g") / F.sqrt("d")).otherwise(0.0)
    return top_per_group(gradients.withColumn("score", score), ["c"], k, F.desc("score"), F.asc("p"))


def component_scales(solution: DataFrame, energies: DataFrame, target: DataFrame, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Factor of each component that brings its share of the energy-weighted mass to the target's share, within bounds; 1 for an empty one."""
    mass = solution.join(energies, ["c", "p"]).groupBy("c").agg(F.sum(F.greatest(F.col("x"), F.lit(0.0)) * F.col("energy")).alias("mass"))
    joined = with_share(mass, "mass", [], "u").join(with_share(target, "w", [], "t").select("c", "t"), "c")
    return joined.select("c", F.when(F.col("u") > 0, F.least(F.greatest(F.col("t") / F.col("u"), F.lit(low)), F.lit(high))).otherwise(1.0).alias("scale"))


def shifted_scores(data: DataFrame, model: DataFrame, windows: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """Correlation of data and model within feature windows at each of a few shifts: (s, shift, score).

    Shifts multiply the rows of the windows only, by a short list; data and model meet by aperture and place.
    """
    inside = data.join(windows.select("s", "l"), ["s", "l"]).select("s", "l", "flux")
    moved = inside.select("*", F.explode(F.array(*(F.lit(int(k)) for k in shifts))).alias("shift"))
    pairs = moved.join(model.select("s", F.col("l").alias("_at"), "yhat"), (moved["l"] + moved["shift"] == F.col("_at")) & (moved["s"] == model["s"])).select(moved["s"], "shift", "flux", "yhat")
    return pairs.groupBy("s", "shift").agg(F.corr("flux", "yhat").alias("score"))
