"""Window operators along an ordered axis, always within a partition of one aperture or group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def boxcar(df: DataFrame, value: str, width: int, by: Sequence[str] = (), order: str = "l", name: str | None = None) -> DataFrame:
    """Moving sum over a centred odd width divided by the whole width: zeros beyond both ends."""
    h = width // 2
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-h, h)
    return df.withColumn(name or f"box{width}", F.sum(value).over(w) / width)


def detrend(df: DataFrame, value: str, width: int, by: Sequence[str] = (), order: str = "l", name: str = "detrended") -> DataFrame:
    """Value less its moving mean, the width made odd."""
    return boxcar(df, value, width | 1, by, order, "_trend").withColumn(name, F.col(value) - F.col("_trend")).drop("_trend")


def reflect_mean(df: DataFrame, value: str, width: int, size: int, by: Sequence[str] = (), order: str = "l", name: str = "smooth") -> DataFrame:
    """Moving mean with the ends mirrored (the edge value not repeated).  The axis runs from 0 to size - 1."""
    h = width // 2
    at = F.col(order)
    mirrored = F.array(at, F.when((at > 0) & (at <= h), -at), F.when((at < size - 1) & (at >= size - 1 - h), 2 * (size - 1) - at))
    wide = df.select(*by, value, F.explode(F.array_compact(mirrored)).alias("_at"))
    w = W.partitionBy(*by).orderBy("_at").rowsBetween(-h, h)
    return wide.withColumn(name, F.avg(value).over(w)).where(F.col("_at").between(0, size - 1)).withColumnRenamed("_at", order)


def steps(axis: DataFrame, coord: str = "coord", by: Sequence[str] = (), order: str = "idx") -> DataFrame:
    return axis.withColumn("step", F.col(coord) - F.lag(coord).over(W.partitionBy(*by).orderBy(order)))


def monotone(axis: DataFrame, coord: str = "coord", by: Sequence[str] = (), order: str = "idx") -> DataFrame:
    """Whether each axis increases strictly, and its median step."""
    return steps(axis, coord, by, order).groupBy(*by).agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("increasing"), F.median("step").alias("median_step"), F.count("*").alias("n"))


def cumulative(df: DataFrame, value: str, by: Sequence[str] = (), order: str = "v", name: str = "cdf") -> DataFrame:
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("_run", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(name, F.col("_run") / F.sum(value).over(W.partitionBy(*by))).drop("_run")


def islands(df: DataFrame, flag: Column, by: Sequence[str] = (), order: str = "l") -> DataFrame:
    """Runs of neighbouring places where the flag holds: first, last, size."""
    w = W.partitionBy(*by).orderBy(order)
    runs = df.where(flag).withColumn("_run", F.col(order) - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size")).drop("_run")


def dilate(df: DataFrame, flag: Column, half: int, by: Sequence[str] = (), order: str = "l", name: str = "near") -> DataFrame:
    """Marks the places within ``half`` of one where the flag holds."""
    w = W.partitionBy(*by).orderBy(order).rangeBetween(-half, half)
    return df.withColumn(name, F.max(flag.cast("int")).over(w) == 1)


def parabola_peak(scores: DataFrame, by: Sequence[str] = (), order: str = "k", score: str = "score") -> DataFrame:
    """Place of the largest score, moved to the top of the parabola through it and its neighbours; between equals the first."""
    w = W.partitionBy(*by).orderBy(order)
    near = scores.withColumns({"_a": F.lag(score).over(w), "_b": F.lead(score).over(w)})
    best = near.groupBy(*by).agg(F.max_by(F.struct(order, score, "_a", "_b"), F.struct(F.col(score), -F.col(order))).alias("t"))
    a, s, b = F.col("t._a"), F.col(f"t.{score}"), F.col("t._b")
    bend = a - 2 * s + b
    shift = F.when(a.isNull() | b.isNull() | (F.abs(bend) < 1e-30), 0.0).otherwise(0.5 * (a - b) / bend)
    return best.select(*by, F.col(f"t.{order}").alias("lag"), s.alias("score"), (F.col(f"t.{order}") + F.least(F.greatest(shift, F.lit(-0.5)), F.lit(0.5))).alias("peak"))


def ranked(df: DataFrame, by: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def smoothing_weights(data: DataFrame, narrow: int = 7, wide: int = 31, keep: Column | None = None, low: float = 0.2, power: float = 0.9, floor: float = 1e-6) -> DataFrame:
    """Weight of each wavelength by how much the median spectrum changes there: narrow less wide boxcar over its 95th percentile.

    The median spectrum has one row for each wavelength, so the windows over it are small whatever the data.
    """
    keep = keep if keep is not None else F.lit(True)
    spectrum = data.groupBy("l").agg(F.median("flux").alias("med")).withColumn("keep", keep).withColumn("med", F.when(F.col("keep"), F.col("med")).otherwise(0.0))
    both = boxcar(boxcar(spectrum, "med", narrow, name="a"), "med", max(wide, narrow + 2), name="b").withColumn("d", F.abs(F.col("a") - F.col("b")))
    q = both.where("d > 0").agg(F.coalesce(F.percentile("d", F.lit(0.95)), F.lit(1.0)).alias("q"))
    z = F.least(F.greatest(F.col("d") / (F.col("q") + 1e-12), F.lit(0.0)), F.lit(1.0))
    weight = F.when(F.col("keep"), F.lit(low) + (1 - low) * F.pow(z, F.lit(power))).otherwise(0.0)
    return both.crossJoin(F.broadcast(q)).select("l", F.col("med"), F.least(F.greatest(weight, F.lit(floor)), F.lit(1.0)).alias("weight"))
