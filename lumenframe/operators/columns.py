"""Scales, triage and cuts of a design tensor's columns and of the maps that come from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite_or, is_finite


def finite_weights(data: DataFrame, value: str = "flux") -> DataFrame:
    """Values that are not finite become 0 with weight 0; all others weigh 1."""
    ok = is_finite(value)
    return data.withColumns({value: F.when(ok, F.col(value)).otherwise(0.0), "weight": F.when(ok, 1.0).otherwise(0.0)})


def weighted_system(models: DataFrame, data: DataFrame, weights: DataFrame, by: str = "l") -> tuple[DataFrame, DataFrame]:
    """Both sides of the least-squares problem times the square root of the weight of their wavelength."""
    root = weights.select(by, F.sqrt(F.greatest("weight", F.lit(0.0))).alias("_w"))
    return (
        models.join(root, by).withColumn("m", F.col("m") * F.col("_w")).drop("_w"),
        data.join(root, by).withColumn("flux", F.col("flux") * F.col("_w")).drop("_w"),
    )


def to_unit_flux(models: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns divided by their reference flux; one without any is left as it is."""
    ref = F.coalesce(F.when(F.col("flux_ref") > 0, F.col("flux_ref")), F.lit(1.0))
    return models.join(reference.select("c", "p", "flux_ref"), ["c", "p"], "left").withColumn("m", F.col("m") / ref).drop("flux_ref")


def from_unit_flux(weights: DataFrame, reference: DataFrame) -> DataFrame:
    """Weights of the columns as they were before to_unit_flux()."""
    ref = F.coalesce(F.when(F.col("flux_ref") > 0, F.col("flux_ref")), F.lit(1.0))
    return weights.join(reference.select("c", "p", "flux_ref"), ["c", "p"], "left").withColumn("x", F.col("x") / ref).drop("flux_ref")


def column_norms(models: DataFrame, by: Sequence[str] = ("c", "p")) -> DataFrame:
    m = finite_or("m")
    return models.groupBy(*by).agg(F.sqrt(F.sum(m * m)).alias("norm"))


def to_unit_norm(models: DataFrame, norms: DataFrame, by: Sequence[str] = ("c", "p")) -> DataFrame:
    """Columns of length one; an empty column stays empty."""
    return models.join(norms, list(by)).withColumn("m", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0)).drop("norm")


def from_unit_norm(weights: DataFrame, norms: DataFrame, by: Sequence[str] = ("c", "p")) -> DataFrame:
    return weights.join(norms, list(by)).withColumn("x", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0)).drop("norm")


def column_triage(models: DataFrame, data: DataFrame, by: Sequence[str] = ("s", "l"), tiny: float = 1e-12) -> DataFrame:
    """One row: columns, those without length, those that correlate positively with the data, least and largest length."""
    joined = models.join(data.select(*by, "flux"), list(by))
    sums = joined.groupBy("c", "p").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.sum(F.col("m") * F.col("flux")).alias("corr"))
    return sums.agg(
        F.count("*").alias("n_columns"), F.count_if(F.col("norm") <= tiny).alias("n_zero"), F.count_if(F.col("corr") > 0).alias("n_positive"),
        F.min("norm").alias("least_norm"), F.max("norm").alias("largest_norm"),
    )


def triage(df: DataFrame, value: str) -> DataFrame:
    """One row: least, median and largest finite value, and how many are finite of how many."""
    v = F.when(is_finite(value), F.col(value))
    return df.agg(F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("largest"), F.count(v).alias("n_finite"), F.count("*").alias("n"))


def gradient_summary(gradients: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: quantiles of the positive diagonal, lengths of the gradient and of the weights, columns in use."""
    joined = gradients.join(weights.select("c", "p", "x"), ["c", "p"], "left")
    d = F.when((F.col("d") > 0) & is_finite("d"), F.col("d"))
    return joined.agg(
        F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"),
        F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("g_norm"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("x_norm"), F.count_if(F.col("x") > 0).alias("n_used"),
    ).select(*(F.col("q")[k].alias(n) for k, n in enumerate(("d10", "d50", "d90"))), "g_norm", "x_norm", "n_used")


def active_per_tile(support: DataFrame, flag: Column) -> DataFrame:
    """One row: tiles, mean and least number of active components in a tile."""
    per_tile = support.groupBy("tile").agg(F.count_if(flag).alias("n"))
    return per_tile.agg(F.count("*").alias("tiles"), F.avg("n").alias("mean_active"), F.min("n").alias("least_active"))


def largest_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: the largest distance between two copies of a table, a row that one of them lacks counting as 0, and how many rows that is."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    return joined.agg(F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("delta"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))


def template_cosines(data: DataFrame, templates: DataFrame, on: str = "l") -> DataFrame:
    """Cosine of each spectrum (s, l, flux) with each template (p, l, m) over the places that both have."""
    joined = data.join(templates.select("p", on, "m"), on)
    sums = joined.groupBy("s", "p").agg(F.sum(F.col("flux") * F.col("m")).alias("a"), F.sum(F.col("flux") * F.col("flux")).alias("b"), F.sum(F.col("m") * F.col("m")).alias("d"))
    return sums.select("s", "p", F.when((F.col("b") > 0) & (F.col("d") > 0), F.col("a") / F.sqrt(F.col("b") * F.col("d"))).otherwise(0.0).alias("cosine"))


def best_and_median_cosine(cosines: DataFrame) -> DataFrame:
    """Per spectrum the template most like it (the first of equals) and the median over templates."""
    return cosines.groupBy("s").agg(F.max("cosine").alias("best"), F.max_by("p", F.struct("cosine", -F.col("p"))).alias("best_p"), F.median("cosine").alias("median"))


def chi_square(residuals: DataFrame, weight: str = "weight", by: Sequence[str] = ("s",)) -> DataFrame:
    """Root mean square, weighted sum of squares and weight of each aperture in one pass."""
    r, w = finite_or("r"), F.when(is_finite("r"), F.col(weight)).otherwise(0.0)
    sums = residuals.groupBy(*by).agg(F.sum(w * r * r).alias("chi2"), F.sum(w).alias("weight"))
    return sums.withColumn("rmse", F.when(F.col("weight") > 0, F.sqrt(F.col("chi2") / F.col("weight"))).otherwise(float("inf")))


def relative_residual(residuals: DataFrame, value: str = "flux") -> DataFrame:
    """(D - M) / D; null where there are no data to divide by."""
    return residuals.withColumn("relative", F.when(is_finite(value) & (F.col(value) != 0), (F.col(value) - F.col("yhat")) / F.col(value)))


def log_map(df: DataFrame, value: str, name: str = "log10") -> DataFrame:
    """log10 of the positive values; others are left out of the map as nulls."""
    return df.withColumn(name, F.when(is_finite(value) & (F.col(value) > 0), F.log10(value)))


def linear_widths(edges: DataFrame) -> DataFrame:
    """Widths of bins in wavelength from their edges (lo, hi) in its logarithm."""
    return edges.withColumn("width", F.exp("hi") - F.exp("lo"))


def rotated(df: DataFrame, degrees: float, x: str = "x", y: str = "y") -> DataFrame:
    """Places on the sky turned by an angle, counterclockwise."""
    cos, sin = F.cos(F.radians(F.lit(float(degrees)))), F.sin(F.radians(F.lit(float(degrees))))
    return df.withColumns({x: F.col(x) * cos - F.col(y) * sin, y: F.col(x) * sin + F.col(y) * cos})


def tiles_within(errors: DataFrame, cap: float) -> DataFrame:
    """Tiles whose error is finite and at most the cap: the others are skipped."""
    return errors.where(is_finite("rmse") & (F.col("rmse") <= cap))


def freeze_globally(gradients: DataFrame, rel: float = 1e-6) -> DataFrame:
    """Columns whose diagonal is tiny beside the median positive one of all columns get no gradient and an infinite diagonal."""
    middle = gradients.agg(F.median(F.when(F.col("d") > 0, F.col("d"))).alias("middle"))
    tiny = F.col("d") <= rel * F.coalesce("middle", F.lit(0.0))
    joined = gradients.crossJoin(F.broadcast(middle))  # one row
    return joined.select("c", "p", F.when(tiny, 0.0).otherwise(F.col("g")).alias("g"), F.when(tiny, float("inf")).otherwise(F.col("d")).alias("d"), tiny.alias("frozen"))


def supported_only(active: DataFrame, support: DataFrame) -> DataFrame:
    """The active components of each tile that are supported there: (tile, c)."""
    return support.where("amp_ok and energy_ok").select("tile", "c").join(active.select("c"), "c", "left_semi").select("tile", "c")


def best_within_memory(candidates: DataFrame, key: Sequence[str], score: str, bytes_each: int, bytes_most: int) -> DataFrame:
    """One row of each key, its best score, and of these the best that fit a budget; ties by key."""
    best = candidates.groupBy(*key).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), *key).limit(max(bytes_most // max(bytes_each, 1), 0))


def minutes_since_first(events: DataFrame, ts: str = "ts", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Minutes since a group's first event: the first is summed and joined, so that no group is one task's window."""
    first = events.groupBy(*by).agg(F.min(ts).alias("_first"))
    seconds = F.col(ts).cast("timestamp").cast("double") - F.col("_first").cast("timestamp").cast("double")
    return events.join(first, list(by)).withColumn("minutes", seconds / 60.0).drop("_first")


def bright_order(tiles: DataFrame, wanted: DataFrame, value: str = "norm") -> DataFrame:
    """The wanted tiles with their place in the order of brightness, brightest first."""
    kept = tiles.join(wanted.select("tile"), "tile", "left_semi")
    # One row a tile: thousands at most, numbered in one task.
    from pyspark.sql import Window as W

    return kept.withColumn("turn", F.row_number().over(W.orderBy(F.desc(value), "tile")).cast("long"))
