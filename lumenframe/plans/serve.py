"""From weights to model spectra, errors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import digest, is_finite
from ..operators.aggregates import distances, divergence
from ..operators.contraction import predict_dense
from ..operators.mixtures import unit_sum, usage
from ..sources.store import Store


def reconstruct(store: Store, weights: DataFrame) -> DataFrame:
    """(s, yhat array) of every aperture."""
    return predict_dense(store.table("models").select("s", "c", "p", "m"), weights)


def solution_digest(weights: DataFrame, decimals: int = 6) -> DataFrame:
    """SHA-1 of the weights in the order of their columns: one row, as long as there are columns."""
    ordered = weights.agg(F.sort_array(F.collect_list(F.struct("c", "p", "x"))).alias("a"))
    return ordered.select(digest(F.transform("a", lambda e: e["x"]), decimals).alias("digest"), F.size("a").cast("long").alias("n"))


def is_stale(store: Store, weights: DataFrame) -> bool:
    return store.metadata().get("x_digest") != solution_digest(weights).first()["digest"]


def first_choice(candidates: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """For each key the row of the first source that has it; the name of the source goes along."""
    rows = None
    for prio, (name, df) in enumerate(candidates):
        one = df.withColumns({"source": F.lit(name), "prio": F.lit(prio)})
        rows = one if rows is None else rows.unionByName(one)
    w = W.partitionBy(*keys).orderBy("prio")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "prio")


def seed_weights(grid: DataFrame, seed: DataFrame) -> DataFrame:
    """A dense start from a seed of any length: missing columns are 0, negative ones too."""
    return grid.join(seed.select("c", "p", "x"), ["c", "p"], "left").select("c", "p", F.greatest(F.coalesce("x", F.lit(0.0)), F.lit(0.0)).alias("x"))


def mix_report(solution: DataFrame, prior: DataFrame) -> DataFrame:
    """Distances and divergences between the mix of a solution and a prior."""
    u = unit_sum(usage(solution), "usage", name="u").join(unit_sum(prior, "w", name="t"), "c").select("c", "u", "t")
    return distances(u, "c", "u", "t").crossJoin(F.broadcast(divergence(u, "t", "u")))  # one row each


def issues(store: Store) -> DataFrame:
    """A row for each thing that is wrong with the tables of a store: none if all is well."""
    spectra, axis, losvd, models = (store.table(t) for t in ("spectra", "axis", "losvd", "models"))
    meta = store.metadata()
    steps = axis.withColumn("step", F.col("coord") - F.lag("coord").over(W.partitionBy("name").orderBy("idx")))
    found = [
        axis.where(~is_finite("coord")).select(F.lit("axis").alias("table"), F.lit("coordinate not finite").alias("issue"), F.col("name").alias("at")),
        steps.where("step <= 0").select(F.lit("axis"), F.lit("not increasing"), "name"),
        spectra.where(F.size("flux") != int(meta.get("n_l", 0))).select(F.lit("spectra"), F.lit("wrong length"), F.col("s").cast("string")),
        losvd.where(F.size("h") != int(meta.get("n_v", 0))).select(F.lit("losvd"), F.lit("wrong length"), F.concat_ws(",", "s", "c")),
        models.where(F.exists("m", lambda v: v.isNull() | F.isnan(v) | (v < 0))).select(F.lit("models"), F.lit("negative or not finite"), F.concat_ws(",", "s", "c", "p")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
