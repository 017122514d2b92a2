"""Which components matter where: supports, freezes, active sets, pending tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def support_by_amplitude(amplitudes: DataFrame, eps: float = 1e-12) -> DataFrame:
    """A component is supported in a tile if any of its apertures there exceeds eps times the component's largest amplitude."""
    largest = amplitudes.groupBy("c").agg(F.max("amp").alias("largest"))
    per_tile = amplitudes.groupBy("tile", "c").agg(F.max("amp").alias("amp"))
    return per_tile.join(largest, "c").select("tile", "c", (F.col("amp") > eps * F.col("largest")).alias("amp_ok"))


def support_by_energy(energies: DataFrame, rel: float = 1e-6) -> DataFrame:
    """A component is supported in a tile if its energy exceeds rel times the tile's median positive energy; nothing in an empty tile."""
    # One row for each tile and component: a tile's window is as long as there are components.
    middle = F.median(F.when(F.col("energy") > 0, F.col("energy"))).over(W.partitionBy("tile"))
    return energies.withColumn("middle", middle).select("tile", "c", F.coalesce(F.col("energy") > rel * F.col("middle"), F.lit(False)).alias("energy_ok"))


def both_supports(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["tile", "c"]).select("tile", "c", (F.col("amp_ok") & F.col("energy_ok")).alias("ok"))


def freeze_tiny(gradients: DataFrame, rel: float = 1e-6, absolute: float = 1e-24) -> DataFrame:
    """Columns whose diagonal is tiny beside the median positive one of their component get no gradient and an infinite diagonal."""
    # One row for each column: a component's window is as long as there are populations, and the sums are made once.
    middle = F.median(F.when(F.col("d") > 0, F.col("d"))).over(W.partitionBy("c"))
    tiny = F.col("d") <= F.greatest(F.lit(absolute), rel * F.coalesce("middle", F.lit(0.0)))
    return gradients.withColumn("middle", middle).select("c", "p", F.when(tiny, 0.0).otherwise(F.col("g")).alias("g"), F.when(tiny, float("inf")).otherwise(F.col("d")).alias("d"), tiny.alias("frozen"))


def active_components(state: DataFrame, mass_eps: float = 1e-12, grad_eps: float = 1e-10, least: int = 8) -> DataFrame:
    """Components (c, mass, grad) with mass or gradient, and the ones with the largest gradient up to ``least`` in all cases."""
    top = state.agg(F.greatest(F.sum("mass"), F.lit(1.0)).alias("m"), F.greatest(F.max("grad"), F.lit(1.0)).alias("g"))
    by_value = state.crossJoin(F.broadcast(top)).where((F.col("mass") > mass_eps * F.col("m")) | (F.col("grad") > grad_eps * F.col("g"))).select("c")
    return by_value.unionByName(state.orderBy(F.desc("grad"), "c").limit(least).select("c")).distinct()


def pending(all_tiles: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles without an entry in the build log."""
    return all_tiles.join(done.select(*keys), keys, "left_anti")


def kkt_violations(state: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Columns at zero whose gradient says they should grow."""
    return state.where((F.col("x") <= 0) & (F.col("g") < -tol))
