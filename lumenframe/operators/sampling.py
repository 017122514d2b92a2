"""Order, limits, samples and set operations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_and_worst(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows with the least and the n with the largest value, told apart by ``side`` and ranked; ties by key."""
    best = df.orderBy(F.asc(value), F.asc(key)).limit(n).withColumn("side", F.lit("best"))
    worst = df.orderBy(F.desc(value), F.asc(key)).limit(n).withColumn("side", F.lit("worst"))
    order = F.when(F.col("side") == "best", F.col(value)).otherwise(-F.col(value))
    return best.unionByName(worst).withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(order, key)).cast("long"))


def top_per_group(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group.  Spark limits each task's groups before the shuffle, so a large group is not moved whole."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def top_with_backfill(df: DataFrame, by: Sequence[str], k: int, cap: int, score: str, keys: Sequence[str]) -> DataFrame:
    """The first k of each group, and if they are fewer than cap in all, the best of the rest; at most cap rows."""
    order = [F.desc(score), *map(F.asc, keys)]
    first = top_per_group(df, by, k, *order).drop("rank").withColumn("turn", F.lit(0))
    rest = df.join(first.select(*keys), list(keys), "left_anti").withColumn("turn", F.lit(1))
    return first.unionByName(rest).orderBy("turn", *order).limit(cap).withColumn("backfilled", F.col("turn") == 1).drop("turn")


def even_spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows at like distances in the order of a dense integer key that begins at its minimum."""
    size = df.agg((F.max(key) - F.min(key) + 1).alias("size"), F.min(key).alias("low"))
    step = F.floor(F.col("i") * (F.col("size") - 1) / F.greatest(F.lit(n - 1), F.lit(1)))
    wanted = size.select("low", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select((F.col("low") + step).cast("long").alias(key)).distinct()
    return df.join(wanted, key, "left_semi")


def strata(df: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    """One row of each of n ranges of a small dense key (tiles): the first by ``order``."""
    tiled = df.withColumn("stratum", F.ntile(n).over(W.orderBy(key)))
    return top_per_group(tiled, ["stratum"], 1, *order).drop("rank")


def fair_spread(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """One row of each of n ranges of a small dense key, drawn by the MD5 of seed and key: the same for the same seed."""
    return strata(df, key, n, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)])


def seeded_choice(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed whatever the partitions: those with the smallest MD5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def bright_first(df: DataFrame, value: str, key: str, n: int, bright: float = 0.7, seed: int = 12345) -> DataFrame:
    """A budget of n rows: the brightest part, the rest by chance."""
    m = int(n * bright)
    top = df.orderBy(F.desc(value), F.asc(key)).limit(m)
    rest = seeded_choice(df.join(top.select(key), key, "left_anti"), key, n - m, seed)
    return top.unionByName(rest)


def spaced_peaks(df: DataFrame, by: Sequence[str], n: int, gap: int, order: str = "l", value: str = "value", schema: str | None = None) -> DataFrame:
    """Greedy pick of each group's deepest places at least ``gap`` apart; the gap halves until n are found or it is 0.

    Each choice hangs on those before it, so a group, one spectrum, is walked in one task.
    """
    kinds = schema or ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, order, value])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([value, order], kind="stable")
        places, width = [], gap
        while True:
            places = []
            for at in g[order]:
                if len(places) == n:
                    break
                if all(abs(at - p) >= max(width, 1) for p in places):
                    places.append(at)
            if len(places) >= min(n, len(g)) or width <= 1:
                break
            width //= 2
        return g[g[order].isin(places)][[*by, order, value]]

    return df.select(*by, order, value).groupBy(*by).applyInPandas(one, kinds)


def diverse_pairs(df: DataFrame, a: str, b: str, score: str, n: int) -> DataFrame:
    """n pairs by score, first those whose both sides are their sides' best and so all different, then the rest.

    For tables of any size; diverse_greedy() walks a short list as a snapshot of pairs is picked by hand.
    """
    best_a = F.row_number().over(W.partitionBy(a).orderBy(F.desc(score), F.asc(b)))
    best_b = F.row_number().over(W.partitionBy(b).orderBy(F.desc(score), F.asc(a)))
    return df.withColumns({"_a": best_a, "_b": best_b}).orderBy(F.greatest("_a", "_b"), F.desc(score), a, b).limit(n).drop("_a", "_b")


def diverse_greedy(df: DataFrame, a: str, b: str, score: str, n: int, tile: int, most: int = 100_000) -> DataFrame:
    """n pairs in the order of their scores: first pairs whose tiles are new on both sides, then those where one is, then any.

    Each pick hangs on those before it, so this walks the ``most`` best pairs in one task; more than that is refused.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pairs: use diverse_pairs")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, a, b], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rows, columns, picked = set(), set(), []
        for need in (2, 1, 0):
            for i, x, y in zip(g.index, g[a] // tile, g[b] // tile, strict=True):
                if len(picked) == n:
                    break
                if i not in picked and (x not in rows) + (y not in columns) >= need:
                    picked.append(i)
                    rows.add(x)
                    columns.add(y)
        return g.loc[picked].assign(turn=range(1, len(picked) + 1))

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (a, b, score))
    return df.select(a, b, score).groupBy().applyInPandas(walk, f"{schema}, turn long")


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
