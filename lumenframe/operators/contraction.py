"""Tensor contractions as joins and sums.

Sums have map-side partials, so only one row a key and task is shuffled.  Sides
that are small at run time are broadcast by adaptive execution; nothing here
assumes it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict(models: DataFrame, weights: DataFrame, keys: Sequence[str] = ("c", "p"), by: Sequence[str] = ("s", "l")) -> DataFrame:
    """yhat = sum of m * x over the keys; zero weights never meet the models."""
    used = weights.where("x <> 0").select(*keys, "x")
    return models.join(used, list(keys)).groupBy(*by).agg(F.sum(F.col("m") * F.col("x")).alias("yhat"))


def predict_dense(models: DataFrame, weights: DataFrame, keys: Sequence[str] = ("c", "p"), key: str = "s") -> DataFrame:
    """The same for dense rows (key, m array): each task adds up its arrays by key before they are laid out and summed."""
    joined = models.join(weights.where("x <> 0").select(*keys, "x"), list(keys)).select(F.col(key).cast("long").alias(key), F.col("m").cast("array<double>").alias("m"), F.col("x").cast("double"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            sizes = np.diff(offsets)
            flat = values * np.repeat(batch.column(2).to_numpy(zero_copy_only=False), sizes)
            for width in np.unique(sizes):
                of = sizes == width
                rows = flat[np.repeat(of, sizes)].reshape(of.sum(), width)
                own, back = np.unique(ids[of], return_inverse=True)
                total = np.zeros((len(own), width))
                np.add.at(total, back, rows)
                yield pa.RecordBatch.from_pydict({key: pa.array(own, pa.int64()), "part": pa.array(list(total), pa.list_(pa.float64()))})

    parts = joined.mapInArrow(partial, f"{key} long, part array<double>")
    long = parts.select(key, F.posexplode("part").alias("l", "v")).groupBy(key, "l").agg(F.sum("v").alias("v"))
    return long.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("l", "v"))), lambda e: e["v"]).alias("yhat"))


def residual(data: DataFrame, model: DataFrame, by: Sequence[str] = ("s", "l")) -> DataFrame:
    """flux - yhat on every data row; a place without a prediction has 0."""
    return data.join(model.select(*by, "yhat"), list(by), "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0))).withColumn("r", F.col("flux") - F.col("yhat"))


def gradient(models: DataFrame, residuals: DataFrame, keys: Sequence[str] = ("c", "p"), by: Sequence[str] = ("s", "l"), weight: str | None = None) -> DataFrame:
    """g = sum w m r and the diagonal d = sum w m^2 for each column, in one pass."""
    w = F.col(weight) if weight else F.lit(1.0)
    joined = models.join(residuals.select(*by, "r", *([weight] if weight else [])), list(by))
    return joined.groupBy(*keys).agg(F.sum(w * F.col("m") * F.col("r")).alias("g"), F.sum(w * F.col("m") * F.col("m")).alias("d"))


def rebin(values: DataFrame, operator: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Applies a sparse operator (t, l, w) to rows (keys, t, value)."""
    return values.join(operator, "t").groupBy(*keys, "l").agg(F.sum(F.col(value) * F.col("w")).alias(value))


def gram(models: DataFrame, keys: Sequence[str] = ("c", "p"), by: Sequence[str] = ("s", "l")) -> DataFrame:
    """Products of all pairs of columns that share a row, the upper triangle: for design tensors of a bounded number of columns."""
    a = models.select(*by, F.struct(*keys).alias("i"), F.col("m").alias("a"))
    b = models.select(*by, F.struct(*keys).alias("j"), F.col("m").alias("b"))
    return a.join(b, list(by)).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def coherence(grams: DataFrame) -> DataFrame:
    """|cos| of each pair of different columns, from their products."""
    own = grams.where("i = j").select(F.col("i").alias("k"), F.sqrt("g").alias("n"))
    pairs = grams.where("i <> j").join(own.select(F.col("k").alias("i"), F.col("n").alias("ni")), "i").join(own.select(F.col("k").alias("j"), F.col("n").alias("nj")), "j")
    return pairs.select("i", "j", F.when(F.col("ni") * F.col("nj") > 0, F.abs(F.col("g")) / (F.col("ni") * F.col("nj"))).otherwise(0.0).alias("coherence"))
