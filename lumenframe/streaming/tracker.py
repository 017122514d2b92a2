"""The fit tracker: running averages, thinned metrics, snapshots, rings, resumption.

Each operator has a batch form; those with state have a streaming form whose
result over all events equals it.  Spark holds a source back rather than drop
events, so nothing is lost when a sink is slow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.workspace import materialise

ALPHA, OUTLIER, STRIDE, RING, FLUSH_SECONDS = 0.02, 1e3, 16, 96, 5


def ewma_step(average: float | None, value: float, alpha: float = ALPHA, outlier: float = OUTLIER) -> tuple[float | None, bool]:
    """The next average, and whether the value counted: an outlier is left out."""
    if average is not None and value > outlier * max(average, 1.0):
        return average, False
    return (value if average is None else (1 - alpha) * average + alpha * value), True


def ewma(events: DataFrame, by: str, order: Sequence[str], value: str, alpha: float = ALPHA, outlier: float = OUTLIER) -> DataFrame:
    """Per group the last running average and the number of values that counted.

    The fold hangs on the order, so a group is folded in one task, as rows that stream through it sorted.
    """
    kind = events.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, average, n = None, None, 0
        for frame in frames:
            for key, v in zip(frame[by], frame[value], strict=True):
                if key != now:
                    if n:
                        yield pd.DataFrame({by: [now], "ewma": [average], "n": [n]})
                    now, average, n = key, None, 0
                average, counted = ewma_step(average, float(v), alpha, outlier)
                n += counted
        if n:
            yield pd.DataFrame({by: [now], "ewma": [average], "n": [n]})

    ordered = events.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, *[o for o in order if o != by], value).repartition(by).sortWithinPartitions(by, *order)
    return ordered.mapInPandas(run, f"{by} {kind}, ewma double, n long")


def stream_ewma(stream: DataFrame, by: str, order: Sequence[str], value: str, alpha: float = ALPHA, outlier: float = OUTLIER) -> DataFrame:
    """The same over a stream: the state of a group is its average and count; each trigger gives the group's new values."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).dropna(subset=[value]).sort_values(list(order), kind="stable")
        for v in rows[value]:
            average, counted = ewma_step(average, float(v), alpha, outlier)
            n += counted
        if n:
            state.update((average, n))
            yield pd.DataFrame({by: [key[0]], "ewma": [average], "n": [n]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, ewma double, n long", "ewma double, n long", "update", GroupStateTimeout.NoTimeout)


def numbered(events: DataFrame, by: str, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Events with their place in their group, from 0.

    Ranges of the order are numbered each for itself and then moved on by the counts before them, so that a group with most
    of the rows is many tasks' work.  The order must tell all events apart; the table of ranges is written, so that they stay.
    """
    ranges = materialise(events.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(by, "_range").agg(F.count("*").alias("_n"))  # a row a group and range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(by).alias("_by"), F.col("_range").alias("_of"), "_before")
    own = F.row_number().over(W.partitionBy(by, "_range").orderBy(*order)) - 1
    joined = ranges.withColumn("_own", own).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_by", "_of", "_before")


def every_nth(events: DataFrame, by: str, order: Sequence[str], n: int = STRIDE) -> DataFrame:
    """The first and then every n-th event of each group."""
    return numbered(events, by, order).where(F.col("seq") % n == 0)


def throttle(events: DataFrame, by: str, ts: str, seconds: int, order: Sequence[str]) -> DataFrame:
    """Events that come at least so long after the last one that was kept.  One number a group is carried along its sorted rows."""
    kept = events.select(by, ts, *[o for o in order if o not in (by, ts)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        gap = pd.Timedelta(seconds=seconds)
        for frame in frames:
            keep = []
            for key, t in zip(frame[by], frame[ts], strict=True):
                if key != now:
                    now, last = key, None
                keep.append(last is None or t - last >= gap)
                if keep[-1]:
                    last = t
            yield frame[keep]

    return kept.repartition(by).sortWithinPartitions(by, ts, *order).mapInPandas(run, kept.schema)


def last_and_best(events: DataFrame, by: str, value: str, order: Column, payload: Column) -> DataFrame:
    """Per group the payload of the last event, and of the first with the least value."""
    return events.groupBy(by).agg(F.max_by(payload, order).alias("last"), F.min_by(payload, F.struct(F.col(value), order)).alias("best"), F.min(value).alias("best_value"))


def ring(events: DataFrame, by: str, order: Sequence[str], size: int = RING) -> DataFrame:
    """The newest event of each slot of a ring that the events of a group go round."""
    placed = numbered(events, by, order).withColumn("slot", F.col("seq") % size)
    last = placed.groupBy(by).agg(F.max("seq").alias("top"))
    return placed.join(last, by).where(F.col("seq") > F.col("top") - size).drop("top")


def resume_choice(candidates: DataFrame, by: str) -> DataFrame:
    """Of the saved states of each run: the later epoch if all have one, else the newer file; then the smaller name."""
    known = candidates.groupBy(by).agg(F.bool_and(F.col("epoch").isNotNull()).alias("all_known"))
    order = F.struct(F.when(F.col("all_known"), F.col("epoch")).otherwise(F.lit(0)), F.col("mtime"), -F.col("id"))
    return candidates.join(known, by).groupBy(by).agg(F.max_by("id", order).alias("id"))


def save_stream(stream: DataFrame, path: str, checkpoint: str, seconds: int = FLUSH_SECONDS, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends a stream to a table at each trigger; readers see whole batches.  ``on_batch`` is called with each one."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("append").parquet(path)
        if on_batch:
            on_batch(batch, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


class Tracker:
    """What a solver calls: each call is a row to append; ``frame`` is the table of them."""

    COLUMNS = "seq long, op string, epoch int, value double, done long, total long"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def _add(self, op: str, epoch: int | None = None, value: float | None = None, done: int | None = None, total: int | None = None) -> None:
        self.rows.append((len(self.rows), op, epoch, value, done, total))

    def on_batch_rmse(self, rmse: float) -> None:
        self._add("rmse_batch", value=float(rmse))

    def on_progress(self, epoch: int, done: int, total: int, rmse: float | None = None) -> None:
        self._add("progress", epoch, rmse, done, total)

    def on_epoch_end(self, epoch: int, rmse: float | None = None) -> None:
        self._add("epoch_end", epoch, rmse)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.COLUMNS)


class NullTracker(Tracker):
    def _add(self, *_, **__) -> None:
        return
