"""Solvers that pass over the stored design tensor and keep only the column table on the driver.

The tensor stays where it is: no pass shuffles it.  A pass over dense rows
(tile, s, c, p, m) is a join with broadcast blocks of bounded size, numpy sums in
each task, and a shuffle of one row a column (or aperture) and task.  Residuals
are taken in blocks of whole tiles of at most ``BLOCK_BYTES``, so that with many
apertures each block reads its own tiles' folders and nothing else.

The column table, components by populations, is bounded by the instrument; its
size is checked before it goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise
from .solve import barzilai_borwein, cosine_rate, trust_scale

#: Columns that the driver holds: a few arrays of 8 MB.
MOST_COLUMNS = 1_000_000
#: Bytes of residuals that are broadcast at once.
BLOCK_BYTES = 64 << 20


class Tracker(Protocol):
    """Anything that is told of a fit's progress."""

    def on_epoch_end(self, epoch: int, rmse: float) -> None: ...

    def on_progress(self, done: int, total: int) -> None: ...

    def on_batch_rmse(self, rmse: float) -> None: ...


class Silent:
    def on_epoch_end(self, epoch: int, rmse: float) -> None:
        pass

    def on_progress(self, done: int, total: int) -> None:
        pass

    def on_batch_rmse(self, rmse: float) -> None:
        pass


def safe_rmse(value: float | None) -> float:
    """An error that is missing, negative or not finite is infinite."""
    return float(value) if value is not None and np.isfinite(value) and value >= 0 else float("inf")


@dataclass
class DescentConfig:
    epochs: int = 3
    rate: float = 0.1
    trust: float = 0.5
    freeze: float = 1e-6
    floor: float = 1e-6
    ridge: float = 0.0
    most_step: float = 10.0
    plateau: float = 1e-9
    seed: int = 12345
    max_tiles: int | None = None
    project: Callable[[np.ndarray], np.ndarray] | None = None


@dataclass
class Columns:
    """The column table in a fixed order."""

    c: np.ndarray
    p: np.ndarray
    place: dict[tuple[int, int], int] = field(default_factory=dict)

    @classmethod
    def of(cls, models: DataFrame) -> Columns:
        rows = models.select("c", "p").distinct().limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        keys = sorted((r["c"], r["p"]) for r in rows)
        return cls(np.array([c for c, _ in keys], dtype=np.int64), np.array([p for _, p in keys], dtype=np.int64), {k: i for i, k in enumerate(keys)})

    def __len__(self) -> int:
        return len(self.c)

    def vector(self, table: DataFrame, value: str = "x") -> np.ndarray:
        out = np.zeros(len(self))
        for r in table.select("c", "p", value).where(F.col(value) != 0).collect():  # no more rows than columns
            if (i := self.place.get((r["c"], r["p"]))) is not None:
                out[i] = r[value]
        return out

    def frame(self, like: DataFrame, x: np.ndarray) -> DataFrame:
        rows = list(zip(self.c.tolist(), self.p.tolist(), map(float, x), strict=True))
        return like.sparkSession.createDataFrame(rows, like.select("c", "p").schema.add("x", "double"))


def _sums(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (c, p, m, r, w): sums of w m r and w m^2 by column, one row a column and task."""
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("g", pa.float64()), ("d", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(keys))], axis=1)
            m, r, w = (batch.column(len(keys) + k) for k in range(3))
            offsets = m.offsets.to_numpy()
            flat = m.flatten().to_numpy(zero_copy_only=False).astype(float)
            flat = np.where(np.isfinite(flat), flat, 0.0)
            weighted = flat * w.flatten().to_numpy(zero_copy_only=False)
            starts = offsets[:-1] - offsets[0]
            full = np.flatnonzero(np.diff(offsets) > 0)
            sums = np.zeros((batch.num_rows, 2))
            if len(full):
                sums[full, 0] = np.add.reduceat(weighted * r.flatten().to_numpy(zero_copy_only=False), starts[full])
                sums[full, 1] = np.add.reduceat(weighted * flat, starts[full])
            own, back = np.unique(ids, axis=0, return_inverse=True)
            part = np.zeros((len(own), 2))
            np.add.at(part, back.reshape(-1), sums)
            for key, value in zip(map(tuple, own.tolist()), part, strict=True):
                total[key] = total[key] + value if key in total else value
        if total:
            columns = [*zip(*total, strict=True), *np.array(list(total.values())).T]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _dense_sum(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, m, x): sums of x m by key, one array a key and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)):
                row = np.nan_to_num(flat[a:b].astype(float), nan=0.0, posinf=0.0, neginf=0.0) * x[i]
                k = int(ids[i])
                total[k] = total[k] + row if k in total else row
        if total:
            yield pa.RecordBatch.from_pydict({key: pa.array(list(total), pa.int64()), "part": pa.array(list(total.values()), pa.list_(pa.float64()))})

    return run


class System:
    """A stored tensor (tile, s, c, p, m), data (s, flux) and weights along the wavelengths."""

    def __init__(self, models: DataFrame, data: DataFrame, weights: np.ndarray | None = None, tile_size: int = 128):
        self.spark, self.models, self.tile_size = models.sparkSession, models, tile_size
        self.data = data.select("s", "flux", F.floor(F.col("s") / tile_size).cast("int").alias("tile"))
        first = data.select(F.size("flux").alias("n")).limit(1).collect()
        self.n_l = first[0]["n"] if first else 0
        self.weights = np.ones(self.n_l) if weights is None else np.asarray(weights, float)
        if len(self.weights) != self.n_l:
            raise ValueError("a weight for each wavelength")
        self.columns = Columns.of(models)

    def tiles(self) -> list[int]:
        return sorted(r["tile"] for r in self.data.select("tile").distinct().collect())  # a few thousand

    def of_tiles(self, tiles: Sequence[int]) -> System:
        """The same system on some tiles: scans open these tiles' folders only."""
        part = object.__new__(System)
        part.__dict__.update(self.__dict__)
        part.models, part.data = (df.where(F.col("tile").isin(list(tiles))) for df in (self.models, self.data))
        return part

    def _blocks(self) -> Iterator[list[int]]:
        most = max(1, BLOCK_BYTES // max(8 * self.n_l * self.tile_size, 1))
        tiles = self.tiles()
        for at in range(0, len(tiles), most):
            yield tiles[at : at + most]

    def _as_column(self, values: np.ndarray):
        """One axis as a constant array."""
        return F.array(*(F.lit(float(v)) for v in values))

    def predict(self, x: np.ndarray) -> DataFrame:
        """(s, yhat) of the apertures that any used column has models for."""
        used = np.flatnonzero(x)
        rows = list(zip(self.columns.c[used].tolist(), self.columns.p[used].tolist(), x[used].tolist(), strict=True))
        weights = self.spark.createDataFrame(rows, self.models.select("c", "p").schema.add("x", "double"))
        joined = self.models.join(F.broadcast(weights), ["c", "p"])  # MOST_COLUMNS rows at most
        parts = joined.select(F.col("s").cast("long"), "m", "x").mapInArrow(_dense_sum("s"), "s long, part array<double>")
        summed = parts.select("s", F.posexplode("part").alias("l", "v")).groupBy("s", "l").agg(F.sum("v").alias("v"))
        return summed.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("l", "v"))), lambda e: e["v"]).alias("yhat"))

    def residual(self, x: np.ndarray) -> DataFrame:
        """(s, tile, r, w): what the prediction leaves; a value that is not finite has weight 0."""
        fit = self.predict(x)
        joined = self.data.join(fit, "s", "left").withColumn("yhat", F.coalesce("yhat", F.array_repeat(F.lit(0.0), self.n_l)))
        w = self._as_column(self.weights)
        ok = lambda f: f.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf"))
        r = F.zip_with("flux", "yhat", lambda f, y: F.when(ok(f), f - y).otherwise(0.0))
        return joined.select("s", "tile", r.alias("r"), F.zip_with("flux", w, lambda f, u: F.when(ok(f), u).otherwise(0.0)).alias("w"))

    def gradient(self, errors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """g = sum w m r and d = sum w m^2 of each column, from a written residual table."""
        parts = []
        for tiles in self._blocks():
            own = errors.where(F.col("tile").isin(tiles)).select("s", "r", "w")
            joined = self.models.where(F.col("tile").isin(tiles)).join(F.broadcast(own), "s")  # BLOCK_BYTES of residuals, as much of weights
            parts.append(joined.select("c", "p", "m", "r", "w").mapInArrow(_sums(("c", "p")), "c long, p long, g double, d double"))
        g, d = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        if parts:
            for row in reduce(DataFrame.unionByName, parts).groupBy("c", "p").agg(F.sum("g").alias("g"), F.sum("d").alias("d")).collect():
                i = self.columns.place[row["c"], row["p"]]
                g[i], d[i] = row["g"], row["d"]
        return g, d

    def error(self, errors: DataFrame) -> float:
        sums = errors.select(F.aggregate(F.zip_with("r", "w", lambda r, w: w * r * r), F.lit(0.0), lambda s, v: s + v).alias("a"), F.aggregate("w", F.lit(0.0), lambda s, v: s + v).alias("b"))
        a, b = sums.agg(F.sum("a"), F.sum("b")).first()
        return safe_rmse((a / b) ** 0.5 if b else None)

    def norm(self) -> float:
        """Length of the weighted data."""
        errors = self.residual(np.zeros(len(self.columns)))
        a = errors.select(F.aggregate(F.zip_with("r", "w", lambda r, w: w * r * r), F.lit(0.0), lambda s, v: s + v).alias("a")).agg(F.sum("a")).first()[0]
        return float(a or 0.0) ** 0.5

    def advance(self, errors: DataFrame, dx: np.ndarray, most: float = 1.0) -> tuple[float, DataFrame]:
        """The step along dx, from 0 to ``most``, with the least error (from two sums), and the residuals after it."""
        move = self.predict(dx)
        both = errors.join(move, "s", "left").withColumn("move", F.coalesce("yhat", F.array_repeat(F.lit(0.0), self.n_l))).drop("yhat")
        both = materialise(both, "moves")
        add = lambda s, v: s + v
        cross = F.aggregate(F.zip_with(F.zip_with("r", "w", lambda r, w: r * w), "move", lambda r, m: r * m), F.lit(0.0), add)
        own = F.aggregate(F.zip_with(F.zip_with("move", "w", lambda r, w: r * w), "move", lambda r, m: r * m), F.lit(0.0), add)
        a, b = both.select(cross.alias("a"), own.alias("b")).agg(F.sum("a"), F.sum("b")).first()
        step = float(np.clip(a / b, 0.0, most)) if a and b else 0.0
        return step, both.select("s", "tile", F.zip_with("r", "move", lambda r, m: r - step * m).alias("r"), "w")


def _frozen(d: np.ndarray, components: np.ndarray, rel: float) -> np.ndarray:
    """Columns whose diagonal is tiny beside the median positive one of their component."""
    out = np.zeros(len(d), dtype=bool)
    for c in np.unique(components):
        of = components == c
        positive = d[of][d[of] > 0]
        out[of] = d[of] <= max(1e-24, rel * float(np.median(positive)) if len(positive) else 0.0)
    return out


def descend(system: System, start: np.ndarray, config: DescentConfig | None = None, tracker: Tracker | None = None) -> tuple[np.ndarray, list[float]]:
    """Spectral projected gradient: preconditioned, active set, step from the last change, trust region, exact line search.

    Columns at zero that would fall stay out, as do frozen ones.  The first epoch's step is the rate, later ones come from
    the changes of weights and gradient in the metric of the diagonal.  A mix projection moves the target of the step; if
    that way leads uphill, the step goes without it.  The error never rises.  Two passes over the tensor an epoch.
    """
    config, tracker = config or DescentConfig(), tracker or Silent()
    x = np.maximum(np.nan_to_num(start, nan=0.0, posinf=0.0, neginf=0.0), 0.0)
    errors, norm = materialise(system.residual(x), "residual"), system.norm()
    history, last = [system.error(errors)], None
    for epoch in range(config.epochs):
        g, d = system.gradient(errors)
        g = g - config.ridge * x
        frozen = _frozen(d, system.columns.c, config.freeze)
        positive = d[d > 0]
        scale = np.maximum(d + config.ridge, config.floor * (float(np.percentile(positive, 90)) if len(positive) else 1.0))
        open_ = ~frozen & ((x > 0) | (g > 0))
        step = config.rate
        if last is not None:
            step = float(np.clip(barzilai_borwein((x - last[0]) * np.sqrt(scale), (last[1] - g) / np.sqrt(scale), config.rate), 1e-3 * config.rate, config.most_step))
        dx = np.where(open_, np.maximum(step * g / scale, -x), 0.0)
        dx = dx * trust_scale(dx, scale, norm, config.trust)
        plain = dx
        if config.project is not None:
            dx = np.maximum(config.project(x + dx), 0.0) - x
        taken, after = system.advance(errors, dx)
        if not taken and config.project is not None:
            dx = plain
            taken, after = system.advance(errors, dx)
        if not taken:
            break
        # Along a feasible step the line search may go on as long as nothing falls below zero.
        last = (x, g)
        x, errors = np.maximum(x + taken * dx, 0.0), materialise(after, "residual")
        history.append(system.error(errors))
        tracker.on_epoch_end(epoch + 1, history[-1])
        if history[-2] - history[-1] <= config.plateau * max(history[-2], 1e-300):
            break
    return x, history


def _row_steps(place: dict[tuple[int, int], int], given: np.ndarray, weights: np.ndarray, rate: float):
    """One aperture's models and data: the weights after a step for each of its wavelengths in turn."""

    def run(models: pa.Table, data: pa.Table) -> pa.Table:
        at = np.array([place[k] for k in zip(models["c"].to_pylist(), models["p"].to_pylist(), strict=True)], dtype=np.int64)
        own = given[at].copy()
        if models.num_rows and data.num_rows:
            a, y = np.array(models["m"].to_pylist(), dtype=float).T, np.array([np.nan if v is None else v for v in data["flux"][0].as_py()])
            for row, value in zip(a[(weights > 0) & np.isfinite(y)], y[(weights > 0) & np.isfinite(y)], strict=True):
                own += rate * (value - row @ own) / (row @ row + 1e-18) * row
        return pa.table({"c": models["c"].cast(pa.int64()), "p": models["p"].cast(pa.int64()), "x": pa.array(own, pa.float64())})

    return run


def row_action(system: System, start: np.ndarray, sweeps: int = 1, rate: float = 0.5, tracker: Tracker | None = None) -> tuple[np.ndarray, list[float]]:
    """Kaczmarz steps x += rate (y - a x) / (a a) a over each aperture's wavelengths, from the same start; their mean, projected, ends a sweep.

    Steps within an aperture follow each other; apertures are independent, so that the result does not hang on where they
    run.  An aperture's rows meet in one task (components x populations x wavelengths numbers), for which the tensor is
    shuffled once a sweep: the other solvers scale further.
    """
    tracker = tracker or Silent()
    x = np.maximum(start, 0.0)
    history = [system.error(system.residual(x))]
    for sweep in range(sweeps):
        steps = _row_steps(system.columns.place, x, system.weights, rate)
        ended = system.models.select("s", "c", "p", "m").groupBy("s").cogroup(system.data.select("s", "flux").groupBy("s")).applyInArrow(steps, "c long, p long, x double")
        x = np.maximum(system.columns.vector(ended.groupBy("c", "p").agg(F.avg("x").alias("x"))), 0.0)
        history.append(system.error(system.residual(x)))
        tracker.on_epoch_end(sweep + 1, history[-1])
    return x, history


def by_bands(system: System, start: np.ndarray, config: DescentConfig | None = None, tracker: Tracker | None = None) -> tuple[np.ndarray, list[float]]:
    """Block Jacobi: every component's band takes its own preconditioned step within its own trust region; one line search joins them."""
    config, tracker = config or DescentConfig(), tracker or Silent()
    x = np.maximum(start, 0.0)
    errors, norm = materialise(system.residual(x), "residual"), system.norm()
    history = [system.error(errors)]
    for epoch in range(config.epochs):
        g, d = system.gradient(errors)
        scale = np.maximum(d, 1e-24)
        dx = np.where(_frozen(d, system.columns.c, config.freeze), 0.0, np.maximum(g / scale, -x))
        for c in np.unique(system.columns.c):
            of = system.columns.c == c
            dx[of] *= trust_scale(dx[of], scale[of], norm, config.trust)
        taken, after = system.advance(errors, dx)
        if not taken:
            break
        x, errors = np.maximum(x + taken * dx, 0.0), materialise(after, "residual")
        history.append(system.error(errors))
        tracker.on_epoch_end(epoch + 1, history[-1])
    return x, history


def by_tiles(system: System, start: np.ndarray, config: DescentConfig | None = None, tracker: Tracker | None = None, probes: int = 3) -> tuple[np.ndarray, list[float]]:
    """Tile after tile, brightest first: a step on each tile at a falling rate, kept only if the error on some probe tiles does not rise.

    A step that would raise it is halved twice and then given up.  ``max_tiles`` bounds an epoch's tiles.  The history is of
    the whole system, so the last one may be above the best; the best weights are returned.
    """
    config, tracker = config or DescentConfig(), tracker or Silent()
    x, norm = np.maximum(start, 0.0), system.norm()
    size = F.aggregate(F.transform("flux", lambda f: F.when(F.isnan(f) | f.isNull(), 0.0).otherwise(f * f)), F.lit(0.0), lambda s, v: s + v)
    bright = [r["tile"] for r in system.data.groupBy("tile").agg(F.sum(size).alias("n")).orderBy(F.desc("n"), "tile").collect()]
    order = bright[: config.max_tiles] if config.max_tiles else bright
    watched = system.of_tiles(sorted({bright[k * (len(bright) - 1) // max(probes - 1, 1)] for k in range(min(probes, len(bright)))}))
    best, history = (system.error(system.residual(x)), x), []
    history.append(best[0])
    for epoch in range(config.epochs):
        seen = watched.error(watched.residual(x))
        for k, tile in enumerate(order):
            rate = cosine_rate(config.rate, k, len(order), config.rate / 10)
            part = system.of_tiles([tile])
            errors = materialise(part.residual(x), "tile-residual")
            g, d = part.gradient(errors)
            scale = np.maximum(d, 1e-24)
            dx = np.where(_frozen(d, system.columns.c, config.freeze), 0.0, np.maximum(rate * g / scale, -x))
            dx = dx * trust_scale(dx, scale, norm, config.trust)
            for factor in (1.0, 0.5, 0.25):
                tried = np.maximum(x + factor * dx, 0.0)
                now = watched.error(watched.residual(tried))
                if now <= seen:
                    x, seen = tried, now
                    break
            tracker.on_progress(k + 1, len(order))
            tracker.on_batch_rmse(seen)
        history.append(system.error(system.residual(x)))
        tracker.on_epoch_end(epoch + 1, history[-1])
        if history[-1] < best[0]:
            best = (history[-1], x)
    return best[1], history


def with_probes(system: System, start: np.ndarray, config: DescentConfig | None = None, tracker: Tracker | None = None, probes: int = 3) -> tuple[np.ndarray, list[float]]:
    """Global steps judged on probe tiles: the quadratic through the error at 0, and the step's slope and bend there, gives its length.

    A component whose whole gradient changes sign against the last epoch is held for one epoch, and an epoch in which more
    than half of the used columns would fall to zero is given up.
    """
    config, tracker = config or DescentConfig(), tracker or Silent()
    x, norm = np.maximum(start, 0.0), system.norm()
    tiles = system.tiles()
    watched = system.of_tiles(sorted({tiles[k * (len(tiles) - 1) // max(probes - 1, 1)] for k in range(min(probes, len(tiles)))}))
    history, before = [system.error(system.residual(x))], None
    for epoch in range(config.epochs):
        errors = materialise(system.residual(x), "residual")
        g, d = system.gradient(errors)
        g = g - config.ridge * x
        signs = {int(c): float(np.sign(g[system.columns.c == c].sum())) for c in np.unique(system.columns.c)}
        held = np.array([before is not None and before[int(c)] * signs[int(c)] < 0 for c in system.columns.c])
        before = signs
        scale = np.maximum(d + config.ridge, 1e-24)
        dx = np.where(held | _frozen(d, system.columns.c, config.freeze), 0.0, np.maximum(g / scale, -x))
        dx = dx * trust_scale(dx, scale, norm, config.trust)
        taken, _ = watched.advance(materialise(watched.residual(x), "probe-residual"), dx)
        tried = np.maximum(x + taken * dx, 0.0)
        if not taken or (x > 0).sum() > 1 and ((x > 0) & (tried <= 0)).sum() > 0.5 * (x > 0).sum():
            break
        now = system.error(system.residual(tried))
        if now > history[-1]:
            break
        x = tried
        history.append(now)
        tracker.on_epoch_end(epoch + 1, now)
    return x, history


SOLVERS = {"spg": descend, "bands": by_bands, "tiles": by_tiles, "probes": with_probes}
