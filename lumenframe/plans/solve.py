"""Global non-negative least squares.

Two ways.  With few columns (their number is checked) Spark sums the normal
equations once, G = A'WA, b = A'Wy, and the driver iterates on them without
further jobs.  With many, each epoch is one pass: residual, gradient and
diagonal in Spark, a step on the column table, a line search from three sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contraction import gradient, predict, residual
from ..sources.workspace import materialise

#: Columns up to which the normal equations go to the driver: 5,000 need 200 MB.
MOST_COLUMNS = 5000


@dataclass
class SolverConfig:
    epochs: int = 3
    rate: float = 0.1
    trust: float = 0.5
    floor: float = 1e-6
    ridge: float = 0.0
    tol: float = 1e-10


@dataclass
class NormalEquations:
    keys: list[tuple]
    g: np.ndarray
    b: np.ndarray
    yy: float

    def objective(self, x: np.ndarray) -> float:
        return float(self.yy - 2 * self.b @ x + x @ self.g @ x)


def _products(place: dict[tuple, int]):
    """Rows (s, l, k1, k2, m) sorted by s: A'A summed over a task's apertures, a row of it for each column that occurs."""
    n = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, now = np.zeros((n, n)), [], None

        def close() -> None:
            at, column, value = (np.concatenate(x) for x in zip(*held, strict=True))
            rows, row_of = np.unique(at, return_inverse=True)
            dense = np.zeros((len(rows), n))
            np.add.at(dense, (row_of, column), value)
            used = np.flatnonzero(dense.any(axis=0))
            g[np.ix_(used, used)] += dense[:, used].T @ dense[:, used]

        for batch in batches:
            if not batch.num_rows:
                continue
            s, at, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
            column = np.array([place[k] for k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], dtype=np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and s[a] != now:
                    close()
                    held.clear()
                now = s[a]
                held.append((at[a:b], column[a:b], m[a:b].astype(float)))
        if held:
            close()
        used = np.flatnonzero(g.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_pydict({"i": pa.array(used, pa.int64()), "g": pa.array([r.astype("<f8").tobytes() for r in g[used]], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of A'A that tasks sent."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.frombuffer(raw, dtype="<f8")
            total[i] = total[i] + row if i in total else row
    yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int64()), "g": pa.array([r.tobytes() for r in total.values()], pa.binary())})


def normal_equations(models: DataFrame, data: DataFrame, keys: tuple[str, str] = ("c", "p")) -> NormalEquations:
    """Sums A'A, A'y and y'y; refuses more columns than the driver should hold.

    An aperture's rows meet in one task, which adds a dense product; pairs of columns are never rows.
    """
    order = sorted(tuple(r) for r in models.select(*keys).distinct().limit(MOST_COLUMNS + 1).collect())
    if len(order) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns: use solve_by_epochs")
    place = {k: i for i, k in enumerate(order)}
    g, b = np.zeros((len(order), len(order))), np.zeros(len(order))
    rows = models.select(F.col("s").cast("long"), F.col("l").cast("long"), *keys, F.col("m").cast("double"))
    parts = rows.repartition("s").sortWithinPartitions("s").mapInArrow(_products(place), "i long, g binary")
    for r in parts.repartition("i").mapInArrow(_added, "i long, g binary").toLocalIterator():  # a row a column, 200 MB at most
        g[r["i"]] = np.frombuffer(bytes(r["g"]), dtype="<f8")
    for r in models.join(data.select("s", "l", "flux"), ["s", "l"]).groupBy(*keys).agg(F.sum(F.col("m") * F.col("flux")).alias("b")).collect():
        b[place[tuple(r)[:2]]] = r["b"]
    yy = data.agg(F.sum(F.col("flux") * F.col("flux"))).first()[0] or 0.0
    return NormalEquations(order, g, b, float(yy))


def nnls_active_set(g: np.ndarray, b: np.ndarray, tol: float = 1e-10, ridge: float = 0.0) -> np.ndarray:
    """Lawson and Hanson's method on the normal equations."""
    g = g + ridge * np.eye(len(b))
    x, passive = np.zeros(len(b)), np.zeros(len(b), dtype=bool)
    scale = max(float(np.abs(b).max(initial=0.0)), 1e-300)
    for _ in range(3 * len(b) + 10):
        w = b - g @ x
        free = ~passive & (w > tol * scale)
        if not free.any():
            break
        passive[np.argmax(np.where(free, w, -np.inf))] = True
        while True:
            z = np.zeros(len(b))
            z[passive] = np.linalg.lstsq(g[np.ix_(passive, passive)], b[passive], rcond=None)[0]
            if (z[passive] > 0).all():
                x = z
                break
            bad = passive & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-14 * max(x.max(), 1e-300)
            x[~passive] = 0.0
    return x


def nnls_projected(g: np.ndarray, b: np.ndarray, rounds: int = 2000, accelerate: bool = True, ridge: float = 0.0) -> np.ndarray:
    """Projected gradient on columns of unit length, with Nesterov's momentum and restarts."""
    n = np.sqrt(np.maximum(np.diag(g), 1e-300))
    gn, bn = g / np.outer(n, n) + ridge * np.eye(len(b)), b / n
    bound = np.linalg.eigvalsh(gn)[-1] if len(b) else 1.0
    z = y = np.zeros(len(b))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - (gn @ y - bn) / bound)
        if accelerate and (new - z) @ (y - new) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - z) if accelerate else new
        if np.abs(new - z).max(initial=0.0) < 1e-14:
            z = new
            break
        z, t = new, t_new
    return z / n


def nnls_multiplicative(g: np.ndarray, b: np.ndarray, rounds: int = 10, start: np.ndarray | None = None) -> np.ndarray:
    x = np.maximum(start if start is not None else np.ones(len(b)), 1e-12)
    for _ in range(rounds):
        x = x * np.maximum(b, 0) / np.maximum(np.maximum(g, 0) @ x, 1e-30)
    return x


SOLVERS = {"nnls": nnls_active_set, "fista": nnls_projected, "pg": lambda g, b, ridge=0.0: nnls_projected(g, b, accelerate=False, ridge=ridge), "lsq": lambda g, b, ridge=1e-10: nnls_active_set(g, b, ridge=ridge), "mu": lambda g, b, ridge=0.0: nnls_multiplicative(g, b, 500)}


def working_set(eq: NormalEquations, per_component: int = 32, coherence: float = 0.995, rounds: int = 4, grow: int = 16, tol: float = 1e-6) -> np.ndarray:
    """Solves on the columns with the largest correlation of each component, adds those that the optimality conditions name, drops near copies."""
    n = np.sqrt(np.maximum(np.diag(eq.g), 1e-300))
    cos = np.abs(eq.g) / np.outer(n, n)
    score = eq.b / n
    chosen: list[int] = []

    def add(candidates: list[int], most: int) -> bool:
        counts: dict = {}
        grown = False
        for i in candidates:
            c = eq.keys[i][0]
            if counts.get(c, 0) < most and i not in chosen and (not chosen or cos[i, chosen].max() <= coherence):
                chosen.append(i)
                counts[c] = counts.get(c, 0) + 1
                grown = True
        return grown

    add([i for i in np.argsort(-score, kind="stable") if score[i] > 0], per_component)
    x = np.zeros(len(eq.b))
    for _ in range(rounds):
        x = np.zeros(len(eq.b))
        x[chosen] = nnls_active_set(eq.g[np.ix_(chosen, chosen)], eq.b[chosen])
        g = eq.g @ x - eq.b
        if not add([i for i in np.argsort(g, kind="stable") if g[i] < -tol and x[i] == 0], grow):
            break
    return x


def prune(eq: NormalEquations, x: np.ndarray, coherence: float = 0.995) -> np.ndarray:
    """Keeps columns in the order of their weights unless a kept one is too like them, and solves again on what is left."""
    n = np.sqrt(np.maximum(np.diag(eq.g), 1e-300))
    cos = np.abs(eq.g) / np.outer(n, n)
    kept: list[int] = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] > 0 and (not kept or cos[i, kept].max() <= coherence):
            kept.append(int(i))
    out = np.zeros(len(x))
    if kept:
        out[kept] = nnls_active_set(eq.g[np.ix_(kept, kept)], eq.b[kept])
    return out


def cosine_rate(rate: float, step: int, steps: int, least: float = 0.0) -> float:
    """The rate of a step, falling along half a cosine from the first to the last."""
    part = 0.0 if steps <= 1 else min(max(step / (steps - 1), 0.0), 1.0)
    return least + (rate - least) * 0.5 * (1 + float(np.cos(np.pi * part)))


def barzilai_borwein(dx: np.ndarray, dg: np.ndarray, otherwise: float) -> float:
    """Step length from the last change of the weights and of the gradient."""
    curve = float(dx @ dg)
    return float(dx @ dx) / curve if curve > 1e-300 else otherwise


def trust_scale(dx: np.ndarray, energy: np.ndarray, norm: float, trust: float = 0.5) -> float:
    """Factor that keeps a step's energy within (trust * norm)^2."""
    size = float(np.sqrt(np.sum(dx * dx * energy)))
    return 1.0 if size <= trust * norm else trust * norm / size


def break_symmetry(solution: DataFrame, eps: float = 1e-6, seed: int = 7) -> DataFrame:
    """Adds small positive noise that a hash of the column makes, so that equal columns part; the same every time."""
    noise = F.pmod(F.xxhash64(F.lit(seed), "c", "p"), F.lit(1_000_003)) / 1_000_003
    return solution.select("c", "p", (F.col("x") + eps * noise).alias("x"))


def jacobi_seed(models: DataFrame, data: DataFrame, eps: float = 1e-12) -> DataFrame:
    """max(0, b / d) of each column from one pass over mean-centred models and data."""
    means = models.groupBy("s", "c", "p").agg(F.avg("m").alias("mm"))
    centred = models.join(means, ["s", "c", "p"]).withColumn("m", F.col("m") - F.col("mm"))
    own = data.join(data.groupBy("s").agg(F.avg("flux").alias("mf")), "s").withColumn("r", F.col("flux") - F.col("mf"))
    sums = gradient(centred, own)
    return sums.select("c", "p", F.greatest(F.col("g") / (F.col("d") + eps), F.lit(0.0)).alias("x"), (F.abs("g") / F.sqrt(F.greatest("d", F.lit(1e-300)))).alias("score"))


def solve_by_epochs(models: DataFrame, data: DataFrame, start: DataFrame, config: SolverConfig | None = None) -> tuple[DataFrame, list[float]]:
    """Preconditioned projected gradient; the objective never rises.  Returns the solution and the RMSE before and after each epoch.

    The column table stays in Spark, written once an epoch, so neither the driver nor the plan grows.
    """
    config = config or SolverConfig()
    x, history = materialise(start.select("c", "p", "x"), "x"), []
    n = data.count()
    errors = materialise(residual(data, predict(models, x)), "residual")
    history.append(float(np.sqrt((errors.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0) / max(n, 1))))
    for _ in range(config.epochs):
        grads = gradient(models, errors)
        floor = grads.where("d > 0").agg(F.percentile_approx("d", F.lit(0.9))).first()[0] or 1.0
        step = x.join(grads, ["c", "p"], "left").select("c", "p", "x", F.coalesce(F.col("g") / F.greatest("d", F.lit(config.floor * floor)), F.lit(0.0)).alias("dx"))
        step = materialise(step.withColumn("dx", F.greatest(F.col("dx"), -F.col("x"))), "step")
        move = predict(models, step.select("c", "p", F.col("dx").alias("x"))).withColumnRenamed("yhat", "move")
        both = errors.join(move, ["s", "l"], "left").withColumn("move", F.coalesce("move", F.lit(0.0)))
        cross, own = both.agg(F.sum(F.col("r") * F.col("move")), F.sum(F.col("move") * F.col("move"))).first()
        a = float(np.clip((cross or 0.0) / own, 0.0, 1.0)) if own else 0.0
        if a <= config.tol:
            break
        x = materialise(step.select("c", "p", F.greatest(F.col("x") + a * F.col("dx"), F.lit(0.0)).alias("x")), "x")
        errors = materialise(both.withColumn("r", F.col("r") - a * F.col("move")).select(*errors.columns), "residual")
        history.append(float(np.sqrt((errors.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0) / max(n, 1))))
    return x, history


def solution_frame(models: DataFrame, eq: NormalEquations, x: np.ndarray) -> DataFrame:
    return models.sparkSession.createDataFrame([(*k, float(v)) for k, v in zip(eq.keys, x, strict=True)], models.select("c", "p").schema.add("x", "double"))
