"""From a store to a saved solution in one call: seed, prior, solver, projection, polish, provenance."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import from_unit_flux
from ..operators.sampling import seeded_choice
from ..sources.store import Store
from .descend import SOLVERS, DescentConfig, System, Tracker, row_action
from .diagnose import gate
from .serve import solution_digest
from .solve import SolverConfig, nnls_active_set, normal_equations

log = logging.getLogger("lumenframe")

#: The names under which solutions are kept, in the order in which a run resumes from them and a report shows them.
RESUME = ("last", "epoch_last", "global", "best", "legacy")
DISPLAY = ("best", "last", "epoch_last", "snapshot", "history", "latest", "global")
#: Slots of the ring of snapshots.
RING = 96


@dataclass
class MixConfig:
    """How a solution's mix of components is held to the prior."""

    strength: float = 0.2
    least: float = 1e-12
    every_epoch: bool = False
    strict_end: bool = True


@dataclass
class RunConfig:
    """Everything that a run can be told; ``from_conf`` reads the same names from the session and the environment."""

    solver: str = "spg"
    epochs: int = 3
    rate: float = 0.1
    trust: float = 0.5
    ridge: float = 0.0
    seed: str = "jacobi"
    seed_apertures: int = 16
    pick: str = "energy"
    random_seed: int = 12345
    resume: bool = True
    prior: bool = True
    polish_epochs: int = 1
    max_tiles: int = 0
    norm_mode: str = "model"

    @classmethod
    def from_conf(cls, spark: SparkSession, prefix: str = "lumenframe") -> RunConfig:
        """Values of ``spark.<prefix>.<name>``, else of the environment's ``<PREFIX>_<NAME>``, else the defaults; one that cannot be read is an error."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.{prefix}.{f.name}", None) or os.environ.get(f"{prefix}_{f.name}".upper())
            if text is not None:
                found[f.name] = setting(text, type(f.default))
        return cls(**found)


def setting(text: str, kind: type):
    """A written value as a number, a truth value or a text."""
    if kind is bool:
        if text.strip().lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"neither true nor false: {text}")
        return text.strip().lower() in ("1", "true", "yes", "on")
    return kind(text)


def assert_norm_mode(store: Store, expect: str = "model") -> None:
    """Refuses a tensor whose columns are scaled otherwise than the solver expects."""
    found = store.metadata().get("norm_mode")
    if found != expect:
        raise ValueError(f"the tensor is in {found} mode, {expect} is expected")


def save_solution(store: Store, run_id: str, weights: DataFrame, epoch: int, rmse: float, **provenance: object) -> None:
    """Appends a solution under a name, and says in the metadata where it came from."""
    store.write("solution", weights.select(F.lit(run_id).alias("run_id"), F.lit(epoch).alias("epoch"), F.lit(float(rmse)).alias("rmse"), "c", "p", "x"), mode="append")
    told = {"epoch": epoch, "rmse": rmse if np.isfinite(rmse) else None, "saved": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **provenance}
    store.set_metadata(**{f"solution.{run_id}": told})


def saved_weights(store: Store, order: Sequence[str] = RESUME) -> tuple[str, DataFrame] | None:
    """The name and the latest epoch of the first solution of this order that the store has."""
    kept = {r["run_id"]: r["epoch"] for r in store.table("solution").groupBy("run_id").agg(F.max("epoch").alias("epoch")).collect()}  # a row a name
    for name in order:
        if name in kept:
            rows = store.table("solution").where((F.col("run_id") == name) & (F.col("epoch") == kept[name]))
            return name, rows.groupBy("c", "p").agg(F.max("x").alias("x"))
    return None


def ring_weights(store: Store, slot: int, physical: DataFrame | None = None) -> DataFrame:
    """The latest snapshot in one slot of the ring; with reference fluxes, in the scale of the columns before they were divided by these."""
    rows = store.table("solution").where((F.col("run_id") == "snapshot") & (F.col("epoch") % RING == slot % RING))
    last = rows.agg(F.max("epoch")).first()[0]
    found = rows.where(F.col("epoch") == F.lit(last)).select("c", "p", "x")
    return found if physical is None else from_unit_flux(found, physical)


def prior_weights(store: Store) -> dict[int, float] | None:
    """The prior mix, summed to one: the table of the prior, else the metadata's list, else none."""
    rows = {int(r["c"]): float(r["w"] or 0.0) for r in store.table("comp_prior").groupBy("c").agg(F.sum("w").alias("w")).collect()}  # a row a component
    if not rows:
        rows = {c: float(w) for c, w in enumerate(store.metadata().get("orbit_weights") or [])}
    total = sum(max(w, 0.0) for w in rows.values())
    return {c: max(w, 0.0) / total for c, w in rows.items()} if total > 0 else None


def to_mix(x: np.ndarray, components: np.ndarray, target: dict[int, float], strength: float = 1.0, least: float = 1e-12, seed: int | None = None) -> np.ndarray:
    """Weights drawn toward a mix of components, the whole mass kept.

    With a seed, a component of the prior that has no mass gets its share over its populations in proportions that the
    seed draws; without, it stays empty.
    """
    x, total = np.maximum(x, 0.0), float(np.maximum(x, 0.0).sum())
    if total <= 0:
        return x
    out = x.copy()
    draw = np.random.default_rng(seed).dirichlet if seed is not None else None
    for c in np.unique(components):
        of = components == c
        mass, want = float(x[of].sum()), max(target.get(int(c), 0.0), least) * total
        if mass > 0:
            out[of] = x[of] * ((1 - strength) + strength * want / mass)
        elif draw is not None:
            out[of] = strength * want * draw(np.ones(of.sum()))
    return out * (total / out.sum()) if out.sum() > 0 else x


def pick_apertures(store: Store, n: int, mode: str = "energy", seed: int = 12345) -> DataFrame:
    """Apertures (s) for a seed: those with the most energy, or by chance."""
    add = F.aggregate(F.transform("flux", lambda f: F.when(F.isnan(f) | f.isNull(), 0.0).otherwise(f * f)), F.lit(0.0), lambda a, v: a + v)
    rows = store.table("spectra").select("s", add.alias("energy"))
    if mode == "energy":
        return rows.orderBy(F.desc("energy"), "s").limit(n).select("s")
    if mode == "random":
        return seeded_choice(rows, "s", n, seed).select("s")
    raise ValueError(f"no such way to pick: {mode}")


def _long(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != value], F.posexplode(value).alias("l", name)).withColumn("l", F.col("l").cast("long"))


def patch_seed(store: Store, n: int, mode: str = "energy", seed: int = 12345) -> DataFrame:
    """Non-negative least squares on a few apertures' models: weights (c, p, x)."""
    some = F.broadcast(pick_apertures(store, n, mode, seed))  # n rows
    kept = store.mask().where("keep").select(F.col("l").cast("long").alias("l"))
    tiles = sorted({r["s"] // store.tile_size for r in some.collect()})
    models = _long(store.table("models").where(F.col("tile").isin(tiles)).join(some, "s", "left_semi").select("s", "c", "p", "m"), "m", "m").join(F.broadcast(kept), "l")
    data = _long(store.table("spectra").join(some, "s", "left_semi").select("s", "flux"), "flux", "flux").join(F.broadcast(kept), "l").where(~F.isnan("flux"))
    eq = normal_equations(models, data)
    frame = [(*k, float(v)) for k, v in zip(eq.keys, nnls_active_set(eq.g, eq.b), strict=True)]
    return store.spark.createDataFrame(frame, models.select("c", "p").schema.add("x", "double"))


def system_of(store: Store) -> System:
    """The store's tensor and data, weighted by the mask."""
    rows = store.mask().orderBy("l").collect()  # one axis
    weights = np.array([float(r["weight"] if r["keep"] else 0.0) for r in rows]) if rows else None
    return System(store.table("models"), store.table("spectra"), weights, store.tile_size)


def start_weights(store: Store, system: System, config: RunConfig) -> tuple[str, np.ndarray]:
    """Where the start came from, and the weights: a saved solution, else the seed that is asked for."""
    if config.resume and (kept := saved_weights(store, RESUME)) is not None:
        return kept[0], system.columns.vector(kept[1])
    if config.seed == "nnls":
        x = system.columns.vector(patch_seed(store, config.seed_apertures, config.pick, config.random_seed))
    elif config.seed == "jacobi":
        g, d = system.gradient(system.residual(np.zeros(len(system.columns))))
        x = np.where(d > 0, np.maximum(g, 0.0) / np.maximum(d, 1e-300), 0.0) / max(len(system.columns), 1)
    elif config.seed == "zero":
        x = np.zeros(len(system.columns))
    else:
        raise ValueError(f"no such seed: {config.seed}")
    target = prior_weights(store) if config.prior else None
    return config.seed, x if target is None else to_mix(x, system.columns.c, target, seed=config.random_seed)


def _solve(system: System, x: np.ndarray, config: RunConfig, descent: DescentConfig, tracker: Tracker | None) -> tuple[np.ndarray, list[float]]:
    if config.solver == "rows":
        return row_action(system, x, descent.epochs, descent.rate, tracker)
    if config.solver not in SOLVERS:
        raise ValueError(f"no such solver: {config.solver}")
    return SOLVERS[config.solver](system, x, descent, tracker)


def solve_all(store: Store, config: RunConfig | None = None, mix: MixConfig | None = None, tracker: Tracker | None = None) -> DataFrame:
    """Solves for the weights of all columns and saves them; returns (c, p, x).

    The store must be complete, sound and in the expected mode.  The result is kept as ``last`` with its error and where
    it started, and as ``best`` if no kept one is better.
    """
    config, mix, began = config or RunConfig(), mix or MixConfig(), time.monotonic()
    gate(store)
    assert_norm_mode(store, config.norm_mode)
    system = system_of(store)
    source, x = start_weights(store, system, config)
    target = prior_weights(store) if config.prior else None
    project = (lambda v: to_mix(v, system.columns.c, target, mix.strength, mix.least)) if target is not None and mix.every_epoch else None
    descent = DescentConfig(epochs=config.epochs, rate=config.rate, trust=config.trust, ridge=config.ridge, max_tiles=config.max_tiles or None, project=project)
    x, history = _solve(system, x, config, descent, tracker)
    log.info("solved from %s in %d epochs: %.6g to %.6g", source, len(history) - 1, history[0], history[-1])
    return _save(store, system, x, history[-1], source, config, began)


def solve_all_batched(store: Store, config: RunConfig | None = None, mix: MixConfig | None = None, tracker: Tracker | None = None) -> DataFrame:
    """solve_all() an epoch at a time, each saved as ``epoch_last``, so that a lost driver resumes; then the strict mix and a polish on some tiles."""
    config, mix, began = config or RunConfig(), mix or MixConfig(), time.monotonic()
    gate(store)
    assert_norm_mode(store, config.norm_mode)
    system = system_of(store)
    source, x = start_weights(store, system, config)
    target = prior_weights(store) if config.prior else None
    before = store.table("solution").where("run_id = 'epoch_last'").agg(F.max("epoch")).first()[0] or 0
    rmse = system.error(system.residual(x))
    for epoch in range(1, config.epochs + 1):
        one = DescentConfig(epochs=1, rate=config.rate, trust=config.trust, ridge=config.ridge, max_tiles=config.max_tiles or None)
        x, history = _solve(system, x, config, one, None)
        if target is not None and mix.every_epoch:
            x = to_mix(x, system.columns.c, target, mix.strength, mix.least)
            history = [*history, system.error(system.residual(x))]
        rmse = history[-1]
        save_solution(store, "epoch_last", system.columns.frame(system.models, x), before + epoch, rmse, source=source)
        if tracker is not None:
            tracker.on_epoch_end(epoch, rmse)
        if len(history) < 2:
            break
    if target is not None and mix.strict_end:
        x = to_mix(x, system.columns.c, target, 1.0, mix.least)
        if config.polish_epochs:
            tiles = system.tiles()
            most = config.max_tiles or max(1, len(tiles) // 10)
            part = system.of_tiles([tiles[k * (len(tiles) - 1) // max(most - 1, 1)] for k in range(min(most, len(tiles)))])
            hold = lambda v: to_mix(v, system.columns.c, target, 1.0, mix.least)
            x, _ = SOLVERS["spg"](part, x, DescentConfig(epochs=config.polish_epochs, rate=config.rate, trust=config.trust, project=hold), None)
        rmse = system.error(system.residual(x))
    return _save(store, system, x, rmse, source, config, began)


def _save(store: Store, system: System, x: np.ndarray, rmse: float, source: str, config: RunConfig, began: float) -> DataFrame:
    weights = system.columns.frame(system.models, x)
    kept = {r["run_id"]: r for r in store.table("solution").groupBy("run_id").agg(F.max("epoch").alias("epoch"), F.min("rmse").alias("rmse")).collect()}
    told = {"source": source, "solver": config.solver, "elapsed_sec": round(time.monotonic() - began, 3), "settings": asdict(config)}
    save_solution(store, "last", weights, (kept["last"]["epoch"] if "last" in kept else 0) + 1, rmse, **told)
    if "best" not in kept or rmse <= kept["best"]["rmse"]:
        save_solution(store, "best", weights, (kept["best"]["epoch"] if "best" in kept else 0) + 1, rmse, **told)
    store.set_metadata(x_digest=solution_digest(weights).first()["digest"])
    return weights


def solver_config(config: RunConfig) -> SolverConfig:
    """The same settings for the solvers on long tables."""
    return replace(SolverConfig(), epochs=config.epochs, rate=config.rate, trust=config.trust, ridge=config.ridge)
