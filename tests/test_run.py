"""From a store to a saved solution, the solvers that leave the tensor where it is, and the reports."""

import numpy as np
import pytest

from lumenframe.__main__ import main
from lumenframe.plans import build, descend, diagnose, run
from lumenframe.sources.store import Store
from lumenframe.streaming.recorder import Recorder

LIGHT = 299792.458


def cube_arrays(seed=3, s=6, c=2, p=3, n=48):
    """A small cube whose spectra are known sums of the models."""
    r = np.random.default_rng(seed)
    step = 2.0e-4
    observed = 8.6 + step * np.arange(n)
    template = 8.6 + step * np.arange(-120, n + 120)
    velocities = np.linspace(-400, 400, 15)
    losvd = np.zeros((s, len(velocities), c))
    for a in range(s):
        for k in range(c):
            losvd[a, :, k] = (1 + 0.3 * a) * np.exp(-0.5 * ((velocities - (k * 300 - 150)) / (80 + 20 * k)) ** 2)
    templates = np.stack([1 + 0.4 * np.sin(np.arange(len(template)) / (3 + 2 * k)) + 0.1 * r.random(len(template)) for k in range(p)], axis=1).reshape(len(template), p, 1, 1)
    return observed, template, velocities, losvd, templates


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    observed, template, velocities, losvd, templates = cube_arrays()
    store = Store(spark, str(tmp_path_factory.mktemp("run") / "store"), tile_size=2)
    flat = np.ones((len(observed), losvd.shape[0]))
    mask = np.ones(len(observed), bool)
    mask[5:8] = False
    args = dict(losvd=losvd, templates=templates, template_log=template, observed_log=observed, velocities=velocities, mask=mask, prior=[0.6, 0.4])
    store.ingest(spectra=flat, **args)
    assert build.build(store, pad=2) == 3
    truth = {(0, 0): 2.0, (0, 2): 1.0, (1, 1): 1.5}
    spectra = np.zeros_like(flat)
    for r in store.table("models").collect():
        spectra[:, r["s"]] += truth.get((r["c"], r["p"]), 0.0) * np.array(r["m"])
    spectra[20, 1] = np.nan
    rows = [(s, spectra[:, s].tolist()) for s in range(spectra.shape[1])]
    store.write("spectra", spark.createDataFrame(rows, "s long, flux array<double>"))
    return store, truth, spectra


def dense(store):
    """The tensor as a matrix (s l) x columns, and the columns."""
    rows = store.table("models").collect()
    keys = sorted({(r["c"], r["p"]) for r in rows})
    at = {(r["s"], r["c"], r["p"]): np.array(r["m"], dtype=float) for r in rows}
    apertures = sorted({r["s"] for r in rows})
    return np.concatenate([np.stack([at[s, *k] for k in keys], axis=1) for s in apertures]), keys


def test_passes_equal_matrix_products(built, monkeypatch):
    store, _, spectra = built
    system = run.system_of(store)
    a, keys = dense(store)
    assert list(zip(system.columns.c.tolist(), system.columns.p.tolist(), strict=True)) == keys
    x = np.random.default_rng(1).random(len(keys))
    yhat = np.concatenate([np.array(r["yhat"]) for r in system.predict(x).orderBy("s").collect()])
    assert np.allclose(yhat, a @ x)
    y, w = spectra.T.reshape(-1), np.tile(system.weights, spectra.shape[1])
    w = np.where(np.isfinite(y), w, 0.0)
    r = np.where(w > 0, np.nan_to_num(y) - a @ x, 0.0)
    errors = system.residual(x)
    assert np.isclose(system.error(errors), np.sqrt((w * r * r).sum() / w.sum()))
    g, d = system.gradient(errors)
    assert np.allclose(g, a.T @ (w * r)) and np.allclose(d, (a * a).T @ w)
    monkeypatch.setattr(descend, "BLOCK_BYTES", 1)  # a block for each tile
    assert np.allclose(system.gradient(errors), (g, d))
    part = system.of_tiles([1])
    assert part.residual(x).count() == 2 and part.tiles() == [1]


@pytest.mark.parametrize("solver", ["spg", "bands", "probes"])
def test_solvers_lower_the_error(built, solver):
    store, _, _ = built
    system = run.system_of(store)
    heard = []

    class Listener(descend.Silent):
        def on_epoch_end(self, epoch, rmse):
            heard.append((epoch, rmse))

    start = np.full(len(system.columns), 0.1)
    x, history = descend.SOLVERS[solver](system, start, descend.DescentConfig(epochs=4, rate=1.0, trust=2.0), Listener())
    assert (x >= 0).all() and all(b <= a * (1 + 1e-9) for a, b in zip(history, history[1:], strict=False))
    assert history[-1] < 0.6 * history[0] and len(heard) == len(history) - 1 and heard[-1][1] == history[-1]


def test_tiles_and_row_actions(built):
    store, _, _ = built
    system = run.system_of(store)
    start = np.full(len(system.columns), 0.1)
    x, history = descend.by_tiles(system, start, descend.DescentConfig(epochs=1, rate=1.0, trust=2.0, max_tiles=2))
    assert (x >= 0).all() and min(history) < history[0]
    x, history = descend.row_action(system, start, 1, 0.5)
    assert (x >= 0).all() and history[-1] < history[0]


def test_a_run_from_seed_to_solution(built):
    store, truth, _ = built
    config = run.RunConfig(seed="nnls", seed_apertures=3, epochs=1, prior=False)
    weights = {(r["c"], r["p"]): r["x"] for r in run.solve_all(store, config).collect()}
    for key, x in weights.items():
        assert abs(x - truth.get(key, 0.0)) < 0.05, (key, x)
    meta = store.metadata()["solution.last"]
    assert meta["source"] == "nnls" and meta["settings"]["solver"] == "spg" and meta["rmse"] < 1e-2
    name, kept = run.saved_weights(store, run.RESUME)
    assert name == "last" and kept.count() == len(weights) and run.saved_weights(store, run.DISPLAY)[0] == "best"
    batched = run.solve_all_batched(store, run.RunConfig(epochs=1, max_tiles=1))
    target, total = run.prior_weights(store), batched.agg({"x": "sum"}).first()[0]
    shares = {r["c"]: r["m"] / total for r in batched.groupBy("c").agg({"x": "sum"}).withColumnRenamed("sum(x)", "m").collect()}
    assert all(abs(shares[c] - t) < 0.05 for c, t in target.items())
    assert run.saved_weights(store, ("epoch_last",)) is not None
    with pytest.raises(ValueError):
        run.solve_all(store, run.RunConfig(norm_mode="data"))
    with pytest.raises(ValueError):
        run.solve_all(store, run.RunConfig(solver="none"))


def test_mix_keeps_the_mass():
    c = np.array([0, 0, 1, 2, 2])
    x = np.array([1.0, 3.0, 4.0, 0.0, 0.0])
    full = run.to_mix(x, c, {0: 0.5, 1: 0.25, 2: 0.25}, 1.0, seed=1)
    assert np.isclose(full.sum(), 8) and np.isclose(full[:2].sum(), 4) and np.isclose(full[3:].sum(), 2) and np.isclose(full[1] / full[0], 3)
    assert (run.to_mix(x, c, {0: 0.5, 1: 0.25, 2: 0.25}, 1.0, seed=1) == full).all()
    assert run.to_mix(x, c, {0: 1.0}, 1.0)[3:].sum() == 0 and (run.to_mix(0 * x, c, {0: 1.0}) == 0).all()


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("LUMENFRAME_EPOCHS", "7")
    spark.conf.set("spark.lumenframe.prior", "off")
    try:
        config = run.RunConfig.from_conf(spark)
        assert config.epochs == 7 and config.prior is False and config.rate == 0.1
        spark.conf.set("spark.lumenframe.prior", "maybe")
        with pytest.raises(ValueError):
            run.RunConfig.from_conf(spark)
    finally:
        spark.conf.unset("spark.lumenframe.prior")


def test_reports(built):
    store, _, spectra = built
    system = run.system_of(store)
    assert diagnose.projector_test(system) < 1e-9
    x = np.full(len(system.columns), 1.0)
    told = diagnose.solution_report(system, x)
    assert told["rmse_scaled"] <= told["rmse"] and told["n_used"] == len(x) and 0 < told["largest_share"] <= 1
    one = diagnose.probe_tile(system, 0, x)
    assert 0 < one["scale"] <= 1 and one["rmse"] > 0 and one["norm"] > 0
    assert diagnose.convolution_gate(store, 0, 0)["relative"] < 2e-3
    row = diagnose.wavelength_checks(store, 2).collect()[0]
    assert row["rising"] and row["constant_error"] < 1e-9 and row["best"] > 0.9
    seen = {(r["s"], r["c"]): r for r in diagnose.inspect(store, [0, 3]).collect()}
    assert set(seen) == {(0, 0), (0, 1), (3, 0), (3, 1)} and seen[0, 0]["models"] == 3 and seen[3, 1]["mean"] > seen[3, 0]["mean"]
    with pytest.raises(ValueError):
        diagnose.column_energies(store)
    assert diagnose.column_energies(store, strict=False).isEmpty()


def test_recorder(built):
    store, _, _ = built
    recorder = Recorder(store, most=3)
    for k in range(5):
        recorder.on_batch_rmse(1.0 / (k + 1))
    assert recorder.dropped == 2 and recorder.flush() == 3
    recorder.on_progress(1, 2)
    recorder.on_epoch_end(1, 0.25)
    recorder.set_prior({0: 0.5, 1: 0.5})
    weights = run.system_of(store).columns.frame(store.table("models"), np.arange(6.0))
    assert recorder.maybe_snapshot(weights, 0.2) and not recorder.maybe_snapshot(weights, 0.1) and recorder.maybe_snapshot(weights, 0.1, force=True)
    assert {(r["c"], r["p"]): r["x"] for r in run.ring_weights(store, 1).collect()}[1, 2] == 5.0
    halved = store.spark.createDataFrame([(1, 2, 2.0)], "c int, p long, flux_ref double")
    assert {(r["c"], r["p"]): r["x"] for r in run.ring_weights(store, 1, halved).collect()}[1, 2] == 2.5
    recorder.on_epoch_end(2, 0.125)
    assert recorder.close() == 2 and not recorder.put("late")
    told = store.table("tracker_events")
    assert told.where("op = 'epoch_end'").count() == 2 and told.select("seq").distinct().count() == told.count()
    assert {r["epoch"]: r["rmse"] for r in diagnose.metrics(told).where("epoch > 0").collect()} == {1: 0.25, 2: 0.125}
    assert Recorder(store).seq > 7


def test_command_line(built, capsys):
    store, _, _ = built
    assert main(["--tile-size", "2", "--quiet", "build", store.path], store.spark) == 0
    assert main(["--tile-size", "2", "--quiet", "check", store.path], store.spark) == 0
    assert main(["--tile-size", "2", "--quiet", "solve", store.path, "--epochs", "1", "--fresh"], store.spark) == 0
    assert "columns in use" in capsys.readouterr().out
    assert main(["--tile-size", "2", "--quiet", "report", store.path], store.spark) == 0
    assert main(["--tile-size", "2", "--quiet", "inspect", store.path, "--apertures", "1:2"], store.spark) == 0
    assert main(["build", store.path + "-none"], store.spark) == 2
