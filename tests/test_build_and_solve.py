import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import contraction as J
from lumenframe.operators import spectral as P
from lumenframe.operators.shapes import to_long, transpose
from lumenframe.plans import build, serve, solve
from lumenframe.sources.store import Store

S, C, L, T, V = 6, 3, 48, 320, 21


@pytest.fixture(scope="module")
def cube():
    r = np.random.default_rng(5)
    dlog = 2e-4
    template = 8.5 + dlog * np.arange(T)
    observed = template[120] + dlog * 1.3 * np.arange(L)
    velocities = np.linspace(-600, 600, V)
    losvd = np.exp(-0.5 * ((velocities[None, :, None] - r.uniform(-150, 150, (S, 1, C))) / 120) ** 2)
    losvd[1, :, 2] = 0.0
    templates = 1 + np.cumsum(r.normal(0, 0.2, (T, 2, 3, 1)), axis=0) * 0.1
    return {"template": template, "observed": observed, "velocities": velocities, "losvd": losvd, "templates": np.maximum(templates, 0.01), "spectra": r.uniform(1, 2, (L, S))}


@pytest.fixture(scope="module")
def store(spark, cube, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")), tile_size=4)
    s.ingest(spectra=cube["spectra"], losvd=cube["losvd"], templates=cube["templates"], template_log=cube["template"], observed_log=cube["observed"], velocities=cube["velocities"], prior=[1.0, 2.0, 1.0], pixels={"x": [0.0], "y": [1.0], "bin": [3]})
    return s


def test_ingest_is_checked(spark, cube, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="bin"):
        s.ingest(spectra=cube["spectra"], losvd=cube["losvd"], templates=cube["templates"], template_log=cube["template"], observed_log=cube["observed"], velocities=cube["velocities"], pixels={"x": [0.0], "y": [1.0], "bin": [S]})
    with pytest.raises(ValueError, match="increase"):
        s.ingest(spectra=cube["spectra"], losvd=cube["losvd"], templates=cube["templates"], template_log=cube["template"][::-1], observed_log=cube["observed"], velocities=cube["velocities"])


def test_build_and_resume(store):
    assert build.build(store, pad=8) == 2
    assert build.build(store, pad=8) == 0
    rows = store.table("models")
    assert rows.count() == S * C * 6 and rows.where(F.exists("m", lambda v: v < 0)).isEmpty()
    assert serve.issues(store).isEmpty()
    store.set_metadata(complete=False)
    assert build.build(store, pad=8) == 0  # the log already has every tile
    assert store.plane(5).count() == C * 6 and store.apertures("1:2").select("s").distinct().count() == 2


def test_coverage(cube):
    with pytest.raises(ValueError, match="cover"):
        build.check_coverage(cube["template"], cube["observed"], cube["velocities"], 200)


def test_convolution_agrees(cube):
    dlog = float(np.median(np.diff(cube["template"])))
    shifts = P.kernel_shifts(cube["velocities"], dlog)
    kernel = P.unit_kernel(cube["losvd"][0, :, 0], cube["velocities"], shifts, dlog)
    assert abs(kernel.sum() - 1) < 1e-12
    centre = int(np.searchsorted(shifts, 0))
    told = build.preflight(cube["templates"].reshape(T, -1).T, kernel, centre)
    assert told["relative"] < 1e-10 and told["flat"] < 3e-8
    empty = P.unit_kernel(np.zeros(V), cube["velocities"], shifts, dlog)
    assert empty[centre] == 1.0 and empty.sum() == 1.0


def test_rebinning_is_flat(spark):
    axis = P.literal_axis(spark, [float(i) + 0.02 * i * i for i in range(20)])
    edges = P.bin_edges(axis)
    lo, hi = edges.agg(F.min("lo"), F.max("hi")).first()
    new = spark.createDataFrame([(j, lo + (hi - lo) * j / 7, lo + (hi - lo) * (j + 1) / 7) for j in range(7)], "idx long, lo double, hi double")
    for operator in (P.overlap_operator(edges, new), P.overlap_operator(edges, new, bucket=3.0), P.interpolation_operator(axis, P.literal_axis(spark, [0.5, 3.3, 25.0, 30.0]))):
        sums = [r["w"] for r in operator.groupBy("l").agg(F.sum("w").alias("w")).collect()]
        assert sums and max(abs(x - 1) for x in sums) < 1e-9


def test_transpose(spark):
    dense = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "l long, a array<double>")
    assert {r["s"]: r["flux"] for r in transpose(dense, "l", "a").collect()} == {0: [1.0, 3.0], 1: [2.0, 4.0]}


@pytest.fixture(scope="module")
def problem(spark, store):
    build.build(store, pad=8)
    models = to_long(store.table("models"), "m", ["s", "c", "p"], "l", "m").where("p < 4")
    planted = models.select("c", "p").distinct().withColumn("x", F.when((F.col("c") + F.col("p")) % 3 == 0, 0.0).otherwise(1.0 + F.col("c")))
    data = J.predict(models, planted).withColumnRenamed("yhat", "flux")
    return models.cache(), planted, data.cache()


def test_solvers_recover(problem):
    models, planted, data = problem
    eq = solve.normal_equations(models, data)
    truth = {(r["c"], r["p"]): r["x"] for r in planted.collect()}
    for name in ("nnls", "fista", "lsq"):
        x = solve.SOLVERS[name](eq.g, eq.b)
        assert (x >= 0).all() and eq.objective(x) < 1e-6 * eq.yy, name
    x = solve.nnls_active_set(eq.g, eq.b)
    assert (eq.b - eq.g @ x)[x == 0].max(initial=0) < 1e-6 * np.abs(eq.b).max()  # no column wants to grow
    assert len(truth) == len(x)
    w = solve.working_set(eq, coherence=1.1)
    assert eq.objective(w) < 1e-6 * eq.yy


def test_pruning_and_steps(problem):
    _, planted, _ = problem
    g = np.array([[1.0, 0.999, 0.0], [0.999, 1.0, 0.0], [0.0, 0.0, 4.0]])
    eq = solve.NormalEquations([(0, 0), (0, 1), (1, 0)], g, g @ np.array([1.0, 1.0, 2.0]), 100.0)
    x = solve.prune(eq, np.array([1.5, 0.5, 2.0]), 0.995)
    assert x[1] == 0 and abs(x[0] - 1.999) < 1e-9 and abs(x[2] - 2) < 1e-9
    assert solve.cosine_rate(0.1, 0, 5) == 0.1 and abs(solve.cosine_rate(0.1, 4, 5)) < 1e-12
    assert solve.barzilai_borwein(np.array([2.0]), np.array([4.0]), 9.0) == 0.5 and solve.barzilai_borwein(np.zeros(1), np.zeros(1), 9.0) == 9.0
    assert solve.trust_scale(np.array([3.0, 4.0]), np.ones(2), 5.0, 0.5) == 0.5
    a, b = (sorted(tuple(r) for r in solve.break_symmetry(planted).collect()) for _ in range(2))
    assert a == b and len({r[2] for r in a}) > len(planted.select("x").distinct().collect())


def test_epochs_never_rise(problem):
    models, planted, data = problem
    x, history = solve.solve_by_epochs(models, data, planted.withColumn("x", F.lit(0.5)), solve.SolverConfig(epochs=3))
    assert all(b <= a + 1e-12 for a, b in zip(history, history[1:], strict=False)) and history[-1] < history[0]
    assert x.where("x < 0").isEmpty()


def test_dense_and_long_contractions_agree(spark, store, problem):
    _, planted, _ = problem
    dense = {r["s"]: r["yhat"] for r in serve.reconstruct(store, planted).collect()}
    long = J.predict(to_long(store.table("models"), "m", ["s", "c", "p"], "l", "m"), planted)
    for r in long.collect():
        assert abs(dense[r["s"]][r["l"]] - r["yhat"]) < 1e-9


def test_staleness_and_seeds(spark, store, problem):
    _, planted, _ = problem
    assert serve.is_stale(store, planted)
    store.set_metadata(x_digest=serve.solution_digest(planted).first()["digest"])
    assert not serve.is_stale(store, planted)
    seed = serve.seed_weights(planted.select("c", "p"), spark.createDataFrame([(0, 0, -3.0), (0, 1, 2.0)], "c int, p long, x double"))
    assert seed.agg(F.sum("x")).first()[0] == 2.0
    first = serve.first_choice([("last", planted.where("c = 1")), ("seed", planted)], ["c", "p"])
    assert {r["source"] for r in first.where("c = 1").collect()} == {"last"} and first.count() == planted.count()
