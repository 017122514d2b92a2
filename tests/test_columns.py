"""Cases of the column operators that the shared tables do not have."""

import math

import pytest

from lumenframe.operators import columns as C
from lumenframe.operators import mixtures as X
from lumenframe.plans import build, descend
from lumenframe.sources.store import Store


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_values_that_are_not_finite(spark):
    data = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("inf")), (3, None)], "l long, flux double")
    assert rows(C.finite_weights(data), "l", "flux", "weight") == [(0, 1.0, 1.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    one = C.triage(data, "flux").first()
    assert (one["least"], one["largest"], one["n_finite"], one["n"]) == (1.0, 1.0, 1, 4)
    assert C.triage(data.limit(0), "flux").first()["least"] is None
    assert rows(C.log_map(data, "flux"), "l", "log10") == [(0, 0.0), (1, None), (2, None), (3, None)]
    assert descend.safe_rmse(None) == descend.safe_rmse(float("nan")) == descend.safe_rmse(-1.0) == math.inf and descend.safe_rmse(0.5) == 0.5


def test_scales_go_back(spark):
    models = spark.createDataFrame([(0, 0, 0, 0, 3.0), (0, 1, 0, 0, 4.0), (0, 0, 0, 1, 0.0)], "s long, l long, c int, p long, m double")
    norms = C.column_norms(models)
    unit = rows(C.to_unit_norm(models, norms), "l", "p", "m")
    assert unit == [(0, 0, 0.6), (0, 1, 0.0), (1, 0, 0.8)]
    weights = spark.createDataFrame([(0, 0, 10.0), (0, 1, 7.0)], "c int, p long, x double")
    assert rows(C.from_unit_norm(weights, norms), "p", "x") == [(0, 2.0), (1, 0.0)]
    reference = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.0)], "c int, p long, flux_ref double")
    assert rows(C.to_unit_flux(models, reference), "l", "p", "m") == [(0, 0, 1.5), (0, 1, 0.0), (1, 0, 2.0)]
    assert rows(C.from_unit_flux(weights, reference), "p", "x") == [(0, 5.0), (1, 7.0)]


def test_dense_models_are_converted(spark):
    models = spark.createDataFrame([(0, 0, 0, 0, [1.0, 2.0]), (0, 1, 0, 0, [1.0, 2.0])], "tile int, s long, c int, p long, m array<float>")
    factors = spark.createDataFrame([(0, 3.0)], "s long, factor double")
    out = X.convert_models(models, factors)
    assert out.schema == models.schema and [r["m"] for r in out.orderBy("s").collect()] == [[3.0, 6.0], [1.0, 2.0]]


def test_differences_and_freezes(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (3, -4.0)], "k int, v double")
    assert tuple(C.largest_difference(a, b, ["k"], "v").first()) == (4.0, 2)
    g = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, 2.0, 1.0), (0, 2, 3.0, 2.0)], "c int, p long, g double, d double")
    assert rows(C.freeze_globally(g), "p", "g", "frozen") == [(0, 0.0, True), (1, 2.0, False), (2, 3.0, False)]
    none = C.freeze_globally(g.where("d = 0"))
    assert rows(none, "p", "frozen") == [(0, True)]


def test_a_cut_off_build_goes_on(spark, tmp_path, monkeypatch):
    from test_run import cube_arrays

    observed, template, velocities, losvd, templates = cube_arrays()
    store = Store(spark, str(tmp_path / "store"), tile_size=2)
    import numpy as np

    store.ingest(spectra=np.ones((len(observed), losvd.shape[0])), losvd=losvd, templates=templates, template_log=template, observed_log=observed, velocities=velocities)
    write, seen = Store.write, []

    def failing(self, name, df, *args, **kwargs):
        seen.append(name)
        if seen.count("models") == 2 and name == "models":
            raise RuntimeError("lost")
        return write(self, name, df, *args, **kwargs)

    monkeypatch.setattr(Store, "write", failing)
    with pytest.raises(RuntimeError):
        build.build(store, pad=2, tiles_at_once=1)
    monkeypatch.setattr(Store, "write", write)
    assert not store.complete() and store.table("build_log").count() == 1
    assert build.build(store, pad=2, tiles_at_once=1) == 2 and store.complete()
    assert store.table("models").count() == 6 * 2 * 3 and store.table("models").select("tile", "s", "c", "p").distinct().count() == 36
    store.invalidate([1])
    assert not store.complete() and build.build(store, pad=2) == 1 and store.table("models").count() == 36
    assert store.dims() == {"s": 6, "l": 48, "c": 2, "p": 3} and store.basis(3, 1).count() == 3 and store.template(2).count() == 1


def test_tile_shapes():
    from lumenframe.operators import maps

    assert maps.tile_shape(2854, 207, 360, 1247, 1 << 30) == (128, 4, 360)
    assert maps.tile_shape(10, 2, 3, 48) == (10, 2, 3)
    s, c, p = maps.tile_shape(10, 2, 10_000, 10_000, 1 << 20)
    assert (s, c) == (1, 1) and p == (1 << 20) // 40_000
    assert maps.power_of_two_below(100) == 64 and maps.power_of_two_below(0) == 0
    with pytest.raises(ValueError):
        maps.tile_shape(0, 1, 1, 1)


def test_pairs_that_are_new_on_both_sides(spark):
    from lumenframe.operators.sampling import diverse_greedy

    pairs = [(0, 0, 9.0), (0, 1, 8.0), (1, 0, 7.0), (2, 2, 1.0), (4, 3, 0.5), (5, 5, 0.4)]
    df = spark.createDataFrame(pairs, "a long, b long, v double")
    picked = [(r["a"], r["b"]) for r in diverse_greedy(df, "a", "b", "v", 4, 2).orderBy("turn").collect()]
    assert picked == [(0, 0), (2, 2), (5, 5), (0, 1)]  # then no pair has a new tile left
    with pytest.raises(ValueError):
        diverse_greedy(df, "a", "b", "v", 4, 2, most=3)


def test_numbers_over_ranges(spark):
    from lumenframe.streaming.tracker import every_nth, numbered

    data = [("hot" if i % 10 else "cold", i * 7 % 1000, i) for i in range(1000)] + [(None, 5, 5000)]
    df = spark.createDataFrame(data, "kind string, t long, id long").repartition(5)
    got = {r["id"]: r["seq"] for r in numbered(df, "kind", ["t", "id"]).collect()}
    for kind in ("hot", "cold", None):
        own = sorted((t, i) for k, t, i in data if k == kind)
        assert [got[i] for _, i in own] == list(range(len(own)))
    assert every_nth(df, "kind", ["t", "id"], 100).count() == 9 + 1 + 1


def test_tables_are_ingested_as_arrays_are(spark, tmp_path):
    from test_run import cube_arrays

    import numpy as np

    observed, template, velocities, losvd, templates = cube_arrays()
    one, two = Store(spark, str(tmp_path / "one"), 2), Store(spark, str(tmp_path / "two"), 2)
    one.ingest(spectra=np.ones((len(observed), losvd.shape[0])), losvd=losvd, templates=templates, template_log=template, observed_log=observed, velocities=velocities, prior=[3.0, 1.0])
    tables = {n: one.table(n) for n in ("spectra", "losvd", "templates", "axis")}
    prior = spark.createDataFrame([(0, 2.0), (0, 4.0), (1, 2.0)], "c int, w double")
    two.ingest_tables(**tables, prior=prior, pop_shape=[3, 1, 1])
    for name in (*tables, "comp_prior"):
        assert sorted(map(str, one.table(name).collect())) == sorted(map(str, two.table(name).collect())), name
    assert one.metadata() == two.metadata()
    with pytest.raises(ValueError):
        two.ingest_tables(**{**tables, "spectra": spark.createDataFrame([(0, [1.0])], "s long, flux array<double>")})
    with pytest.raises(ValueError):
        two.ingest_tables(**tables, pixels=spark.createDataFrame([(0, 0.0, 0.0, 99)], "pix long, x double, y double, bin int"))
    with pytest.raises(ValueError):
        two.ingest_tables(**{**tables, "axis": tables["axis"].where("name <> 'velocity'")})


def test_a_rewrite_that_is_cut_off(spark, tmp_path):
    import os

    store = Store(spark, str(tmp_path / "store"))
    store.write("pixels", spark.createDataFrame([(1, 0.0, 0.0, 0)], "pix long, x double, y double, bin int"))
    os.rename(f"{store.path}/pixels", f"{store.path}/pixels.old")
    assert store.table("pixels").count() == 1 and os.path.isdir(f"{store.path}/pixels")


def test_lists_paths_and_logs(spark, tmp_path):
    import logging

    from lumenframe.sources import lists

    (tmp_path / "lines.txt").write_text("# name place\nHbeta   4861.3\n\n  Mgb\t5175 kept\nodd word\n")
    got = lists.read_list(spark, str(tmp_path / "lines.txt"), ["name string", "place double", "note string"])
    assert sorted(map(tuple, got.collect()), key=str) == [("Hbeta", 4861.3, None), ("Mgb", 5175.0, "kept"), ("odd", None, None)]
    assert lists.store_path("s3a://b/c/") == "s3a://b/c" and lists.store_path(tmp_path / "x") == str(tmp_path / "x")
    assert lists.exists(spark, tmp_path) and not lists.exists(spark, tmp_path / "none")
    with lists.logged(tmp_path / "logs", capture=True) as logger:
        print("printed")
        lists.say(logger, "said")
    text = next((tmp_path / "logs").iterdir()).read_text()
    assert "INFO printed" in text and "INFO said" in text and not logging.getLogger("lumenframe").handlers


def test_cuts(spark):
    from lumenframe.operators import cuts

    axis = spark.createDataFrame([(k, float(k)) for k in range(20)], "idx int, coord double")
    assert cuts.cropped(axis, 8.0, 10.0, 2, 1.0).count() == 7
    with pytest.raises(ValueError):
        cuts.cropped(axis, 1.0, 10.0, 2, 1.0)
    with pytest.raises(ValueError):
        cuts.cropped(axis.limit(0), 1.0, 10.0, 2, 1.0)
    flat = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (1, 0, float("nan"))], "s long, l long, flux double")
    assert rows(cuts.standardised(flat, "flux", flat["l"] >= 0), "s", "l", "z") == [(0, 0, 0.0), (0, 1, 0.0)]
