import pytest
from checks import DATA, same

import __spark_entry__
from lumenframe import catalog
from lumenframe.operators import aggregates


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    same(oracle(catalog.ORACLE_SQL[name]), catalog.QUERIES[name](spark, DATA).toPandas())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert len(catalog.QUERIES[name](spark, DATA).toPandas()) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sketched_median_is_near(spark):
    exact = catalog.QUERIES["cp_flux_ref_median"](spark, DATA).toPandas().set_index(["c", "p"])["flux_ref"]
    sketch = catalog.QUERIES["cp_flux_ref_p2"](spark, DATA).toPandas().set_index(["c", "p"])["flux_ref"]
    assert (abs(exact - sketch) <= 0.35 * exact).mean() > 0.7


def test_sketched_median_is_exact_beyond_the_sketch(spark):
    n = 30_011
    rows = spark.range(n).selectExpr("id AS s", "cast(1 AS long) AS c", "'a' AS p", f"cast(id * 7919 % {n} AS double) AS m")  # 0 to n - 1, shuffled
    rows = rows.unionByName(spark.range(n - 1).selectExpr("id AS s", "cast(2 AS long) AS c", "'a' AS p", "cast(id % 10 AS double) AS m"))  # an even count, with ties
    rows = rows.unionByName(spark.range(1).selectExpr("id AS s", "cast(3 AS long) AS c", "'a' AS p", "-1.0D AS m"))
    found = {r["c"]: r["flux_ref"] for r in aggregates.flux_reference(rows, "sketch").collect()}
    assert found == {1: (n - 1) / 2, 2: 4.0, 3: 1e-12}


def test_sketched_median_whatever_its_bracket(spark):
    rows = spark.range(1001).selectExpr("cast(id % 2 AS int) AS k", "cast(id AS double) AS v")
    for accuracy in (5, 8, 1000):  # a wide bracket holds most values, a narrow one a few
        assert {r["k"]: r["v"] for r in aggregates.sketched_median(rows, "v", ["k"], accuracy).collect()} == {0: 500.0, 1: 499.0}


def test_peaks_keep_their_distance(spark):
    found = catalog.QUERIES["feature_centers"](spark, DATA).toPandas()
    for _, g in found.groupby("s"):
        places = sorted(g["l"])
        assert len(places) == 3 and min(b - a for a, b in zip(places, places[1:], strict=False)) >= 8


def test_throttle_keeps_the_gap(spark):
    kept = catalog.QUERIES["snapshot_throttle"](spark, DATA).toPandas()
    for _, g in kept.groupby("event_type"):
        assert (g["ts"].sort_values().diff().dropna().dt.total_seconds() >= 3600).all()
