"""Queries of layouts, sets, selections, kernels, seeds and schedules, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import against_label, label_mean, masses, query, rounded
from .functions import expressions as E
from .operators import aggregates as A
from .operators import contraction as J
from .operators import mixtures as X
from .operators import sampling as O
from .operators import shapes as H
from .operators import spectral as P
from .operators import support as S
from .plans import serve
from .plans.solve import cosine_rate, nnls_projected, normal_equations, solution_frame, working_set
from .workloads import cube, losvd, spectra, sql, table

Spark = SparkSession


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


@query(sql("spectra", """SELECT l, count(*) AS n, round(sum(flux), 6) AS total, round(arg_min(flux, s), 6) AS first, round(arg_max(flux, s), 6) AS last FROM spectra GROUP BY l"""))
def transposed_spectra(spark: Spark, d: str) -> DataFrame:
    dense = H.to_dense(spectra(spark, d).withColumnRenamed("flux", "value"), ["s"])
    turned = H.transpose(dense, "s", "flux", "l")
    total = F.aggregate("flux", F.lit(0.0), lambda a, v: a + v)
    return rounded(turned.select("l", F.size("flux").cast("long").alias("n"), total.alias("total"), F.element_at("flux", 1).alias("first"), F.element_at("flux", -1).alias("last")), total=6, first=6, last=6)


@query("SELECT p_partkey AS k, p, p // 21 AS z, p // 3 % 7 AS age, p % 3 AS alpha FROM (SELECT p_partkey, CAST((p_size % 5 * 7 + p_partkey % 7) * 3 + p_partkey % 3 AS BIGINT) AS p FROM part)")
def flat_populations(spark: Spark, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    p = H.flat_population(F.col("p_size") % 5, F.col("p_partkey") % 7, F.col("p_partkey") % 3, 7, 3)
    return parts.select(F.col("p_partkey").alias("k"), p.alias("p")).select("*", *(v.alias(k) for k, v in H.population_axes(F.col("p"), 7, 3).items()))


@query("SELECT vec_id // 128 AS tile, min(vec_id) AS low, max(vec_id) + 1 AS high, count(*) AS n FROM embeddings GROUP BY 1")
def aperture_tiles(spark: Spark, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("s"))
    return s.groupBy(H.tile_of("s").alias("tile")).agg(F.min("s").alias("low"), (F.max("s") + 1).alias("high"), F.count("*").alias("n"))


@query(sql("cube", """, x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p) SELECT c, p, round(x / sum(x) OVER (PARTITION BY c), 9) AS unit FROM x"""))
def component_simplex(spark: Spark, d: str) -> DataFrame:
    return rounded(X.unit_sum(masses(spark, d), "x", ["c"]).select("c", "p", "unit"), unit=9)


@query(sql("cube losvd", """, a AS (SELECT s // 16 AS tile, c, s, sum(h) AS amp FROM losvd GROUP BY ALL), l AS (SELECT c, max(amp) AS largest FROM a GROUP BY c),
x AS (SELECT tile, c, max(amp) > 0.6 * any_value(largest) AS amp_ok FROM a JOIN l USING (c) GROUP BY tile, c), e AS (SELECT s // 16 AS tile, c, sum(m * m) AS energy FROM cube GROUP BY ALL),
y AS (SELECT tile, c, energy > 0.9 * median(energy) OVER (PARTITION BY tile) AS energy_ok FROM e)
SELECT tile, c, amp_ok AND energy_ok AS ok FROM x JOIN y USING (tile, c)"""))
def support_of_both(spark: Spark, d: str) -> DataFrame:
    amplitudes = A.amplitude(losvd(spark, d)).withColumn("tile", H.tile_of("s", 16))
    energies = A.energy(cube(spark, d).withColumn("tile", H.tile_of("s", 16)), ["tile", "c"])
    return S.both_supports(S.support_by_amplitude(amplitudes, 0.6), S.support_by_energy(energies, 0.9))


@query(sql("cube", """SELECT c, p, x, g FROM (SELECT c, p, CAST(c % 2 AS DOUBLE) AS x, CAST(count(*) % 7 AS DOUBLE) - 3 AS g FROM cube GROUP BY c, p) WHERE x <= 0 AND g < -1e-6"""))
def violating_columns(spark: Spark, d: str) -> DataFrame:
    counts = cube(spark, d).groupBy("c", "p").agg(F.count("*").alias("n"))
    return S.kkt_violations(counts.select("c", "p", (F.col("c") % 2).cast("double").alias("x"), ((F.col("n") % 7).cast("double") - 3).alias("g")))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'range' AS rule, vec_id AS s FROM embeddings WHERE vec_id BETWEEN 5 AND 24 UNION ALL SELECT 'list', vec_id FROM embeddings WHERE vec_id IN (3, 17, 40)
UNION ALL SELECT 'spread', vec_id FROM embeddings, n WHERE vec_id IN (SELECT i * (n - 1) // 7 FROM range(0, 8) t(i), n)""")
def selected_apertures(spark: Spark, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("s"))
    size = s.count()
    picked = [s.where(E.matches_any("s", E.parse_selection(text, size))).select(F.lit(rule).alias("rule"), "s") for rule, text in (("range", "5:20"), ("list", "40,3,17,3"), ("spread", None))]
    return _all(picked)


@query("""WITH a AS (SELECT l_suppkey AS s FROM lineitem WHERE l_quantity >= 49), b AS (SELECT l_suppkey AS s FROM lineitem WHERE l_tax >= 0.08 AND l_quantity < 10)
SELECT 'both' AS rule, s FROM (SELECT s FROM a INTERSECT SELECT s FROM b) UNION ALL SELECT 'either', s FROM (SELECT s FROM a UNION SELECT s FROM b) UNION ALL SELECT 'all', s FROM (SELECT s FROM a UNION ALL SELECT s FROM b)""")
def aperture_sets(spark: Spark, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    a, b = (items.where(w).select(F.col("l_suppkey").alias("s")) for w in ("l_quantity >= 49", "l_tax >= 0.08 and l_quantity < 10"))
    sets = {"both": O.intersect(a, b, ["s"]).distinct(), "either": O.union_distinct(a, b), "all": a.unionByName(b)}
    return _all([df.select(F.lit(rule).alias("rule"), "s") for rule, df in sets.items()])


@query("SELECT p_partkey AS k, (p_size + 6) // 7 AS up, p_size - p_size % 8 AS down, CAST(power(2, ceil(log2(greatest(p_size, 1)))) AS BIGINT) AS power FROM part")
def integer_sizes(spark: Spark, d: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), E.ceil_div(size, 7).alias("up"), E.round_down(size, 8).alias("down"), E.next_power_of_two(size).alias("power"))


@query(sql("spectra label_mean", """SELECT s, round(sum(flux * m), 6) AS dot, round(sqrt(sum(flux * flux)), 6) AS norm, round(sum(flux * m) / sqrt(sum(flux * flux) * sum(m * m)), 6) AS cosine FROM spectra JOIN label_mean USING (c, l) GROUP BY s"""))
def label_cosines(spark: Spark, d: str) -> DataFrame:
    data = spectra(spark, d)
    means = H.to_dense(label_mean(data), ["c"], "l", "m", "mean")
    rows = H.to_dense(data, ["s", "c"], "l", "flux").join(means, "c")
    return rounded(rows.select("s", E.dot(F.col("flux"), F.col("mean")).alias("dot"), E.norm(F.col("flux")).alias("norm"), E.cosine(F.col("flux"), F.col("mean")).alias("cosine")), dot=6, norm=6, cosine=6)


@query(sql("spectra label_mean", """, k AS (SELECT d, (1 + 2 * sum(cos(2 * pi() * k * (d - 0.3) / 64)) + cos(pi() * 0.3) * cos(pi() * d)) / 64 AS h FROM range(-63, 64) t(d), range(1, 32) u(k) GROUP BY d)
SELECT c, l + d AS l, round(sum(m * h), 6) AS value FROM label_mean, k WHERE l + d BETWEEN 0 AND 63 GROUP BY ALL"""))
def shifted_labels(spark: Spark, d: str) -> DataFrame:
    dense = H.to_dense(label_mean(spectra(spark, d)), ["c"], "l", "m")

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"c": f["c"], "value": list(P.fractional_shift(np.stack(f["flux"]), 0.3))})

    return rounded(H.to_long(dense.mapInPandas(moved, "c long, value array<double>"), "value", ["c"]), value=6)


@query(sql("losvd", """, t AS (SELECT c, v, sum(h) AS h FROM losvd GROUP BY c, v), g AS (SELECT c, k, 299792.458 * (exp(k * 0.0004) - 1) / 60 + 25 AS pos FROM (SELECT DISTINCT c FROM t), range(-13, 14) u(k)),
r AS (SELECT g.c, k, CASE WHEN pos < 1 OR pos >= 50 THEN 0 ELSE (1 - pos + floor(pos)) * coalesce(a.h, 0) + (pos - floor(pos)) * coalesce(b.h, 0) END AS h
  FROM g LEFT JOIN t a ON a.c = g.c AND a.v = floor(pos) LEFT JOIN t b ON b.c = g.c AND b.v = floor(pos) + 1)
SELECT c, k, round(h / sum(h) OVER (PARTITION BY c), 9) AS h FROM r"""))
def unit_kernels(spark: Spark, d: str) -> DataFrame:
    grid = losvd(spark, d).select("c").distinct().crossJoin(F.broadcast(spark.range(1, 51).withColumnRenamed("id", "v")))  # fifty velocities
    sums = losvd(spark, d).groupBy("c", "v").agg(F.sum("h").alias("h"))
    dense = H.to_dense(grid.join(sums, ["c", "v"], "left").fillna(0.0, ["h"]), ["c"], "v", "h", "h")
    velocities = (np.arange(1, 51) - 25) * 60.0
    shifts = P.kernel_shifts(velocities, 0.0004)

    def kernels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"c": f["c"], "h": [P.unit_kernel(np.asarray(h), velocities, shifts, 0.0004) for h in f["h"]]})

    long = H.to_long(dense.mapInPandas(kernels, "c long, h array<double>"), "h", ["c"], "at", "h")
    return rounded(long.select("c", (F.col("at") + int(shifts[0])).alias("k"), "h"), h=9)


@query(sql("cube", """, x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p)
SELECT c, p, round(x + CASE WHEN c % 3 = 0 THEN 0 WHEN c % 3 = 1 THEN 1 ELSE 2 END, 7) AS x, CASE WHEN c % 3 = 0 THEN 'refined' WHEN c % 3 = 1 THEN 'seed' ELSE 'prior' END AS source FROM x"""))
def first_weights(spark: Spark, d: str) -> DataFrame:
    x = masses(spark, d).select("c", "p", "x")
    found = serve.first_choice([("refined", x.where("c % 3 = 0")), ("seed", x.where("c % 3 < 2").withColumn("x", F.col("x") + 1)), ("prior", x.withColumn("x", F.col("x") + 2))], ["c", "p"])
    return rounded(found.select("c", "p", "x", "source"), x=7)


@query(sql("cube", """SELECT c, p, round(CASE WHEN c % 2 = 0 THEN greatest(sum(m) - 2000, 0) ELSE 0 END, 7) AS x FROM cube GROUP BY c, p"""))
def dense_seed(spark: Spark, d: str) -> DataFrame:
    x = masses(spark, d)
    return rounded(serve.seed_weights(x.select("c", "p"), x.where("c % 2 = 0").withColumn("x", F.col("x") - 2000)), x=7)


@query("""WITH e AS (SELECT e, 0.5 * (1 - cos(pi() * (e - 1) / 11.0)) AS part FROM range(1, 13) t(e))
SELECT e AS epoch, round(0.05 + 0.45 * (1 - part), 9) AS rate, round(0.30 - 0.15 * part, 9) AS band, round(0.20 + 0.10 * part, 9) AS step FROM e""")
def epoch_schedules(spark: Spark, d: str) -> DataFrame:
    rows = [(e, cosine_rate(0.5, e - 1, 12, 0.05), *X.softbox_schedule(e, 12)) for e in range(1, 13)]
    return rounded(spark.createDataFrame(rows, "epoch long, rate double, band double, step double"), rate=9, band=9, step=9)


@query(sql("spectra label_mean", """SELECT round(sqrt(sum(power(flux - m, 2) / (1 + l)) / sum(1.0 / (1 + l))), 7) AS rmse FROM spectra JOIN label_mean USING (c, l) WHERE l % 16 <> 3"""))
def global_rmse(spark: Spark, d: str) -> DataFrame:
    holed = against_label(spectra(spark, d)).withColumn("r", F.when(F.col("l") % 16 == 3, float("nan")).otherwise(F.col("r")))
    return rounded(A.rmse(holed, [], weight=1 / (1 + F.col("l"))), rmse=7)


@query(sql("cube", """SELECT c, p, round(sum(m * m / (1 + l % 12)), 6) AS energy FROM cube GROUP BY c, p"""))
def weighted_energy(spark: Spark, d: str) -> DataFrame:
    return rounded(A.energy(cube(spark, d), weight=1 / (1 + F.col("l") % 12)), energy=6)


@query(sql("spectra label_mean", """SELECT l, round(avg(m), 9) AS mean FROM label_mean GROUP BY l"""))
def mean_template(spark: Spark, d: str) -> DataFrame:
    return rounded(A.masked_mean(label_mean(spectra(spark, d)), "l", "m"), mean=9)


PLANTED = sql("spectra", "SELECT DISTINCT c, 0 AS p, CAST(c % 3 AS DOUBLE) AS x FROM spectra")


def _planted(spark: Spark, d: str):
    models = label_mean(spectra(spark, d)).select(F.lit(0).alias("s"), "l", "c", F.lit(0).alias("p"), "m")
    weights = models.select("c", "p", (F.col("c") % 3).cast("double").alias("x")).distinct()
    return models, normal_equations(models, J.predict(models, weights).withColumnRenamed("yhat", "flux"))


@query(PLANTED)
def nnls_by_projection(spark: Spark, d: str) -> DataFrame:
    """Recovers planted weights by accelerated projected gradients."""
    models, eq = _planted(spark, d)
    return rounded(solution_frame(models, eq, nnls_projected(eq.g, eq.b)), x=4)


@query(PLANTED)
def nnls_working_set(spark: Spark, d: str) -> DataFrame:
    """Recovers planted weights through a working set of columns that grows."""
    models, eq = _planted(spark, d)
    return rounded(solution_frame(models, eq, working_set(eq, coherence=1.0)), x=6)
