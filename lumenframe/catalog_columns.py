"""Queries of column scales, triage, maps and cuts, with the SQL they are checked against.

Rounding is to a digit at which the exact values have none of their own, so that no
value lies halfway between two rounded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import against_label, label_mean, masses, query, rounded
from .operators import aggregates as A
from .operators import columns as C
from .operators import contraction as J
from .operators import cuts as K
from .operators import maps as M
from .operators import mixtures as X
from .operators import sampling as O
from .workloads import cube, events, losvd, spectra, sql, table

Spark = SparkSession


@query(sql("spectra", """SELECT c, round(sum(CASE WHEN l % 16 = 3 THEN 0 ELSE flux END), 6) AS flux, CAST(sum(CASE WHEN l % 16 = 3 THEN 0 ELSE 1 END) AS DOUBLE) AS weight FROM spectra GROUP BY c"""))
def finite_weight_sums(spark: Spark, d: str) -> DataFrame:
    holed = spectra(spark, d).withColumn("flux", F.when(F.col("l") % 16 == 3, float("nan")).otherwise(F.col("flux")))
    return rounded(C.finite_weights(holed).groupBy("c").agg(F.sum("flux").alias("flux"), F.sum("weight").alias("weight")), flux=6)


@query(sql("spectra label_mean", """SELECT c, 0 AS p, round(sum(m * flux / (1 + l)), 6) AS g, round(sum(m * m / (1 + l)), 6) AS d FROM spectra JOIN label_mean USING (c, l) GROUP BY c"""))
def weighted_system_sums(spark: Spark, d: str) -> DataFrame:
    data = spectra(spark, d)
    models = data.select("s", "c", "l").join(label_mean(data), ["c", "l"]).withColumn("p", F.lit(0))
    weights = spark.range(64).select(F.col("id").cast("int").alias("l"), (1 / (1 + F.col("id"))).alias("weight"))
    scaled, seen = C.weighted_system(models, data, weights)
    return rounded(J.gradient(scaled, seen.withColumn("r", F.col("flux"))), g=6, d=6).select("c", "p", "g", "d")


@query(sql("cube", """, f AS (SELECT c, p, avg(f) AS flux_ref FROM (SELECT c, p, s, sum(m) AS f FROM cube GROUP BY c, p, s) GROUP BY c, p)
SELECT c, p, round(sum(m / flux_ref), 7) AS scaled, round(any_value(flux_ref), 9) AS flux_ref FROM cube JOIN f USING (c, p) GROUP BY c, p"""))
def unit_flux_columns(spark: Spark, d: str) -> DataFrame:
    models = cube(spark, d)
    reference = A.flux_reference(models, "mean")
    sums = C.to_unit_flux(models, reference).groupBy("c", "p").agg(F.sum("m").alias("scaled"))
    return rounded(sums.join(reference, ["c", "p"]), scaled=7, flux_ref=9)


@query(sql("cube", """, x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p), n AS (SELECT c, p, sqrt(sum(m * m)) AS norm FROM cube GROUP BY c, p)
SELECT c, p, round(norm, 7) AS norm, round(x / norm, 7) AS x FROM x JOIN n USING (c, p)"""))
def unit_norm_weights(spark: Spark, d: str) -> DataFrame:
    norms = C.column_norms(cube(spark, d))
    return rounded(C.from_unit_norm(masses(spark, d), norms).join(norms, ["c", "p"]), norm=7, x=7)


@query(sql("cube", """, y AS (SELECT s, l, sum(m) - 20 AS flux FROM cube GROUP BY s, l),
k AS (SELECT s, l, c, p, sum(m) AS m FROM cube GROUP BY s, l, c, p),
t AS (SELECT c, p, sqrt(sum(m * m)) AS norm, sum(m * flux) AS corr FROM k JOIN y USING (s, l) GROUP BY c, p)
SELECT count(*) AS n_columns, count(*) FILTER (WHERE norm <= 1e-12) AS n_zero, count(*) FILTER (WHERE corr > 0) AS n_positive, round(min(norm), 6) AS least_norm, round(max(norm), 6) AS largest_norm FROM t"""))
def column_triage(spark: Spark, d: str) -> DataFrame:
    rows = cube(spark, d)
    data = rows.groupBy("s", "l").agg((F.sum("m") - 20).alias("flux"))
    return rounded(C.column_triage(rows.groupBy("s", "l", "c", "p").agg(F.sum("m").alias("m")), data), least_norm=6, largest_norm=6)


@query(sql("cube", """, x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p)
SELECT round(min(x), 9) AS least, round(median(x), 9) AS median, round(max(x), 9) AS largest, count(x) AS n_finite, count(*) AS n FROM x"""))
def weight_triage(spark: Spark, d: str) -> DataFrame:
    return rounded(C.triage(masses(spark, d), "x"), least=9, median=9, largest=9)


@query(sql("cube", """, k AS (SELECT c, p, sum(m) AS g, sum(m * m) AS d, sum(m) AS x FROM cube GROUP BY c, p)
SELECT round(quantile_cont(d, 0.1), 6) AS d10, round(quantile_cont(d, 0.5), 6) AS d50, round(quantile_cont(d, 0.9), 6) AS d90, round(sqrt(sum(g * g)), 6) AS g_norm, round(sqrt(sum(x * x)), 6) AS x_norm, count(*) FILTER (WHERE x > 0) AS n_used FROM k"""))
def gradient_summary(spark: Spark, d: str) -> DataFrame:
    sums = cube(spark, d).groupBy("c", "p").agg(F.sum("m").alias("g"), F.sum(F.col("m") * F.col("m")).alias("d"))
    return rounded(C.gradient_summary(sums, masses(spark, d)), d10=6, d50=6, d90=6, g_norm=6, x_norm=6)


@query(sql("losvd", """, a AS (SELECT s // 16 AS tile, c, max(h) AS h FROM losvd GROUP BY 1, 2), n AS (SELECT tile, count(*) FILTER (WHERE h >= 3) AS n FROM a GROUP BY tile)
SELECT count(*) AS tiles, round(avg(n), 6) AS mean_active, min(n) AS least_active FROM n"""))
def active_per_tile(spark: Spark, d: str) -> DataFrame:
    tiles = losvd(spark, d).groupBy(F.floor(F.col("s") / 16).alias("tile"), "c").agg(F.max("h").alias("h"))
    return rounded(C.active_per_tile(tiles, F.col("h") >= 3), mean_active=6)


@query(sql("cube", """, a AS (SELECT s, c, avg(m) AS v FROM cube GROUP BY s, c), b AS (SELECT s, c, median(m) AS v FROM cube WHERE l % 2 = 0 GROUP BY s, c)
SELECT round(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))), 7) AS delta, count(*) FILTER (WHERE a.v IS NULL OR b.v IS NULL) AS unmatched FROM a FULL JOIN b ON a.s = b.s AND a.c = b.c"""))
def transpose_delta(spark: Spark, d: str) -> DataFrame:
    a = cube(spark, d).groupBy("s", "c").agg(F.avg("m").alias("v"))
    b = cube(spark, d).where("l % 2 = 0").groupBy("s", "c").agg(F.median("m").alias("v"))
    return rounded(C.largest_difference(a, b, ["s", "c"], "v"), delta=7)


@query(sql("spectra label_mean", """, t AS (SELECT s.s, m.c AS p, sum(s.flux * m.m) / sqrt(sum(s.flux * s.flux) * sum(m.m * m.m)) AS cosine FROM spectra s JOIN label_mean m ON m.l = s.l GROUP BY 1, 2)
SELECT s, round(max(cosine), 6) AS best, arg_max(p, cosine) AS best_p, round(median(cosine), 6) AS median FROM t GROUP BY s"""))
def template_cosine(spark: Spark, d: str) -> DataFrame:
    data = spectra(spark, d)
    templates = label_mean(data).select(F.col("c").alias("p"), "l", "m")
    return rounded(C.best_and_median_cosine(C.template_cosines(data.select("s", "l", "flux"), templates)), best=6, median=6)


@query(sql("spectra label_mean", """, r AS (SELECT s, flux - m AS r, 1.0 / (1 + l) AS w FROM spectra JOIN label_mean USING (c, l))
SELECT s, round(sum(w * r * r), 6) AS chi2, round(sum(w), 6) AS weight, round(sqrt(sum(w * r * r) / sum(w)), 6) AS rmse FROM r GROUP BY s"""))
def chi_square_by_aperture(spark: Spark, d: str) -> DataFrame:
    pairs = against_label(spectra(spark, d)).withColumn("weight", 1 / (1 + F.col("l")))
    return rounded(C.chi_square(pairs), chi2=6, weight=6, rmse=6)


@query(sql("cube", """, f AS (SELECT s, c, sum(m) AS flux FROM cube GROUP BY s, c), g AS (SELECT c, avg(flux) AS yhat FROM f GROUP BY c)
SELECT s, c, round((flux - yhat) / flux, 7) AS relative FROM f JOIN g USING (c) WHERE flux <> 0"""))
def relative_residual(spark: Spark, d: str) -> DataFrame:
    flux = cube(spark, d).groupBy("s", "c").agg(F.sum("m").alias("flux"))
    pairs = flux.join(flux.groupBy("c").agg(F.avg("flux").alias("yhat")), "c")
    return rounded(C.relative_residual(pairs).select("s", "c", "relative"), relative=7)


@query(sql("cube", """, f AS (SELECT s, sum(m) - 1000 AS v FROM cube GROUP BY s) SELECT s, CASE WHEN v > 0 THEN round(log10(v), 7) END AS log10 FROM f"""))
def log_flux_map(spark: Spark, d: str) -> DataFrame:
    return rounded(C.log_map(cube(spark, d).groupBy("s").agg((F.sum("m") - 1000).alias("v")), "v"), log10=7).select("s", "log10")


@query(sql("axis edges", """SELECT idx, round(exp(hi / 100) - exp(lo / 100), 9) AS width FROM edges"""))
def linear_bin_widths(spark: Spark, d: str) -> DataFrame:
    from .operators.spectral import bin_edges

    axis = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 0.01 * F.col("id") * F.col("id")).alias("coord"))
    edges = bin_edges(axis).select("idx", (F.col("lo") / 100).alias("lo"), (F.col("hi") / 100).alias("hi"))
    return rounded(C.linear_widths(edges).select("idx", "width"), width=9)


@query("SELECT p_partkey AS pix, round(p_size * cos(radians(30)) - p_retailprice * sin(radians(30)), 6) AS x, round(p_size * sin(radians(30)) + p_retailprice * cos(radians(30)), 6) AS y FROM part")
def rotated_pixels(spark: Spark, d: str) -> DataFrame:
    pixels = table(spark, d, "part").select(F.col("p_partkey").alias("pix"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(C.rotated(pixels, 30.0), x=6, y=6)


@query(sql("spectra label_mean", """, t AS (SELECT tile, sqrt(avg(power(flux - m, 2))) AS rmse FROM spectra JOIN label_mean USING (c, l) GROUP BY tile), k AS (SELECT median(rmse) AS cap FROM t)
SELECT tile, round(rmse, 6) AS rmse FROM t, k WHERE rmse <= cap + 1e-9"""))
def tiles_within_cap(spark: Spark, d: str) -> DataFrame:
    errors = A.rmse(against_label(spectra(spark, d)), ["tile"])
    cap = errors.agg(F.median("rmse")).first()[0]
    return rounded(C.tiles_within(errors, cap + 1e-9), rmse=6)


@query(sql("cube", """, k AS (SELECT c, p, sum(m) AS g, sum(m * m) AS d FROM cube GROUP BY c, p), h AS (SELECT median(d) FILTER (WHERE d > 0) AS middle FROM k)
SELECT c, p, CASE WHEN d <= 0.5 * middle THEN 0 ELSE round(g, 6) END AS g, d <= 0.5 * middle AS frozen FROM k, h"""))
def global_freeze(spark: Spark, d: str) -> DataFrame:
    sums = cube(spark, d).groupBy("c", "p").agg(F.sum("m").alias("g"), F.sum(F.col("m") * F.col("m")).alias("d"))
    return rounded(C.freeze_globally(sums, 0.5), g=6).select("c", "p", "g", "frozen")


@query(sql("losvd", """, t AS (SELECT s // 16 AS tile, c, max(h) AS a, sum(h) AS e FROM losvd GROUP BY 1, 2), k AS (SELECT c FROM losvd GROUP BY c HAVING sum(h) > (SELECT avg(n) FROM (SELECT sum(h) AS n FROM losvd GROUP BY c)))
SELECT tile, c FROM t SEMI JOIN k USING (c) WHERE a >= 3 AND e >= 40"""))
def supported_components(spark: Spark, d: str) -> DataFrame:
    rows = losvd(spark, d)
    per_tile = rows.groupBy(F.floor(F.col("s") / 16).alias("tile"), "c").agg(F.max("h").alias("a"), F.sum("h").alias("e"))
    support = per_tile.select("tile", "c", (F.col("a") >= 3).alias("amp_ok"), (F.col("e") >= 40).alias("energy_ok"))
    mass = rows.groupBy("c").agg(F.sum("h").alias("n"))
    active = mass.crossJoin(F.broadcast(mass.agg(F.avg("n").alias("mean")))).where("n > mean")  # one row
    return C.supported_only(active, support)


@query(sql("cube", """, b AS (SELECT s, c, max(m) AS m FROM cube GROUP BY s, c) SELECT s, c, round(m, 9) AS m FROM b ORDER BY b.m DESC, s, c LIMIT 25"""))
def best_within_memory(spark: Spark, d: str) -> DataFrame:
    return rounded(C.best_within_memory(cube(spark, d), ["s", "c"], "m", 8 * 64, 25 * 8 * 64 + 100), m=9)


@query("SELECT event_type, round(max(epoch(ts) - first) / 60, 3) AS last, round(avg(epoch(ts) - first) / 60, 3) AS mean FROM (SELECT *, epoch(min(ts) OVER (PARTITION BY event_type)) AS first FROM events) GROUP BY event_type")
def minutes_since_first(spark: Spark, d: str) -> DataFrame:
    timed = C.minutes_since_first(events(spark, d))
    return rounded(timed.groupBy("event_type").agg(F.max("minutes").alias("last"), F.avg("minutes").alias("mean")), last=3, mean=3)


@query(sql("spectra", """, n AS (SELECT s // 32 AS tile, sqrt(sum(flux * flux)) AS norm FROM spectra GROUP BY 1)
SELECT tile, round(norm, 6) AS norm, row_number() OVER (ORDER BY norm DESC, tile) AS turn FROM n WHERE tile % 2 = 0"""))
def bright_tile_order(spark: Spark, d: str) -> DataFrame:
    tiles = spectra(spark, d).groupBy(F.floor(F.col("s") / 32).alias("tile")).agg(F.sqrt(F.sum(F.col("flux") * F.col("flux"))).alias("norm"))
    return rounded(C.bright_order(tiles, tiles.where("tile % 2 = 0")), norm=6)


@query(sql("cube", """, x AS (SELECT s, c, p, sum(m) AS x FROM cube GROUP BY s, c, p), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, s, c, p) AS rank FROM x)
SELECT s, c, p, round(x, 9) AS x, rank FROM r WHERE rank <= 1000"""))
def top_coefficients(spark: Spark, d: str) -> DataFrame:
    x = cube(spark, d).groupBy("s", "c", "p").agg(F.sum("m").alias("x"))
    first = x.orderBy(F.desc("x"), "s", "c", "p").limit(1000)  # the rank is counted over these only
    return rounded(O.top_per_group(first.withColumn("_all", F.lit(0)), ["_all"], 1000, F.desc("x"), F.asc("s"), F.asc("c"), F.asc("p")).drop("_all"), x=9)


@query(sql("cube losvd", """, a AS (SELECT s, sum(h) AS total FROM losvd GROUP BY s), f AS (SELECT s, avg(m) AS mean FROM cube GROUP BY s)
SELECT s, round(sum(m * total / mean), 5) AS m FROM cube JOIN a USING (s) JOIN f USING (s) GROUP BY s"""))
def norm_convert_tensor(spark: Spark, d: str) -> DataFrame:
    models = cube(spark, d)
    totals = losvd(spark, d).groupBy("s").agg(F.sum("h").alias("total"))
    flux = models.groupBy("s").agg(F.avg("m").alias("mean"))
    converted = X.convert_models(models, X.convert_factor(totals, flux, "model"))
    return rounded(converted.groupBy("s").agg(F.sum("m").alias("m")), m=5)


@query("SELECT c_custkey AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer QUALIFY turn <= 3")
def best_per_stratum(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("v"))
    return O.top_per_group(rows, ["n"], 3, F.desc("v"), F.asc("s")).select("s", F.col("rank").alias("turn"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def events_by_hour(spark: Spark, d: str) -> DataFrame:
    return rounded(M.events_by_hour(events(spark, d)), mean=6)


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 50) AS raw, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 50), 20), 80) AS setting FROM events")
def bounded_settings(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.select("event_id", M.with_default("k", 50.0).alias("raw"), M.with_default("k", 50.0, 20.0, 80.0).alias("setting"))


@query(sql("spectra", """, k AS (SELECT s, l, flux FROM spectra WHERE l BETWEEN 10 AND 20 OR l BETWEEN 40 AND 50), t AS (SELECT s, avg(flux) AS m, stddev_pop(flux) AS sd FROM k GROUP BY s)
SELECT s, l, round((flux - m) / sd, 6) AS z FROM k JOIN t USING (s) WHERE sd > 0"""))
def window_z_scores(spark: Spark, d: str) -> DataFrame:
    inside = F.col("l").between(10, 20) | F.col("l").between(40, 50)
    return rounded(K.standardised(spectra(spark, d), "flux", inside).select("s", "l", "z"), z=6)


@query(sql("spectra", "SELECT s, l, round(flux, 6) AS flux, row_number() OVER (PARTITION BY s ORDER BY flux, l) AS rank FROM spectra QUALIFY rank <= 2"))
def deepest_features(spark: Spark, d: str) -> DataFrame:
    return rounded(K.deepest(spectra(spark, d), "flux", 2).select("s", "l", "flux", "rank"), flux=6)


@query(sql("cube", """, k AS (SELECT c, p, 190 - sum(m) / 30 AS g, sum(m * m) AS d FROM cube GROUP BY c, p)
SELECT c, p, round(g, 7) AS g, row_number() OVER (PARTITION BY c ORDER BY g, p) AS rank FROM k WHERE g < -1e-6 QUALIFY rank <= 3"""))
def candidate_columns(spark: Spark, d: str) -> DataFrame:
    sums = cube(spark, d).groupBy("c", "p").agg((190 - F.sum("m") / 30).alias("g")).withColumn("x", F.lit(0.0))
    return rounded(K.candidates(sums, 3).select("c", "p", "g", "rank"), g=7)


@query(sql("cube", """, k AS (SELECT c, p, sum(m) / sqrt(sum(m * m)) AS score FROM cube GROUP BY c, p)
SELECT c, p, round(score, 7) AS score, row_number() OVER (PARTITION BY c ORDER BY score DESC, p) AS rank FROM k QUALIFY rank <= 2"""))
def correlation_rank(spark: Spark, d: str) -> DataFrame:
    sums = cube(spark, d).groupBy("c", "p").agg(F.sum("m").alias("g"), F.sum(F.col("m") * F.col("m")).alias("d"))
    return rounded(K.correlation_rank(sums, 2).select("c", "p", "score", "rank"), score=7)


@query(sql("cube", """, k AS (SELECT c, p, sum(m) AS x, sum(m * m) AS e FROM cube GROUP BY c, p), m AS (SELECT c, sum(x * e) AS mass FROM k GROUP BY c)
SELECT c, round(least(greatest((c / sum(c) OVER ()) / (mass / sum(mass) OVER ()), 0.5), 1.5), 7) AS scale FROM m"""))
def component_scales(spark: Spark, d: str) -> DataFrame:
    x = masses(spark, d)
    energies = A.energy(cube(spark, d))
    target = x.select("c").distinct().withColumn("w", F.col("c").cast("double"))
    return rounded(K.component_scales(x, energies, target, 0.5, 1.5), scale=7)


@query(sql("spectra label_mean", """, w AS (SELECT s, c, l, flux, unnest([-2, -1, 0, 1, 2]) AS shift FROM spectra WHERE l BETWEEN 8 AND 55)
SELECT s, CAST(shift AS INTEGER) AS shift, round(corr(flux, m), 6) AS score FROM w JOIN label_mean a ON a.c = w.c AND a.l = w.l + shift GROUP BY s, shift"""))
def shift_scores(spark: Spark, d: str) -> DataFrame:
    data = spectra(spark, d)
    model = against_label(data).select("s", "l", "yhat")
    return rounded(K.shifted_scores(data, model, data.where(F.col("l").between(8, 55)), range(-2, 3)), score=6)
