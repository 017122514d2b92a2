"""Every query of the engine's own operators, with the SQL it is checked against.

Numbers are rounded alike on both sides, because sums in another order differ in
their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.expressions import LIGHT_SPEED, pixels_to_velocity, velocity_to_pixels
from .operators import aggregates as A
from .operators import contraction as J
from .operators import mixtures as X
from .operators import sampling as O
from .operators import spectral as P
from .operators import support as S
from .operators import windows as N
from .operators.shapes import population_axes, to_dense
from .plans import serve
from .plans.solve import jacobi_seed, nnls_active_set, normal_equations, solution_frame
from .streaming import tracker
from .workloads import cube, events, losvd, spectra, sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


def label_mean(data: DataFrame) -> DataFrame:
    return data.groupBy("c", "l").agg(F.avg("flux").alias("m"))


def against_label(data: DataFrame) -> DataFrame:
    """Each spectrum with the mean spectrum of its label as the model."""
    joined = data.join(label_mean(data), ["c", "l"]).withColumnRenamed("m", "yhat")
    return joined.withColumn("r", F.col("flux") - F.col("yhat"))


def kept() -> Column:
    """The wavelengths that the mask keeps."""
    return F.col("l") % 8 != 0


def masses(spark: SparkSession, d: str) -> DataFrame:
    """Weights (c, p, x) that stand for a solution."""
    return cube(spark, d).groupBy("c", "p").agg(F.sum("m").alias("x"))


def ramp(solution: DataFrame) -> DataFrame:
    """A prior that grows with the component."""
    return solution.select("c").distinct().withColumn("w", F.col("c").cast("double"))


# --- model, residual, errors


@query(sql("spectra label_mean", """,
g AS (SELECT l, avg(flux) AS m FROM spectra GROUP BY l),
e AS (SELECT s.s, sqrt(avg(power(s.flux - (0.7 * a.m + 0.3 * g.m), 2))) AS rmse FROM spectra s JOIN label_mean a ON a.c = s.c AND a.l = s.l JOIN g ON g.l = s.l WHERE s.l % 8 <> 0 GROUP BY s.s),
r AS (SELECT s, rmse, row_number() OVER (ORDER BY rmse, s) AS up, row_number() OVER (ORDER BY rmse DESC, s) AS down FROM e)
SELECT s, round(rmse, 6) AS rmse, 'best' AS side, up AS rank FROM r WHERE up <= 10 UNION ALL SELECT s, round(rmse, 6), 'worst', down FROM r WHERE down <= 10"""))
def recon_worst_best(spark: SparkSession, d: str) -> DataFrame:
    data = spectra(spark, d)
    parts = data.select("s", "c", "l").join(label_mean(data), ["c", "l"]).select("s", "l", F.lit(0).alias("k"), "m")
    parts = parts.unionByName(data.select("s", "l").join(data.groupBy("l").agg(F.avg("flux").alias("m")), "l").select("s", "l", F.lit(1).alias("k"), "m"))
    weights = spark.createDataFrame([(0, 0.7), (1, 0.3)], "k int, x double")
    errors = A.rmse(J.residual(data, J.predict(parts, weights, ["k"])), keep=kept())
    return rounded(O.best_and_worst(errors, "rmse", "s", 10), rmse=6)


@query(sql("spectra", "SELECT s, round(coalesce(avg(flux) FILTER (WHERE l % 8 <> 0), 0), 6) AS mean FROM spectra GROUP BY s"))
def masked_mean_flux(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.masked_mean(spectra(spark, d), keep=kept()), mean=6)


@query(sql("spectra label_mean", "SELECT tile, round(sqrt(avg(power(flux - m, 2))), 6) AS rmse, round(sqrt(sum(flux * flux)), 6) AS norm FROM spectra JOIN label_mean USING (c, l) GROUP BY tile"))
def residual_rmse_by_tile(spark: SparkSession, d: str) -> DataFrame:
    pairs = against_label(spectra(spark, d))
    norms = pairs.groupBy("tile").agg(F.sqrt(F.sum(F.col("flux") * F.col("flux"))).alias("norm"))
    return rounded(A.rmse(pairs, ["tile"]).join(norms, "tile"), rmse=6, norm=6)


@query(sql("spectra label_mean", """, e AS (SELECT s, round(sqrt(avg(power(flux - m, 2))), 9) AS v FROM spectra JOIN label_mean USING (c, l) GROUP BY s),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM e)
SELECT CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM e, b GROUP BY 1"""))
def rmse_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(rounded(A.rmse(against_label(spectra(spark, d))), rmse=9), "rmse", 40)


@query(sql("spectra label_mean", """, e AS (SELECT s, sqrt(avg(power(flux - m, 2))) AS v FROM spectra JOIN label_mean USING (c, l) GROUP BY s)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, arg_max(s, v) AS worst, arg_min(s, v) AS best FROM e"""))
def rmse_summary(spark: SparkSession, d: str) -> DataFrame:
    e = A.rmse(against_label(spectra(spark, d)))
    return rounded(e.agg(F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("sd"), F.max_by("s", "rmse").alias("worst"), F.min_by("s", "rmse").alias("best")), mean=6, sd=6)


@query(sql("spectra label_mean", """, a AS (SELECT s, sum(flux * m) / sum(m * m) AS alpha FROM spectra JOIN label_mean USING (c, l) GROUP BY s HAVING sum(m * m) > 0)
SELECT round(median(alpha), 6) AS median, round(min(alpha), 6) AS least, round(max(alpha), 6) AS largest, count(*) AS n FROM a"""))
def alpha_star(spark: SparkSession, d: str) -> DataFrame:
    a = A.optimal_amplitude(against_label(spectra(spark, d)))
    return rounded(a.agg(F.median("alpha").alias("median"), F.min("alpha").alias("least"), F.max("alpha").alias("largest"), F.count("*").alias("n")), median=6, least=6, largest=6)


@query(sql("spectra label_mean", """, g AS (SELECT l, avg(flux) AS gm FROM spectra GROUP BY l),
j AS (SELECT c, 0 AS p, sum(m * (flux - gm)) AS g, sum(m * m) AS d FROM spectra JOIN label_mean USING (c, l) JOIN g USING (l) GROUP BY c)
SELECT c, p, round(g, 6) AS g, round(d, 6) AS d, false AS frozen FROM j"""))
def gradient_precond(spark: SparkSession, d: str) -> DataFrame:
    data = spectra(spark, d)
    models = data.select("s", "c", "l").join(label_mean(data), ["c", "l"]).withColumn("p", F.lit(0))
    errors = data.join(data.groupBy("l").agg(F.avg("flux").alias("gm")), "l").select("s", "l", (F.col("flux") - F.col("gm")).alias("r"))
    return rounded(S.freeze_tiny(J.gradient(models, errors)), g=6, d=6)


# --- amplitudes, energies, supports


def _amplitudes(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return rounded(A.with_share(A.amplitude(losvd(spark, d), mode), "amp", ["s"]), share=9)


@query(sql("losvd", ", a AS (SELECT s, c, sum(h) AS amp FROM losvd GROUP BY s, c) SELECT s, c, amp, round(amp / sum(amp) OVER (PARTITION BY s), 9) AS share FROM a"))
def losvd_amp_sum(spark: SparkSession, d: str) -> DataFrame:
    return _amplitudes(spark, d, "sum")


@query(sql("losvd", """, t AS (SELECT s, c, (h + lag(h) OVER w) / 2 * (v - lag(v) OVER w) AS area FROM losvd WINDOW w AS (PARTITION BY s, c ORDER BY v)),
a AS (SELECT s, c, coalesce(sum(area), 0) AS amp FROM t GROUP BY s, c)
SELECT s, c, amp, CASE WHEN sum(amp) OVER (PARTITION BY s) > 0 THEN round(amp / sum(amp) OVER (PARTITION BY s), 9) ELSE 0 END AS share FROM a"""))
def losvd_amp_trapz(spark: SparkSession, d: str) -> DataFrame:
    return _amplitudes(spark, d, "trapz")


@query(sql("losvd", "SELECT s, c, round(sum(h * v) / sum(h), 6) AS mean, round(sqrt(greatest(sum(h * v * v) / sum(h) - power(sum(h * v) / sum(h), 2), 0)), 6) AS sigma FROM losvd GROUP BY s, c"))
def losvd_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.moments(losvd(spark, d)), mean=6, sigma=6)


@query(sql("losvd", """, a AS (SELECT s, c, sum(h) AS amp FROM losvd GROUP BY s, c), u AS (SELECT c, v, sum(h * amp) AS h FROM losvd JOIN a USING (s, c) GROUP BY c, v)
SELECT c, v, h, round(h / sum(h) OVER (PARTITION BY c), 9) AS h_unit FROM u"""))
def losvd_stack(spark: SparkSession, d: str) -> DataFrame:
    h = losvd(spark, d)
    return rounded(A.weighted_stack(h, A.amplitude(h)), h_unit=9)


@query(sql("cube", "SELECT c, p, round(sum(m * m), 3) AS energy FROM cube GROUP BY c, p"))
def col_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.energy(cube(spark, d)), energy=3)


@query(sql("spectra", "SELECT tile, c, round(sum(flux * flux), 6) AS energy FROM spectra GROUP BY tile, c"))
def tile_component_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.energy(spectra(spark, d).withColumnRenamed("flux", "m"), ["tile", "c"]), energy=6)


@query(sql("spectra", """, e AS (SELECT tile, c, sum(flux * flux) AS energy FROM spectra GROUP BY tile, c), m AS (SELECT tile, median(energy) AS middle FROM e WHERE energy > 0 GROUP BY tile)
SELECT tile, c, energy > 0.7 * middle AS energy_ok FROM e JOIN m USING (tile)"""))
def component_support_energy(spark: SparkSession, d: str) -> DataFrame:
    return S.support_by_energy(A.energy(spectra(spark, d).withColumnRenamed("flux", "m"), ["tile", "c"]), 0.7)


@query(sql("losvd", """, a AS (SELECT s, c, sum(h) AS amp FROM losvd GROUP BY s, c), g AS (SELECT c, max(amp) AS largest FROM a GROUP BY c)
SELECT s // 16 AS tile, c, max(amp) > 0.9 * any_value(largest) AS amp_ok FROM a JOIN g USING (c) GROUP BY 1, 2"""))
def component_support_amp(spark: SparkSession, d: str) -> DataFrame:
    amp = A.amplitude(losvd(spark, d)).withColumn("tile", F.floor(F.col("s") / 16))
    return S.support_by_amplitude(amp, 0.9)


def _flux_reference(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return rounded(A.flux_reference(cube(spark, d), mode), flux_ref=10).orderBy("c", "p")  # a flux has up to nine digits of its own: no value lies halfway


_FLUX = ", f AS (SELECT c, p, s, sum(m) AS f FROM cube GROUP BY c, p, s) SELECT c, p, round(greatest({}(f), 1e-12), 10) AS flux_ref FROM f GROUP BY c, p"


@query(sql("cube", _FLUX.format("avg")))
def cp_flux_ref_mean(spark: SparkSession, d: str) -> DataFrame:
    return _flux_reference(spark, d, "mean")


@query(sql("cube", _FLUX.format("median")))
def cp_flux_ref_median(spark: SparkSession, d: str) -> DataFrame:
    return _flux_reference(spark, d, "median")


@query(sql("cube", _FLUX.replace("{}(f)", "quantile_disc(f, 0.5)")))  # the sketch only brackets the median
def cp_flux_ref_p2(spark: SparkSession, d: str) -> DataFrame:
    return _flux_reference(spark, d, "sketch")


@query(sql("cube", "SELECT s, round(sum(m), 3) AS white_light FROM cube GROUP BY s"))
def white_light(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cube(spark, d).groupBy("s").agg(F.sum("m").alias("white_light")), white_light=3)


@query(sql("spectra", "SELECT tile, round(avg(CASE WHEN flux < 0 THEN 1.0 ELSE 0.0 END), 9) AS negative, bool_or(isnan(flux)) AS any_bad, round(max(abs(flux)), 6) AS largest FROM spectra GROUP BY tile"))
def slab_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.slab_report(spectra(spark, d).withColumnRenamed("flux", "m")), negative=9, largest=6)


@query(sql("cube", ", q AS (SELECT c, median(m) AS med FROM cube GROUP BY c) SELECT c, round(any_value(med), 6) AS median, round(median(abs(m - med)), 6) AS mad FROM cube JOIN q USING (c) GROUP BY c"))
def median_deviation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.median_deviation(cube(spark, d), "m", ["c"]), median=6, mad=6)


@query(sql("cube", """SELECT c, count(*) AS n, round(min(m), 6) AS q00, round(quantile_cont(m, 0.05), 6) AS q05, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.5), 6) AS q50,
round(quantile_cont(m, 0.75), 6) AS q75, round(quantile_cont(m, 0.95), 6) AS q95, round(max(m), 6) AS q100 FROM cube GROUP BY c"""))
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.quantiles(cube(spark, d), "m", by=["c"]), q00=6, q05=6, q25=6, q50=6, q75=6, q95=6, q100=6)


@query(sql("cube", "SELECT t AS threshold, count(*) FILTER (WHERE m <= t) AS n_below, round(count(*) FILTER (WHERE m <= t) / count(*), 9) AS share FROM cube, (SELECT unnest([10.0::DOUBLE, 25, 50, 75]) AS t) GROUP BY t"))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.threshold_sweep(cube(spark, d), "m", [10, 25, 50, 75]), share=9)


# --- windows


@query(sql("spectra", "SELECT l, round(median(flux), 6) AS med FROM spectra GROUP BY l"))
def median_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectra(spark, d).groupBy("l").agg(F.median("flux").alias("med")), med=6)


@query(sql("spectra", """, y AS (SELECT l, CASE WHEN l % 8 <> 0 THEN median(flux) ELSE 0 END AS med FROM spectra GROUP BY l),
b AS (SELECT l, med, abs(sum(med) OVER (ORDER BY l ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 - sum(med) OVER (ORDER BY l ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31) AS d FROM y),
q AS (SELECT coalesce(quantile_cont(d, 0.95), 1) AS q FROM b WHERE d > 0)
SELECT l, round(med, 6) AS med, round(least(greatest(CASE WHEN l % 8 <> 0 THEN 0.2 + 0.8 * power(least(greatest(d / (q + 1e-12), 0), 1), 0.9) ELSE 0 END, 1e-6), 1), 6) AS weight FROM b, q"""))
def lambda_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.smoothing_weights(spectra(spark, d), keep=kept()), med=6, weight=6)


@query(sql("spectra", "SELECT s, l, round(flux - sum(flux) OVER (PARTITION BY s ORDER BY l ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31, 6) AS detrended FROM spectra"))
def detrend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.detrend(spectra(spark, d), "flux", 31, ["s"]).select("s", "l", "detrended"), detrended=6)


@query(sql("spectra", """, w AS (SELECT s, l, flux FROM spectra UNION ALL SELECT s, -l, flux FROM spectra WHERE l BETWEEN 1 AND 3 UNION ALL SELECT s, 126 - l, flux FROM spectra WHERE l BETWEEN 60 AND 62),
a AS (SELECT s, l, avg(flux) OVER (PARTITION BY s ORDER BY l ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM w)
SELECT s, l, round(smooth, 6) AS smooth FROM a WHERE l BETWEEN 0 AND 63"""))
def reflect_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.reflect_mean(spectra(spark, d), "flux", 7, 64, ["s"]).select("s", "l", "smooth"), smooth=6)


@query(sql("spectra", """, o AS (SELECT s, list([l] ORDER BY flux, l) AS ls FROM spectra GROUP BY s), w AS (SELECT unnest([8, 4, 2, 1]) AS w),
p AS (SELECT s, w, list_reduce(ls, lambda a, x: CASE WHEN len(a) < 3 AND NOT list_contains([abs(q - x[1]) >= w FOR q IN a], false) THEN a || x ELSE a END, CAST([] AS BIGINT[])) AS places FROM o, w),
b AS (SELECT s, unnest(arg_max(places, CASE WHEN len(places) >= 3 THEN 10 * w WHEN w = 1 THEN 1 ELSE 0 END)) AS l FROM p GROUP BY s)
SELECT s, l, round(flux, 6) AS flux FROM b JOIN spectra USING (s, l)"""))
def feature_centers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.spaced_peaks(spectra(spark, d), ["s"], 3, 8, "l", "flux"), flux=6)


@query(sql("spectra", ", r AS (SELECT s, l, l - row_number() OVER (PARTITION BY s ORDER BY l) AS run FROM spectra WHERE flux < 0) SELECT s, min(l) AS first, max(l) AS last, count(*) AS size FROM r GROUP BY s, run"))
def mask_runs(spark: SparkSession, d: str) -> DataFrame:
    return N.islands(spectra(spark, d), F.col("flux") < 0, ["s"])


@query(sql("spectra", "SELECT s, l FROM (SELECT s, l, max(CASE WHEN abs(flux) > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY l RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM spectra) WHERE near = 1"))
def feature_windows(spark: SparkSession, d: str) -> DataFrame:
    return N.dilate(spectra(spark, d), F.abs("flux") > 0.3, 2, ["s"]).where("near").select("s", "l")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS coord FROM lineitem),
t AS (SELECT s, coord, coord - lag(coord) OVER (PARTITION BY s ORDER BY coord) AS step FROM a)
SELECT s, coalesce(bool_and(step > 0), true) AS increasing, median(step) AS median_step, count(*) AS n FROM t GROUP BY s""")
def monotone_grid_check(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.datediff("l_shipdate", F.lit("1970-01-01")).cast("double").alias("coord")).distinct()
    return N.monotone(days.withColumn("idx", F.row_number().over(W.partitionBy("s").orderBy("coord"))), by=["s"])


@query(sql("losvd", """, h AS (SELECT c, v, sum(h) AS h FROM losvd GROUP BY c, v), f AS (SELECT c, v, sum(h) OVER (PARTITION BY c ORDER BY v) / sum(h) OVER (PARTITION BY c) AS cdf FROM h),
g AS (SELECT *, lag(cdf) OVER (PARTITION BY c ORDER BY v) AS c0, lag(v) OVER (PARTITION BY c ORDER BY v) AS v0 FROM f), r AS (SELECT *, unnest([0.01::DOUBLE, 0.5, 0.99]) AS q FROM g)
SELECT c, q, round(CASE WHEN c0 IS NULL THEN v ELSE v0 + (q - c0) / (cdf - c0) * (v - v0) END, 6) AS x FROM r WHERE cdf >= q AND (c0 IS NULL OR c0 < q)"""))
def robust_velocity_bounds(spark: SparkSession, d: str) -> DataFrame:
    h = losvd(spark, d).groupBy("c", "v").agg(F.sum("h").alias("h"))
    return rounded(P.inverse_cdf(h, [0.01, 0.5, 0.99], ["c"]), x=6)


# --- axes, rebinning, convolution


def _axis(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 0.01 * F.col("id") * F.col("id")).alias("coord"))


@query(sql("axis edges", "SELECT idx, round(coord, 9) AS coord, round(lo, 9) AS lo, round(hi, 9) AS hi FROM edges"))
def bin_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.bin_edges(_axis(spark)), coord=9, lo=9, hi=9)


@query(sql("spectra axis edges", """, b AS (SELECT min(lo) AS lo, max(hi) AS hi FROM edges), n AS (SELECT j AS l, lo + (hi - lo) * j / 40 AS u, lo + (hi - lo) * (j + 1) / 40 AS v FROM b, range(0, 40) t(j)),
o AS (SELECT e.idx AS t, n.l, (least(e.hi, n.v) - greatest(e.lo, n.u)) / (n.v - n.u) AS w FROM edges e JOIN n ON e.lo < n.v AND n.u < e.hi)
SELECT s.s, o.l, round(sum(s.flux * o.w), 6) AS value FROM spectra s JOIN o ON o.t = s.l GROUP BY s.s, o.l"""))
def rebin_overlap(spark: SparkSession, d: str) -> DataFrame:
    edges = P.bin_edges(_axis(spark))
    ends = edges.agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    width = F.col("b") - F.col("a")
    new = spark.range(40).crossJoin(F.broadcast(ends)).select(F.col("id").alias("idx"), (F.col("a") + width * F.col("id") / 40).alias("lo"), (F.col("a") + width * (F.col("id") + 1) / 40).alias("hi"))
    values = spectra(spark, d).select("s", F.col("l").alias("t"), F.col("flux").alias("value"))
    return rounded(J.rebin(values, P.overlap_operator(edges, new, bucket=5.0), ["s"]), value=6)


@query(sql("spectra axis", """, g AS (SELECT j AS l, j * 102.69 / 49 AS x FROM range(0, 50) t(j)),
a AS (SELECT g.l, g.x, least(greatest((SELECT max(idx) FROM axis WHERE coord <= g.x), 0), 62) AS j FROM g),
w AS (SELECT a.l, a.j, (a.x - p.coord) / (q.coord - p.coord) AS w1 FROM a JOIN axis p ON p.idx = a.j JOIN axis q ON q.idx = a.j + 1)
SELECT s.s, w.l, round(s.flux * (1 - w1) + r.flux * w1, 6) AS value FROM w JOIN spectra s ON s.l = w.j JOIN spectra r ON r.l = w.j + 1 AND r.s = s.s"""))
def rebin_interp(spark: SparkSession, d: str) -> DataFrame:
    points = spark.range(50).select(F.col("id").alias("idx"), (F.col("id") * 102.69 / 49).alias("coord"))
    values = spectra(spark, d).select("s", F.col("l").alias("t"), F.col("flux").alias("value"))
    return rounded(J.rebin(values, P.interpolation_operator(_axis(spark), points), ["s"]), value=6)


KERNEL = [(k, (4 - abs(k)) / 16) for k in range(-3, 4)]
_CONVOLUTION = sql("spectra", ", k AS (SELECT k, (4 - abs(k)) / 16.0 AS h FROM range(-3, 4) t(k)) SELECT s, l + k AS l, round(sum(flux * h), 6) AS value FROM spectra, k WHERE l + k BETWEEN 0 AND 63 GROUP BY s, l + k")


@query(_CONVOLUTION)
def direct_convolution(spark: SparkSession, d: str) -> DataFrame:
    kernel = spark.createDataFrame(KERNEL, "k long, h double")
    values = spectra(spark, d).select("s", F.col("l").alias("t"), F.col("flux").alias("value"))
    return rounded(P.convolve_direct(values, kernel, ["s"], 64).withColumnRenamed("t", "l"), value=6)


@query(_CONVOLUTION)
def fft_convolution(spark: SparkSession, d: str) -> DataFrame:
    dense = table(spark, d, "embeddings").select(F.col("vec_id").alias("s"), F.col("embedding").cast("array<double>").alias("a"))
    out = P.convolve_fft(dense, "s", "a", *map(list, zip(*KERNEL, strict=True)))
    return rounded(out.select("s", F.posexplode("value").alias("l", "value")).withColumn("l", F.col("l").cast("long")), value=6)


@query(sql("spectra", """, t AS (SELECT l, median(flux) AS m FROM spectra GROUP BY l), k AS (SELECT k FROM range(-6, 7) t(k)),
e AS (SELECT s, k, sum(flux * m) / sqrt(sum(flux * flux) * sum(m * m)) AS score FROM spectra JOIN (SELECT l + k AS l, k, m FROM t, k) USING (l) GROUP BY s, k),
n AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b FROM e WINDOW w AS (PARTITION BY s ORDER BY k)), f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, k) AS i FROM n)
SELECT s, k AS lag, round(score, 6) AS score, round(k + least(greatest(CASE WHEN a IS NULL OR b IS NULL OR abs(a - 2 * score + b) < 1e-30 THEN 0 ELSE 0.5 * (a - b) / (a - 2 * score + b) END, -0.5), 0.5), 5) AS peak FROM f WHERE i = 1"""))
def xcorr_best_shift(spark: SparkSession, d: str) -> DataFrame:
    data = spectra(spark, d)
    return rounded(P.best_shift(data, data.groupBy("l").agg(F.median("flux").alias("m")), 6), score=6, peak=5)


@query(f"SELECT DISTINCT CAST(l_quantity AS BIGINT) AS v, round(ln(1 + l_quantity / {LIGHT_SPEED}) / 1e-4, 6) AS pixels, round({LIGHT_SPEED} * (exp(l_quantity * 1e-4) - 1), 4) AS velocity FROM lineitem")
def velocity_units(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("v")).distinct()
    return rounded(v.select("v", velocity_to_pixels("v", 1e-4).alias("pixels"), pixels_to_velocity("v", 1e-4).alias("velocity")), pixels=6, velocity=4)


# --- normalisation, mixtures


@query(sql("losvd cube", """, a AS (SELECT s, c, sum(h) AS amp FROM losvd GROUP BY s, c), f AS (SELECT s, avg(m) AS mean FROM cube GROUP BY s)
SELECT a.s, a.c, round(amp / sum(amp) OVER (PARTITION BY a.s) * mean, 6) AS scale FROM a JOIN f ON f.s = a.s"""))
def norm_data_mode(spark: SparkSession, d: str) -> DataFrame:
    flux = cube(spark, d).groupBy("s").agg(F.avg("m").alias("mean"))
    return rounded(X.data_scale(A.amplitude(losvd(spark, d)), flux), scale=6)


@query(sql("losvd cube", ", a AS (SELECT s, sum(h) AS total FROM losvd GROUP BY s), f AS (SELECT s, avg(m) AS mean FROM cube GROUP BY s) SELECT s, round(total / greatest(mean, 1e-30), 6) AS factor FROM a JOIN f USING (s)"))
def norm_convert(spark: SparkSession, d: str) -> DataFrame:
    totals = losvd(spark, d).groupBy("s").agg(F.sum("h").alias("total"))
    return rounded(X.convert_factor(totals, cube(spark, d).groupBy("s").agg(F.avg("m").alias("mean")), "model"), factor=6)


_MIX = ", x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p), u AS (SELECT c, sum(x) / (SELECT sum(x) FROM x) AS u, c / (SELECT CAST(sum(c) AS DOUBLE) FROM (SELECT DISTINCT c FROM x)) AS t FROM x GROUP BY c)"


@query(sql("cube", _MIX + " SELECT round(sum(abs(u - t)), 6) AS l1, round(max(abs(u - t)), 6) AS l_inf, round(sum(u * t) / (sqrt(sum(u * u)) * sqrt(sum(t * t))), 6) AS cosine, round(corr(u, t), 5) AS pearson, arg_max(c, u) AS argmax FROM u"))
def usage_vs_prior(spark: SparkSession, d: str) -> DataFrame:
    x = masses(spark, d)
    report = serve.mix_report(x, ramp(x)).drop("kl_xy", "kl_yx")
    return rounded(report, l1=6, l_inf=6, cosine=6, pearson=5)


@query(sql("cube", _MIX + " SELECT round(sum((t + 1e-12) * (ln(t + 1e-12) - ln(u + 1e-12))), 6) AS kl_xy, round(sum((u + 1e-12) * (ln(u + 1e-12) - ln(t + 1e-12))), 6) AS kl_yx FROM u"))
def kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    x = masses(spark, d)
    return rounded(serve.mix_report(x, ramp(x)).select("kl_xy", "kl_yx"), kl_xy=6, kl_yx=6)


@query(sql("cube", _MIX + " SELECT c, p, round(0.8 * x + 0.2 * t / u * x, 3) AS x FROM x JOIN u USING (c)"))
def project_weights(spark: SparkSession, d: str) -> DataFrame:
    x = masses(spark, d)
    return rounded(X.project_to_mix(x, ramp(x)), x=3)


@query(sql("cube", _MIX + " SELECT c, p, round(x * CASE WHEN u > 1.3 * t THEN 0.8 + 0.2 * 1.3 * t / u WHEN u < 0.7 * t THEN 0.8 + 0.2 * 0.7 * t / u ELSE 1 END, 3) AS x FROM x JOIN u USING (c)"))
def softbox(spark: SparkSession, d: str) -> DataFrame:
    x = masses(spark, d)
    return rounded(X.softbox(x, ramp(x)), x=3)


@query(sql("cube", _MIX + ", f AS (SELECT c, u, least(greatest(exp(-0.8 * (ln(u) - ln(t))), 1 / 1.3), 1.3) AS f FROM u) SELECT c, p, round(x * f / (SELECT sum(u * f) FROM f), 3) AS x FROM x JOIN f USING (c)"))
def ratio_update(spark: SparkSession, d: str) -> DataFrame:
    x = masses(spark, d)
    return rounded(X.ratio_update(x, ramp(x)), x=3)


# --- order, samples, sets


_ENERGY = ", e AS (SELECT c, p, sum(m * m) AS energy FROM cube GROUP BY c, p)"


@query(sql("cube", _ENERGY + " SELECT * FROM (SELECT c, p, round(energy, 3) AS energy, row_number() OVER (PARTITION BY c ORDER BY energy DESC, p) AS rank FROM e) WHERE rank <= 2"))
def topk_pops_per_comp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.top_per_group(A.energy(cube(spark, d)), ["c"], 2, F.desc("energy"), F.asc("p")), energy=3)


@query(sql("cube", _ENERGY + """, r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY energy DESC, p) > 1 AS backfilled FROM e)
SELECT c, p, round(energy, 3) AS energy, backfilled FROM r ORDER BY backfilled, r.energy DESC, c, p LIMIT 12"""))
def topk_backfill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.top_with_backfill(A.energy(cube(spark, d)), ["c"], 1, 12, "energy", ["c", "p"]), energy=3)


@query("WITH t AS (SELECT DISTINCT doc_id // 16 AS tile FROM documents), n AS (SELECT tile, ntile(8) OVER (ORDER BY tile) AS stratum FROM t) SELECT arg_min(tile, (md5('12345:' || tile), tile)) AS tile, CAST(stratum AS INTEGER) AS stratum FROM n GROUP BY stratum")
def fair_spread_tiles(spark: SparkSession, d: str) -> DataFrame:
    tiles = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("tile")).distinct()
    return O.fair_spread(tiles, "tile", 8, 12345)


@query("WITH b AS (SELECT min(vec_id) AS low, max(vec_id) - min(vec_id) + 1 AS n FROM embeddings) SELECT DISTINCT CAST(low + floor(i * (n - 1) / 31) AS BIGINT) AS vec_id FROM b, range(0, 32) t(i)")
def even_spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.even_spread(table(spark, d, "embeddings").select("vec_id"), "vec_id", 32)


@query("SELECT vec_id FROM embeddings ORDER BY md5('12345:' || vec_id), vec_id LIMIT 32")
def seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    return O.seeded_choice(table(spark, d, "embeddings").select("vec_id"), "vec_id", 32, 12345)


@query(sql("cube", """, m AS (SELECT s, round(sum(m), 3) AS m FROM cube GROUP BY s), t AS (SELECT * FROM m ORDER BY m DESC, s LIMIT 7)
SELECT * FROM t UNION ALL SELECT * FROM (SELECT * FROM m WHERE s NOT IN (SELECT s FROM t) ORDER BY md5('12345:' || s), s LIMIT 3)"""))
def bright_first(spark: SparkSession, d: str) -> DataFrame:
    return O.bright_first(rounded(cube(spark, d).groupBy("s").agg(F.sum("m").alias("m")), m=3), "m", "s", 10)


@query(sql("cube", """, e AS (SELECT s, c, sum(m) AS v FROM cube GROUP BY s, c), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, c) AS a, row_number() OVER (PARTITION BY c ORDER BY v DESC, s) AS b FROM e)
SELECT s, c, round(v, 3) AS v FROM r ORDER BY greatest(a, b), r.v DESC, s, c LIMIT 8"""))
def diverse_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.diverse_pairs(cube(spark, d).groupBy("s", "c").agg(F.sum("m").alias("v")), "s", "c", "v", 8), v=3)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_tiles(spark: SparkSession, d: str) -> DataFrame:
    return S.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT d.doc_id // 128 AS tile, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def done_ratio(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("is_done", F.lit(1.0))
    joined = table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left")
    return rounded(joined.groupBy(F.floor(F.col("doc_id") / 128).alias("tile")).agg(F.avg(F.coalesce("is_done", F.lit(0.0))).alias("done")), done=9)


@query(sql("cube", """, t AS (SELECT s AS c, sum(m) AS mass, max(m) AS grad FROM cube GROUP BY s), g AS (SELECT greatest(sum(mass), 1) AS m, greatest(max(grad), 1) AS g FROM t)
SELECT c FROM t, g WHERE mass > 0.0101 * m OR grad > 0.999 * g UNION SELECT c FROM (SELECT c FROM t ORDER BY grad DESC, c LIMIT 8)"""))
def active_components(spark: SparkSession, d: str) -> DataFrame:
    state = cube(spark, d).groupBy(F.col("s").alias("c")).agg(F.sum("m").alias("mass"), F.max("m").alias("grad"))
    return S.active_components(state, 0.0101, 0.999)


@query("WITH b AS (SELECT o_custkey AS bin, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT o_orderkey AS pix, n, round(total, 2) AS total FROM orders JOIN b ON b.bin = o_custkey")
def pixel_bin_join(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "orders").select(F.col("o_orderkey").alias("pix"), F.col("o_custkey").alias("bin"), "o_totalprice")
    bins = pixels.groupBy("bin").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(pixels.select("pix", "bin").join(bins, "bin").select("pix", "n", "total"), total=2)


@query(sql("cube", "SELECT CAST(CASE WHEN c <= 2 THEN 0 WHEN c <= 4 THEN 1 ELSE 2 END AS BIGINT) AS otype, p, round(sum(m), 3) AS x FROM cube GROUP BY 1, 2"))
def sfh_by_type(spark: SparkSession, d: str) -> DataFrame:
    types = spark.createDataFrame([(0, float("-inf"), 2.0), (1, 2.0, 4.0), (2, 4.0, float("inf"))], "otype long, lo double, hi double")  # bins closed on the right
    joined = cube(spark, d).groupBy("c", "p").agg(F.sum("m").alias("x")).join(F.broadcast(types), (F.col("c") > F.col("lo")) & (F.col("c") <= F.col("hi")))
    return rounded(joined.groupBy("otype", "p").agg(F.sum("x").alias("x")), x=3)


@query("SELECT p_partkey AS p, p_partkey // 20 AS z, p_partkey // 4 % 5 AS age, p_partkey % 4 AS alpha FROM part")
def population_grid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    return p.withColumns(population_axes(F.col("p"), 5, 4))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM (VALUES (3.0, 5.0), (17.0, 21.0), (44.0, 46.0)) w(lo, hi) WHERE l.l_quantity BETWEEN w.lo AND w.hi)")
def window_mask(spark: SparkSession, d: str) -> DataFrame:
    windows = spark.createDataFrame([(3.0, 5.0), (17.0, 21.0), (44.0, 46.0)], "lo double, hi double")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return items.join(F.broadcast(windows), F.col("l_quantity").between(F.col("lo"), F.col("hi")), "left_anti").select("l_orderkey", "l_linenumber")


@query(sql("spectra label_mean", """, g AS (SELECT a.c AS i, b.c AS j, sum(a.m * b.m) AS g FROM label_mean a JOIN label_mean b ON a.l = b.l AND a.c <= b.c GROUP BY 1, 2), n AS (SELECT i AS c, sqrt(g) AS n FROM g WHERE i = j)
SELECT i, j, round(abs(g) / (x.n * y.n), 6) AS coherence FROM g JOIN n x ON x.c = i JOIN n y ON y.c = j WHERE i < j AND abs(g) / (x.n * y.n) > 0.1"""))
def column_coherence(spark: SparkSession, d: str) -> DataFrame:
    pairs = J.coherence(J.gram(label_mean(spectra(spark, d)), ["c"], ["l"])).where("coherence > 0.1")
    return rounded(pairs.select("i.c", F.col("j.c").alias("j"), "coherence").withColumnRenamed("c", "i"), coherence=6)


# --- solving


@query(sql("spectra", "SELECT DISTINCT c, 0 AS p, CAST(c % 3 AS DOUBLE) AS x FROM spectra"))
def nnls_global(spark: SparkSession, d: str) -> DataFrame:
    """Recovers planted weights from the spectrum they make."""
    models = label_mean(spectra(spark, d)).select(F.lit(0).alias("s"), "l", "c", F.lit(0).alias("p"), "m")
    planted = models.select("c", "p", (F.col("c") % 3).cast("double").alias("x")).distinct()
    eq = normal_equations(models, J.predict(models, planted).withColumnRenamed("yhat", "flux"))
    return rounded(solution_frame(models, eq, np.round(nnls_active_set(eq.g, eq.b), 9)), x=6)


@query(sql("spectra", """, a AS (SELECT s, c, l, flux - avg(flux) OVER (PARTITION BY s) AS m FROM spectra), g AS (SELECT l, avg(flux) AS y FROM spectra GROUP BY l), h AS (SELECT l, y - (SELECT avg(y) FROM g) AS y FROM g)
SELECT c, 0 AS p, round(greatest(sum(m * y) / (sum(m * m) + 1e-12), 0), 6) AS x, round(abs(sum(m * y)) / sqrt(sum(m * m)), 6) AS score FROM a JOIN h USING (l) GROUP BY c"""))
def jacobi_start(spark: SparkSession, d: str) -> DataFrame:
    data = spectra(spark, d)
    models = data.select("s", "l", "c", F.lit(0).alias("p"), F.col("flux").alias("m"))
    target = data.select("s", "l").join(data.groupBy("l").agg(F.avg("flux").alias("flux")), "l")
    return rounded(jacobi_seed(models, target), x=6, score=6)


# --- tracking


@query("""SELECT event_type, round(list_reduce(list(value ORDER BY ts, event_id), lambda e, v: CASE WHEN v > 1000 * greatest(e, 1) THEN e ELSE 0.98 * e + 0.02 * v END), 9) AS ewma, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def ewma_by_type(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracker.ewma(events(spark, d), "event_type", ["ts", "event_id"], "value"), ewma=9)


@query("SELECT event_id, event_type, i AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 16 = 0")
def metric_subsample(spark: SparkSession, d: str) -> DataFrame:
    return tracker.every_nth(events(spark, d), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "seq")


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS last, arg_min(event_id, (value, ts, event_id)) AS best, round(min(value), 6) AS best_value FROM events GROUP BY event_type")
def snapshot_last_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracker.last_and_best(events(spark, d), "event_type", "value", F.struct("ts", "event_id"), F.col("event_id")), best_value=6)


@query("SELECT event_id, event_type, i % 96 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i >= n - 96")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return tracker.ring(events(spark, d), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "slot")


@query("""WITH k AS (SELECT c_nationkey AS run, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey % 5 END AS epoch, c_acctbal AS mtime, c_custkey AS id FROM customer), a AS (SELECT run, bool_and(epoch IS NOT NULL) AS known FROM k GROUP BY run),
r AS (SELECT k.run, id, row_number() OVER (PARTITION BY k.run ORDER BY CASE WHEN known THEN epoch ELSE 0 END DESC, mtime DESC, id) AS i FROM k JOIN a ON a.run = k.run) SELECT run, id FROM r WHERE i = 1""")
def resume_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    saved = c.select(F.col("c_nationkey").alias("run"), F.when(F.col("c_custkey") % 97 != 0, F.col("c_custkey") % 5).alias("epoch"), F.col("c_acctbal").alias("mtime"), F.col("c_custkey").alias("id"))
    return tracker.resume_choice(saved, "run")


@query("""WITH k AS (SELECT event_type, unnest(list_reduce(list([{'t': epoch_us(ts), 'id': event_id}] ORDER BY ts, event_id), lambda a, x: CASE WHEN len(a) = 0 OR x[1].t - a[-1].t >= 3600000000 THEN a || x ELSE a END, CAST([] AS STRUCT(t BIGINT, id BIGINT)[]))) AS e FROM events GROUP BY event_type)
SELECT k.event_type, ts, event_id FROM k JOIN events ON event_id = e.id AND events.event_type = k.event_type""")
def snapshot_throttle(spark: SparkSession, d: str) -> DataFrame:
    return tracker.throttle(events(spark, d), "event_type", "ts", 3600, ["event_id"])


# --- reports


@query("""SELECT 'embeddings' AS name, 'wrong length' AS issue, count(*) FILTER (WHERE len(embedding) <> 64) AS n FROM embeddings UNION ALL SELECT 'labels', 'no such document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'lineitem', 'not positive', count(*) FILTER (WHERE NOT l_quantity > 0) FROM lineitem""")
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    row = lambda name, issue, df, bad: df.agg(F.count_if(bad).alias("n")).select(F.lit(name).alias("name"), F.lit(issue).alias("issue"), "n")
    orphans = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    out = row("embeddings", "wrong length", table(spark, d, "embeddings"), F.size("embedding") != 64)
    return out.unionByName(row("labels", "no such document", orphans, F.lit(True))).unionByName(row("lineitem", "not positive", table(spark, d, "lineitem"), ~(F.col("l_quantity") > 0)))


@query(sql("cube", ", x AS (SELECT c, p, sum(m) AS x FROM cube GROUP BY c, p) SELECT sha1(string_agg(printf('%.3f', x), ',' ORDER BY c, p)) AS digest, count(*) AS n FROM x"))
def solution_digest(spark: SparkSession, d: str) -> DataFrame:
    return serve.solution_digest(masses(spark, d), 3)


@query(sql("spectra", "SELECT s, len(list(flux ORDER BY l)) AS n, round(list_sum(list(flux ORDER BY l)), 6) AS total FROM spectra GROUP BY s"))
def dense_spectra(spark: SparkSession, d: str) -> DataFrame:
    dense = to_dense(spectra(spark, d).withColumnRenamed("flux", "value"), ["s"])
    return rounded(dense.select("s", F.size("flux").cast("long").alias("n"), F.aggregate("flux", F.lit(0.0), lambda a, v: a + v).alias("total")), total=6)


# --- column scales, triage, maps, cuts, layouts and seeds register themselves

from . import catalog_columns, catalog_shapes  # noqa: E402, F401
