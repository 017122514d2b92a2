"""The engine's inputs as views of the shared Parquet tables, in Spark and in SQL.

Spectra are embeddings (aperture, label as component, place as wavelength); the
long cube and the velocity histograms are line items; metrics are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.shapes import tile_of, to_long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, c, l, flux, tile)"""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.col("label").cast("long").alias("c"), "embedding")
    return to_long(rows, "embedding", ["s", "c"], "l", "flux").withColumn("tile", tile_of("s"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, c, p, l, m)"""
    t = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return t.select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("c"), F.concat("l_returnflag", "l_linestatus").alias("p"), month.alias("l"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000.0).alias("m"))


def losvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, c, v, h)"""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("c"), F.col("l_quantity").cast("long").alias("v"))
    return t.groupBy("s", "c", "v").agg(F.count("*").cast("double").alias("h"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


VIEWS = {
    "spectra": "spectra AS (SELECT vec_id AS s, CAST(label AS BIGINT) AS c, l, CAST(v AS DOUBLE) AS flux, vec_id // 128 AS tile FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS l, unnest(embedding) AS v FROM embeddings))",
    "label_mean": "label_mean AS (SELECT c, l, avg(flux) AS m FROM spectra GROUP BY c, l)",
    "cube": "cube AS (SELECT l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS c, l_returnflag || l_linestatus AS p, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS l, l_extendedprice * (1 - l_discount) / 1000.0 AS m FROM lineitem)",
    "losvd": "losvd AS (SELECT l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS h FROM lineitem GROUP BY 1, 2, 3)",
    "axis": "axis AS (SELECT l AS idx, l + 0.01 * l * l AS coord FROM range(0, 64) t(l))",
    "edges": "edges AS (SELECT idx, coord, coalesce((lag(coord) OVER w + coord) / 2, coord - (lead(coord) OVER w - coord) / 2) AS lo, coalesce((lead(coord) OVER w + coord) / 2, coord + (coord - lag(coord) OVER w) / 2) AS hi FROM axis WINDOW w AS (ORDER BY idx))",
}


def sql(views: str, body: str) -> str:
    """The body with the named views before it."""
    return f"WITH {', '.join(VIEWS[v] for v in views.split())}{body if body.startswith(',') else ' ' + body}"
