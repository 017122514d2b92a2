"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to smaller neighbours (Kiveris et al., 2014);
the number of rounds grows with the logarithm of the longest path.  Minima are
pre-aggregated on the map side; the joins back have one row a node on one side,
so that adaptive execution can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

#: Links that one task reads.
ROWS = 200_000


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); the component is its smallest node."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", ROWS)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "stars", ROWS)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
