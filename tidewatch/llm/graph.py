"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.session import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Joins each edge with the smallest neighbour of its `u`; a hub's edges can be split."""
    return spread_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), ["u"])


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (the smallest node reachable) of every node with an edge.

    `edges` has `u` and `v` of one ordered type. Alternating large and small stars:
    neighbours are re-hung under the smallest neighbour until the graph is a set of
    stars, in a logarithmic number of rounds. Each round is written to the shared
    folder, and nothing but a fingerprint of the edges reaches the driver.
    """
    tidy = F.col("u") > F.col("v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(tidy).distinct()
    before, edges = None, stored(edges, "edges")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter(tidy).distinct()
        small = _smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(tidy).unionAll(
            small.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
