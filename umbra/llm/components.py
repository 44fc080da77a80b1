"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, spread_join, written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node with a link.

    links: pairs a, b of longs in any order; loops and repeats don't matter, a
    pair with a null isn't one, and other columns are ignored; no links give no rows.
    Each round a node's neighbours are linked to the smallest node next to it:
    large stars move larger neighbours, small stars the rest. Rounds grow with
    the logarithm of the longest chain; each is written to the shared folder,
    and only its edge count and a sum of hashes reach the driver.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before, few = state, 2 * state[0] <= BROADCAST_ROWS

        def joined(rows: DataFrame, side: DataFrame, on: str, weight: str, few=few) -> DataFrame:
            """A star's centre is one key of many edges: it is never shuffled by itself."""
            return rows.join(F.broadcast(side), on) if few else spread_join(written(rows, "rows"), written(side, "side"), on, weight)

        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("d"))
        large = joined(both.filter("v > u"), least, "u", "d").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        small = joined(large, low, "a", "d").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = written(small.filter("a <> b").distinct(), "edges")
