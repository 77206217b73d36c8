"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) and the smallest node that it is connected to.

    Alternates two steps until nothing changes: a node links its larger neighbours to its smallest one, then itself
    and its smaller neighbours to the smallest. Every step is a minimum, combined before the shuffle, and a join that
    AQE splits where one node has many links; no node's links are ever gathered. Each step is stored. Self-links and
    nulls are dropped; an empty table gives no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links)
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # From here on every link runs from the larger a to the smaller b.
        large = stored(both.join(smallest, "a").filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
