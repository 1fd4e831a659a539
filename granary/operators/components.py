"""Connected components of a link table, by alternating large-star and small-star steps.

No step gathers a component: each one is a minimum per node, pre-aggregated, and a join on the node.
Every round is written to the shared folder, so lineage stays short and a lost executor costs a read; the one before
goes once the next is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granary.session import placed, removed


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The links written and read again, their path, and how many they are with a sum of their hashes, taken on the way."""
    seen = Observation()
    edges, path = placed(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return edges, path, (seen.get["n"], seen.get["h"])


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another.

    links: two bigint columns, in either direction, repeats allowed; nulls and self-links are left out."""
    u, v = F.col(src), F.col(dst)
    edges = links.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges, path, state = _written(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        edges, path, now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        removed(edges.sparkSession, before)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
