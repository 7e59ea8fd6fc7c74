"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.session import materialize


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)``: for each node with an edge the smallest node it can reach.

    Large-star and small-star steps in turn: every round points the neighbours
    of a node at the smallest one, so that paths shrink by a constant factor
    and the number of edges never grows. A hub is one key of a sum with map-side
    combine and of an equality join, which adaptive execution can split. Each
    round is written to the shared folder, so a lost executor costs one round.

    Nulls and loops make no edge; repeated edges count once; no edges give no
    rows.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    links = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        links = materialize(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Of each node, larger neighbours are linked to the smallest of all."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    lowest = lowest.select("node", F.least("node", "low").alias("low"))
    return links.join(lowest, links.v == lowest.node).select("u", F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Of each node, it and its smaller neighbours are linked to the smallest."""
    lowest = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    moved = links.join(lowest, links.u == lowest.node).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(lowest.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct()
