"""Connected components by alternating large-star and small-star steps.

In a step, the least neighbour of each node is found by map-side minima and joined back to its edges, so the rows of
a step never outnumber twice the edges. Edges between steps are tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): neighbours are tied to the least node around ``u``."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    joined = both.join(least, both.u == least.c)
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.filter(F.col("c") != F.col("m")).select(F.col("c").alias("u"), F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The least node of the component of each node in ``edges``.

    ``edges``: columns u, v (long, no nulls; loops and repeats are allowed).
    Returns a written table (node, component) of nodes that have an edge to another node.
    Empty edges give an empty result. Raises if it has not converged after
    ``max_rounds`` double steps (the number needed is logarithmic).
    """
    now = store.table(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        new = store.table(_star(_star(now, True), False), "edges")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(now)
        now = new
        if row == mark:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = store.table(nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            store.drop(now)
            return out
        mark = row
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
