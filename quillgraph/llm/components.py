"""Connected components of an edge table by alternating large and small stars.

Only edges move; every step is a minimum per node, combined before the shuffle, joined back to
the edges, so a node with very many edges is split by the skew handling of the join. Every round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import discard, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (or on the node itself).

    Edges are (u, v) with u > v. ``small`` looks at smaller neighbours only, else every node's
    larger neighbours are hung.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("x"), "m")
        found = hung.unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        found = edges.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u").select("x", "m")
        own = least.where("m < u").select(F.col("u").alias("x"), "m")
        found = found.unionByName(own)
    return found.where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and only on nodes that hang on none."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")),
    )))
    ties = ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.count("*").alias("all"))
    return ties.where("up > 1 or up = 1 and all > 1").isEmpty()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node reachable.

    Self links, nulls and repeated edges are harmless; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = stored(pairs, "edges")
    while not _stars(current):
        following = stored(_star(_star(current, False), True), "edges")
        discard(current)
        current = following
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
