"""Reachability over edge tables by rounds of joins whose results are appended to files.

A round reads what earlier rounds wrote and writes its new pairs only; no pair is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.skew import hot_join
from quillgraph.session import shared_path, written


class Rounds:
    """Rows of one shape, appended round by round under a new path of the shared folder."""

    def __init__(self, first: DataFrame, label: str):
        self.spark, self.path, self.last = first.sparkSession, shared_path(first.sparkSession, label), -1
        self.shape = first.schema
        self.append(first)

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the rows of the next round and read them back."""
        self.last += 1
        rows.write.parquet(f"{self.path}/round={self.last}")
        return self.spark.read.schema(self.shape).parquet(f"{self.path}/round={self.last}")

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        shape = T.StructType([*self.shape.fields, T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(shape).parquet(self.path).drop("round")


def ancestors(edges: DataFrame, include_self: bool = False) -> DataFrame:
    """Distinct (node, ancestor) over ``edges(child, parent)`` by semi-naive joins.

    Every round extends only the pairs found in the round before, so a hierarchy of depth
    d needs d rounds and cycles end when nothing new appears.
    """
    step = written(edges.select("child", "parent").distinct(), "edges")
    known = Rounds(step.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")), "ancestors")
    frontier = known.all()
    while True:
        reached = (
            frontier.join(step, frontier["ancestor"] == step["child"])
            .select("node", F.col("parent").alias("ancestor"))
            .distinct()
            .join(known.all(), ["node", "ancestor"], "left_anti")
        )
        frontier = known.append(reached)
        if frontier.isEmpty():
            break
    found = known.all()
    if include_self:
        nodes = step.select(F.col("child").alias("node")).union(step.select("parent")).distinct()
        found = found.unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct()
    return found


def members_of(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Members of every type including those of its descendants: (type, member).

    A type may hold most members: they meet the few ancestors of their type in many tasks.
    """
    up = ancestors(edges).select(F.col("node").alias("type"), "ancestor")
    own = membership.select("type", "member")
    inherited = hot_join(own, up, ["type"], "member").select(F.col("ancestor").alias("type"), "member")
    return own.unionByName(inherited).distinct()


def terminals(edges: DataFrame) -> DataFrame:
    """(node, terminal) for every non-terminal node over ``edges(src, dst)``.

    Path doubling: after round i an open pair stands for up to 2^i steps, so a chain of length n
    takes log2(n) rounds. Pairs that reached a terminal are written once and stay; only open
    pairs go on.
    """
    ends, _ = _ends(written(edges.select("src", "dst").distinct(), "chain"))
    return ends.distinct()


def _ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, terminal) of a written chain, and the nodes left that only go round.

    A pair reached by ways of different length repeats. Every node with an edge out of it is in
    one of the two tables at least.
    """
    inner = edges.select(F.col("src").alias("dst")).distinct().withColumn("inner", F.lit(True))
    marked = written(
        edges.join(inner, "dst", "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("open")), "chain"
    )
    # Each round's pairs are written once; the closed ones are read from there.
    closed = marked.where("not open").select("src", "dst")
    open_ = marked.where("open").select("src", "dst")
    left, covered = open_.count(), 1
    # A walk without a terminal after as many steps as there are open pairs goes round for ever.
    while left and covered <= left:
        ended = closed.withColumn("open", F.lit(False))
        onward = ended.unionByName(open_.withColumn("open", F.lit(True))).select(
            F.col("src").alias("dst"), F.col("dst").alias("end"), "open"
        )
        moved = written(open_.join(onward, "dst").select("src", F.col("end").alias("dst"), "open").distinct(), "moved")
        closed = closed.unionByName(moved.where("not open").select("src", "dst"))
        open_ = moved.where("open").select("src", "dst")
        covered *= 2
        if open_.isEmpty():
            break
    return closed.select(F.col("src").alias("node"), F.col("dst").alias("terminal")), open_.select(F.col("src").alias("node"))


def propagate_to_terminals(values: DataFrame, chain: DataFrame) -> DataFrame:
    """Move a value from non-terminal nodes to every terminal they reach.

    ``values(node, value)``, one row a node; a terminal that has its own value is overwritten by a
    moved one (the largest when several arrive), non-terminals lose theirs.
    """
    ends, round_ = _ends(written(chain.select("src", "dst").distinct(), "chain"))
    # A node that only goes round has no terminal: its value goes nowhere.
    to = ends.unionByName(round_.select("node", F.lit(None).cast(ends.schema["terminal"].dataType).alias("terminal")))
    to = to.withColumn("inner", F.lit(True))
    sent = values.join(to, "node", "left").select(
        F.when(F.col("inner"), F.col("terminal")).otherwise(F.col("node")).alias("node"),
        F.coalesce("inner", F.lit(False)).alias("moved"),
        "value",
    )
    # A moved value goes before an own one, whatever they are.
    best = F.when(F.max("moved"), F.max(F.when(F.col("moved"), F.col("value")))).otherwise(F.max("value"))
    return sent.where("node is not null").groupBy("node").agg(best.alias("value"))
