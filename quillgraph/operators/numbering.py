"""Consecutive numbers over a whole table without sending it through one task.

Rows are range-partitioned once and written with their place in the partition; numbers are made
on reading from small tables of what lies in earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import written


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in order, with the number of their partition and a place that grows inside it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), "ranged"
    )


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add 1..n in the given order (the order columns must identify a row)."""
    placed = _placed(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    shifts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # One row per partition.
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift")
    )


def numbered_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Add 1..n inside every group; a group may span many tasks.

    A row's number is its place since its group began in the partition, plus the rows of the
    group in earlier partitions. That table has a row per partition and per group that begins in
    it; Spark broadcasts it where it is small.
    """
    placed = _placed(df, [*group, *order])
    keys = [*group, "_part"]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    shifts = runs.select(
        *(F.col(k).alias(f"_of_{k}") for k in keys),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(shifts[f"_of_{k}"]) for k in keys))
    return placed.join(shifts, same).withColumn(name, F.col("_place") + F.col("_shift")).select(*df.columns, name)
