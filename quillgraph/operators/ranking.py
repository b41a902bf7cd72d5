"""Top-k selection shared by every retriever."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are rounded before ranking so exact copies tie and the id decides.
SCORE_DIGITS = 6


def top_k(
    df: DataFrame,
    k: int,
    score: str = "score",
    per: Sequence[str] = ("query_id",),
    ties: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows ranked 1..k per group by score, ids breaking ties.

    ``row_number() <= k`` lets Spark keep only k rows per group in every map task before
    the shuffle, so a group holding most of the rows never travels whole.
    """
    order: list[Column] = [F.desc(score), *[F.asc(t) for t in ties]]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def global_top_k(df: DataFrame, k: int, score: str, ties: Sequence[str]) -> DataFrame:
    """The k best rows of a whole table (a distributed take-ordered, not a full sort)."""
    return df.orderBy(F.desc(score), *[F.asc(t) for t in ties]).limit(k)
