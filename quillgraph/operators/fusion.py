"""Weighted reciprocal rank fusion and the hybrid retrievers built on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.ranking import top_k

# Rank constant and the tags put on fused rows.
RRF_K1 = 60
FUSED = "hybrid_rrf"
FALLBACK = "text2cypher_vector_fallback"
RRF_DIGITS = 9

Retriever = Callable[[DataFrame, int], DataFrame]


def text_identity(text: Column, source_file: Column) -> Column:
    """Identity by the digest of the whole text and by the file; null counts as empty."""
    empty = F.lit("")
    return F.concat_ws("_", F.md5(F.coalesce(text, empty)), F.coalesce(source_file, empty))


def _stack(components: Sequence[tuple[str, DataFrame]], weights: Sequence[float]) -> DataFrame:
    stacked: DataFrame | None = None
    for position, ((name, ranked), weight) in enumerate(zip(components, weights, strict=True)):
        part = ranked.select(
            "query_id",
            "doc_id",
            "rank",
            "score",
            F.lit(name).alias("component"),
            F.lit(position).alias("position"),
            F.lit(float(weight)).alias("weight"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("nothing to fuse")
    return stacked


def rrf(
    components: Sequence[tuple[str, DataFrame]],
    k: int = 10,
    weights: Sequence[float] | None = None,
    k1: int = RRF_K1,
) -> DataFrame:
    """Fuse named rankings: score = sum of weight / (k1 + rank) over every occurrence.

    The component seen last (component order, then rank) is the row's source; the last
    score of each component is kept in ``retriever_scores``.
    """
    weights = [1.0] * len(components) if weights is None else weights
    if len(weights) != len(components):
        raise ValueError("number of weights must match number of components")
    per_component = (
        _stack(components, weights)
        .groupBy("query_id", "doc_id", "component", "position")
        .agg(
            F.sum(F.col("weight") / (k1 + F.col("rank"))).alias("part"),
            F.max_by("score", "rank").alias("score"),
            F.max("rank").alias("rank"),
        )
    )
    entry = F.struct("position", "component", "score")
    fused = per_component.groupBy("query_id", "doc_id").agg(
        F.round(F.sum("part"), RRF_DIGITS).alias("score"),
        F.max_by("component", F.struct("position", "rank")).alias("source_retriever"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    scores = F.map_from_entries(
        F.transform("entries", lambda e: F.struct(e["component"], e["score"]))
    )
    return top_k(fused.withColumn("retriever_scores", scores), k).select(
        "query_id",
        "rank",
        "doc_id",
        "score",
        F.lit(FUSED).alias("search_type"),
        "source_retriever",
        "retriever_scores",
    )


def hybrid(
    queries: DataFrame,
    retrievers: Sequence[tuple[str, Retriever]],
    k: int = 10,
    weights: Sequence[float] | None = None,
    k1: int = RRF_K1,
) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Run every component at 2k, fuse to k; returns the fusion and the component rankings."""
    components = [(name, search(queries, 2 * k)) for name, search in retrievers]
    return rrf(components, k, weights, k1), components


def fuse_with_fallback(
    structured: DataFrame,
    status: DataFrame,
    vector: DataFrame,
    k: int = 10,
    weights: Sequence[float] | None = None,
    k1: int = RRF_K1,
) -> DataFrame:
    """Fuse structured and vector hits, or keep vector rows where the structured side failed.

    ``status(query_id, succeeded)`` decides per query; a query without status failed.
    """
    good = status.where("succeeded").select("query_id")
    fused = rrf(
        [
            ("structured", structured.join(good, "query_id", "left_semi")),
            ("vector", vector.join(good, "query_id", "left_semi")),
        ],
        k,
        weights,
        k1,
    )
    no_scores = F.create_map().cast("map<string,double>")
    kept = (
        vector.join(good, "query_id", "left_anti")
        .where(F.col("rank") <= k)
        .select(
            "query_id",
            "rank",
            "doc_id",
            "score",
            F.lit(FALLBACK).alias("search_type"),
            F.lit("vector").alias("source_retriever"),
            no_scores.alias("retriever_scores"),
        )
    )
    return fused.unionByName(kept)


def normalize_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    """External rows made rankable: score 1.0 by default, k per query in given order.

    Rows flagged ``no_results``, where there is such a column, say that nothing was found and
    are removed; rows without a ``result_index`` come after the others.
    """
    if "no_results" in candidates.columns:
        candidates = candidates.where(~F.coalesce("no_results", F.lit(False)))
    rows = candidates.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(1.0)))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("result_index"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
