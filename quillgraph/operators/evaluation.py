"""Relevance annotation and retrieval metrics over whole runs.

``ranked`` tables hold (query_id, rank, ...); annotations address a row by
``chunk_index = rank - 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import urls_match
from quillgraph.operators.numbering import numbered

# Cut-offs of the per-query metrics.
CUTOFFS = (1, 3, 5, 10)


def ground_truth(queries: DataFrame) -> DataFrame:
    """(query_id, reference) per expected document of each query."""
    return queries.select("query_id", F.explode("doc_references").alias("reference"))


def auto_annotate(
    ranked: DataFrame, truth: DataFrame, existing: DataFrame | None = None, exact: bool = False
) -> DataFrame:
    """Positive annotations for retrieved rows whose address matches an expected one.

    Rows already annotated are left alone; nothing is written for rows that do not match.
    """
    rows = ranked.select("query_id", (F.col("rank") - 1).alias("chunk_index"), "source_url")
    if existing is not None:
        rows = rows.join(
            existing.select("query_id", "chunk_index"), ["query_id", "chunk_index"], "left_anti"
        )
    return (
        rows.join(truth, "query_id")
        .where(urls_match(F.col("source_url"), F.col("reference"), exact))
        .select(
            "query_id",
            "chunk_index",
            F.lit(True).alias("is_relevant"),
            F.lit(True).alias("auto_populated"),
        )
        .distinct()
    )


def annotation_counts(
    ranked: DataFrame, truth: DataFrame, added: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """One row: total_checked, auto_annotated, skipped_existing, queries_processed."""
    asked = truth.select("query_id").distinct()
    rows = ranked.join(asked, "query_id", "left_semi").select(
        "query_id", (F.col("rank") - 1).alias("chunk_index")
    )
    flags = added.select("query_id", "chunk_index", F.lit(1).alias("added"))
    rows = rows.join(flags, ["query_id", "chunk_index"], "left")
    if existing is None:
        rows = rows.withColumn("known", F.lit(None).cast("int"))
    else:
        known = existing.select("query_id", "chunk_index", F.lit(1).alias("known")).distinct()
        rows = rows.join(known, ["query_id", "chunk_index"], "left")
    return rows.agg(
        F.count("*").alias("total_checked"),
        F.count("added").alias("auto_annotated"),
        F.count("known").alias("skipped_existing"),
        F.countDistinct("query_id").alias("queries_processed"),
    )


def upsert_annotations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New flags overwrite per (query, chunk); other stored fields survive; last flag wins.

    ``incoming(query_id, chunk_index, is_relevant, seq)``.
    """
    latest = incoming.groupBy("query_id", "chunk_index").agg(
        F.max_by("is_relevant", "seq").alias("new_flag")
    )
    others = [
        c for c in existing.columns if c not in ("query_id", "chunk_index", "is_relevant")
    ]
    return existing.join(latest, ["query_id", "chunk_index"], "full_outer").select(
        "query_id",
        "chunk_index",
        F.coalesce("new_flag", "is_relevant").alias("is_relevant"),
        *others,
    )


def add_reference(queries: DataFrame, additions: DataFrame) -> DataFrame:
    """Append each (query_id, reference) that the query does not list yet."""
    extra = additions.groupBy("query_id").agg(
        F.array_sort(F.collect_set("reference")).alias("extra")
    )
    empty = F.array().cast("array<string>")
    merged = F.array_union(
        F.coalesce("doc_references", empty), F.coalesce("extra", empty)
    )
    return (
        queries.join(extra, "query_id", "left").withColumn("doc_references", merged).drop("extra")
    )


def _marked(ranked: DataFrame, annotations: DataFrame) -> DataFrame:
    flags = annotations.groupBy("query_id", "chunk_index").agg(
        F.max(F.col("is_relevant").cast("int")).alias("relevant")
    )
    return (
        ranked.select("query_id", "rank", (F.col("rank") - 1).alias("chunk_index"))
        .join(flags, ["query_id", "chunk_index"], "left")
        .withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    )


def hit_at(k: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("relevant"))), F.lit(0))


def precision_at(k: int) -> Column:
    """Relevant rows in the first k over k (not over the number returned)."""
    if k == 0:
        return F.lit(0.0)
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("relevant"))), F.lit(0)) / k


def recall_at(k: int) -> Column:
    """Relevant rows in the first k over the relevant rows among all retrieved."""
    found = F.sum(F.when(F.col("rank") <= k, F.col("relevant")))
    return F.coalesce(F.try_divide(found, F.sum("relevant")), F.lit(0.0))


def reciprocal_rank() -> Column:
    """One over the first relevant rank in the whole list."""
    return F.coalesce(1.0 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0))


def per_query_metrics(
    queries: DataFrame,
    ranked: DataFrame,
    annotations: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
    truth: DataFrame | None = None,
) -> DataFrame:
    """One row per query; queries without annotation score zero and are flagged.

    ``truth(query_id, reference)`` switches the recall denominator to the expected documents.
    """
    measures: list[Column] = []
    for k in cutoffs:
        measures += [
            hit_at(k).alias(f"hit_at_{k}"),
            precision_at(k).alias(f"precision_at_{k}"),
            recall_at(k).alias(f"recall_at_{k}"),
        ]
    measured = (
        _marked(ranked, annotations)
        .groupBy("query_id")
        .agg(*measures, reciprocal_rank().alias("mrr"), F.sum("relevant").alias("n_relevant"))
    )
    annotated = annotations.select("query_id", F.lit(True).alias("annotated")).distinct()
    out = (
        queries.select("query_id")
        .join(measured, "query_id", "left")
        .join(annotated, "query_id", "left")
        .na.fill(0)
    )
    if truth is not None:
        expected = truth.groupBy("query_id").agg(F.countDistinct("reference").alias("expected"))
        out = out.join(expected, "query_id", "left")
        for k in cutoffs:
            share = F.try_divide(F.col(f"precision_at_{k}") * k, F.col("expected"))
            out = out.withColumn(f"recall_at_{k}", F.coalesce(share, F.lit(0.0)))
        out = out.drop("expected")
    return out.withColumn("annotated", F.coalesce("annotated", F.lit(False))).drop("n_relevant")


def macro_average(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``avg_<metric>`` over all queries, plus how many were annotated."""
    names = [c for c in metrics.columns if c not in ("query_id", "annotated", *by)]
    return metrics.groupBy(*by).agg(
        F.count("*").alias("total_queries"),
        F.sum(F.col("annotated").cast("int")).alias("queries_with_annotation"),
        F.sum((~F.col("annotated")).cast("int")).alias("unannotated_queries"),
        *[F.avg(c).alias(f"avg_{c}") for c in names],
    )


def view_summary(ranked: DataFrame, annotations: DataFrame, truth: DataFrame) -> DataFrame:
    """Annotation-view figures: precision over returned rows, recall over expected documents."""
    expected = truth.groupBy("query_id").agg(F.count("*").alias("expected"))
    return (
        _marked(ranked, annotations)
        .groupBy("query_id")
        .agg(
            F.count("*").alias("total_chunks"),
            F.sum("relevant").alias("relevant"),
            *[hit_at(k).alias(f"hit_at_{k}") for k in CUTOFFS],
            reciprocal_rank().alias("mrr"),
        )
        .join(expected, "query_id", "left")
        .select(
            "query_id",
            "total_chunks",
            "relevant",
            (F.col("relevant") / F.col("total_chunks")).alias("precision"),
            F.try_divide("relevant", "expected").alias("recall"),
            *[f"hit_at_{k}" for k in CUTOFFS],
            "mrr",
        )
    )


def query_stats(results: DataFrame) -> DataFrame:
    """total / successful / failed queries by status."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )


def validation_summary(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """(validation, n) over all items: stored flag or ``unvalidated``."""
    flags = annotations.select("item_id", "validation")
    return (
        items.select("item_id")
        .join(flags, "item_id", "left")
        .groupBy(F.coalesce("validation", F.lit("unvalidated")).alias("validation"))
        .agg(F.count("*").alias("n"))
    )


def open_codes(annotations: DataFrame) -> DataFrame:
    """Distinct non-blank codes, numbered in order."""
    codes = annotations.select(F.trim("code").alias("code")).where(F.col("code") != "").distinct()
    return numbered(codes, ["code"], "number")
