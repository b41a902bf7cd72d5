"""Experiment tables, comparison reports and experiment bookkeeping.

An experiment is keyed by (run, retriever, experiment_id). Reports pivot on experiments,
whose number is small by nature; queries stay rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import STOP_WORDS, display_without_stop_words, padded_id

# Metrics shown in the comparison report, with their labels.
REPORT_METRICS = [
    ("avg_hit_at_1", "Hit@1"),
    ("avg_hit_at_3", "Hit@3"),
    ("avg_hit_at_5", "Hit@5"),
    ("avg_hit_at_10", "Hit@10"),
    ("avg_mrr", "MRR"),
    ("avg_precision_at_1", "Precision@1"),
    ("avg_recall_at_10", "Recall@10"),
]

# Retrievers whose label shows stop-word flags, and kinds that are not repeatable.
STOP_WORD_LABELLED = ["bm25", "fulltext", "fulltext_vector_hf", "fulltext_vector_gemma"]
NOT_DETERMINISTIC = ["text2cypher", "text2cypher_vector"]


def metric_rows(averages: DataFrame, key: str = "experiment") -> DataFrame:
    """Long form (experiment, metric, value); a metric an experiment lacks counts 0.0."""
    present = [
        (F.col(c) if c in averages.columns else F.lit(None)).cast("double").alias(label)
        for c, label in REPORT_METRICS
    ]
    wide = averages.select(key, *present)
    labels = [label for _, label in REPORT_METRICS]
    return (
        wide.unpivot([key], labels, "metric", "value")
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .withColumnRenamed(key, "experiment")
    )


def best_marked(rows: DataFrame) -> DataFrame:
    """Three-decimal cells; the best of a metric is marked unless all experiments tie."""
    per_metric = rows.groupBy("metric").agg(F.max("value").alias("top"), F.min("value").alias("low"))
    text = F.format_string("%.3f", "value")
    best = (F.col("value") == F.col("top")) & (F.col("top") != F.col("low"))
    return rows.join(per_metric, "metric").select(
        "metric",
        "experiment",
        F.when(best, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text).alias("cell"),
    )


def compare(averages: DataFrame, experiments: Sequence[str], key: str = "experiment") -> DataFrame:
    """Metrics as rows, the named experiments as columns."""
    cells = best_marked(metric_rows(averages, key).where(F.col("experiment").isin(*experiments)))
    return cells.groupBy("metric").pivot("experiment", list(experiments)).agg(F.first("cell"))


def relevant_found(per_query: DataFrame, key: str = "experiment") -> DataFrame:
    """``n/total`` queries with a relevant row in the first ten."""
    found = F.count_if(F.col("hit_at_10") > 0)
    return per_query.groupBy(F.col(key).alias("experiment")).agg(
        F.concat_ws("/", found, F.count("*")).alias("found")
    )


def missed_queries(
    per_query: DataFrame,
    queries: DataFrame,
    experiments: Sequence[str],
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Queries at least one experiment missed; an experiment without the query missed it too."""
    wide = (
        per_query.where(F.col("experiment").isin(*experiments))
        .groupBy("query_id")
        .pivot("experiment", list(experiments))
        .agg(F.max("hit_at_10"))
        .na.fill(0, list(experiments))
    )
    missed = F.lit(False)
    for name in experiments:
        missed = missed | (F.col(f"`{name}`") == 0)
    cells = [
        F.when(F.col(f"`{n}`") > 0, "hit").otherwise("**MISS**").alias(n) for n in experiments
    ]
    return (
        wide.where(missed)
        .join(queries.select("query_id", "query"), "query_id")
        .select(
            "query_id",
            "query",
            display_without_stop_words(F.col("query"), stop_words).alias("without_stop_words"),
            *cells,
        )
        .orderBy("query_id")
    )


def experiment_label(
    retriever: Column,
    experiment_id: Column,
    sw_query: Column,
    sw_docs: Column,
    legacy: Column,
    prompt_version: Column,
) -> Column:
    """Readable experiment name with its stop-word or prompt flags."""
    tag = F.concat(
        F.when(F.coalesce(sw_query, F.lit(False)), "Q").otherwise(""),
        F.when(F.coalesce(sw_docs, F.lit(False)), "D").otherwise(""),
    )
    flags = (
        F.when(
            sw_query.isNotNull() | sw_docs.isNotNull(),
            F.when(tag != "", F.concat(F.lit(" +sw("), tag, F.lit(")"))).otherwise(" -sw"),
        )
        .when(legacy, " +sw")
        .when(~legacy, " -sw")
        .otherwise("")
    )
    version = F.when(
        retriever.contains("text2cypher") & (F.coalesce(prompt_version, F.lit("")) != ""),
        F.concat(F.lit(" "), prompt_version),
    ).otherwise("")
    suffix = F.when(retriever.isin(*STOP_WORD_LABELLED), flags).otherwise(version)
    return F.concat(retriever, suffix, F.lit(" ("), experiment_id, F.lit(")"))


def resolve_listed(listed: DataFrame, experiments: DataFrame) -> DataFrame:
    """Listed experiments that exist, repeated ones once at their first place.

    ``listed(position, retriever, experiment_id)``.
    """
    keys = ["retriever", "experiment_id"]
    first = listed.groupBy(*keys).agg(F.min("position").alias("position"))
    return first.join(experiments, keys, "left_semi")


def search_experiments(
    experiments: DataFrame,
    kind: str | None = None,
    retriever: str | None = None,
    chunking: str | None = None,
    run: int | None = None,
) -> DataFrame:
    """Filtered experiments, newest first; an experiment without retriever is a generation."""
    out = experiments.withColumn(
        "kind", F.when(F.col("retriever").isNull(), "generation").otherwise("retrieval")
    )
    for name, value in (
        ("kind", kind),
        ("retriever", retriever),
        ("chunking", chunking),
        ("run", run),
    ):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc_nulls_last("created_at"))


def distinct_retrievers(experiments: DataFrame) -> DataFrame:
    return (
        experiments.select("retriever")
        .where(F.coalesce("retriever", F.lit("")) != "")
        .distinct()
        .orderBy("retriever")
    )


def distinct_embedders(experiments: DataFrame) -> DataFrame:
    """Recorded embedders and those named by a ``vector_<embedder>`` retriever."""
    named = experiments.where(F.col("retriever").startswith("vector_")).select(
        F.replace(F.col("retriever"), F.lit("vector_"), F.lit("")).alias("embedder")
    )
    stored = experiments.select("embedder").where(F.coalesce("embedder", F.lit("")) != "")
    return stored.unionByName(named).distinct().orderBy("embedder")


def next_experiment_id(experiments: DataFrame, by: Sequence[str] = ("run", "retriever")) -> DataFrame:
    """Highest numeric id plus one, zero-padded; names that are no number are ignored."""
    number = F.col("experiment_id").try_cast("int")
    return experiments.groupBy(*by).agg(
        padded_id(F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id")
    )


def latest_experiment(experiments: DataFrame) -> DataFrame:
    """Alphabetically last experiment of every retriever of a run."""
    return experiments.groupBy("run", "retriever").agg(
        F.max("experiment_id").alias("experiment_id")
    )


def pending_plan(plan: DataFrame, experiments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned experiments without those already run; non-repeatable kinds always run again."""
    done = experiments.select(*keys).where(~F.col("retriever").isin(*NOT_DETERMINISTIC)).distinct()
    matching = F.lit(True)
    for key in keys:
        matching = matching & plan[key].eqNullSafe(done[key])
    return plan.join(done, matching, "left_anti")


def experiment_view(
    results: DataFrame, experiments: DataFrame, executions: DataFrame | None = None
) -> DataFrame:
    """Result rows with the view their experiment is shown in and the execution status.

    ``executions(experiment, query_id, status, error)`` of generated graph queries; only rows of
    the structured view have a status, success where nothing was recorded.
    """
    view = (
        F.when(F.col("experiment_type") == "generation", "generation")
        .when(F.col("retriever_type") == "text2cypher", "structured")
        .otherwise("retrieval")
    )
    shown = experiments.select("experiment", view.alias("view"))
    out = results.join(shown, "experiment", "left").withColumn(
        "view", F.coalesce("view", F.lit("retrieval"))
    )
    if executions is None:
        return out
    keys = ["experiment", "query_id"]
    said = executions.select(*keys, F.col("status").alias("_status"), F.col("error").alias("_error"))
    structured = F.col("view") == "structured"
    return (
        out.join(said, keys, "left")
        .withColumn("execution_status", F.when(structured, F.coalesce("_status", F.lit("success"))))
        .withColumn("execution_error", F.when(structured, F.col("_error")))
        .drop("_status", "_error")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
