"""Embedding and generation data flow around user-supplied functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import fill_template

# Texts per encode call, and the prompt around a retrieved context.
ENCODE_BATCH = 50
NO_CONTEXT_ERROR = "ERROR: no context"
CONTEXT_PROMPT = (
    "Use the following context to answer the question.\nQuery: {{query}}\nContext: {{context}}"
)


def missing_vectors(docs: DataFrame, column: str, stored: DataFrame | None = None) -> DataFrame:
    """Documents with text but without this vector (column null, or absent from a vector table)."""
    rows = docs.where(F.col("text").isNotNull())
    if stored is not None:
        return rows.join(stored.where(F.col(column).isNotNull()), "doc_id", "left_anti")
    return rows.where(F.col(column).isNull())


def embed(
    df: DataFrame,
    encode: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None,
    batch: int = ENCODE_BATCH,
    key: str = "doc_id",
    text: str = "text",
    load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]] | None = None,
) -> DataFrame:
    """(key, vector) by a user function called on fixed-size batches.

    ``load`` builds the function once per task, for models that are costly to open.
    """
    if (encode is None) == (load is None):
        raise ValueError("give either encode or load")
    schema = T.StructType(
        [df.schema[key], T.StructField("vector", T.ArrayType(T.FloatType()))]
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = load() if load else encode
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = [[float(x) for x in v] for v in run(list(part[text]))]
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": vectors})

    return df.select(key, text).mapInPandas(rows, schema)


def store_vectors(docs: DataFrame, vectors: DataFrame, column: str) -> DataFrame:
    """Documents with freshly computed vectors put in; stored vectors stay."""
    fresh = vectors.select("doc_id", F.col("vector").alias("_fresh"))
    return (
        docs.join(fresh, "doc_id", "left")
        .withColumn(column, F.coalesce(column, "_fresh"))
        .drop("_fresh")
    )


def context(ranked: DataFrame, key: str = "query_id", order: str = "rank", text: str = "text") -> DataFrame:
    """Non-empty texts of each query in rank order, joined by a blank line.

    The list per query is as long as its ranking (k rows).
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(ordered, lambda s: s[text]), "\n\n")
    rows = ranked.where(F.coalesce(text, F.lit("")) != "")
    return rows.groupBy(key).agg(joined.alias("context"))


def prompts(
    queries: DataFrame,
    contexts: DataFrame | None,
    system_prompt: Column,
    template: Column | None = None,
) -> DataFrame:
    """(query_id, system, user, error): zero-shot, or with context; no context is an error."""
    if contexts is None:
        return queries.select(
            "query_id",
            system_prompt.alias("system"),
            F.col("query").alias("user"),
            F.lit(None).cast("string").alias("error"),
        )
    wording = F.lit(CONTEXT_PROMPT) if template is None else template
    empty = F.coalesce("context", F.lit("")) == ""
    filled = fill_template(wording, F.col("query"), F.col("context"))
    return queries.join(contexts, "query_id", "left").select(
        "query_id",
        system_prompt.alias("system"),
        F.when(~empty, filled).alias("user"),
        F.when(empty, NO_CONTEXT_ERROR).alias("error"),
    )


def generate(prompt_rows: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """(query_id, response, status): the user function per prompt, its errors kept per row."""
    schema = T.StructType(
        [
            prompt_rows.schema["query_id"],
            T.StructField("response", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    )

    def one(system: str, user: str, error: str | None) -> tuple[str, str]:
        if error:
            return error, "failed"
        try:
            return answer(system, user), "success"
        except Exception as problem:
            return f"ERROR: {problem}", "failed"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            made = [
                one(*args) for args in zip(frame["system"], frame["user"], frame["error"], strict=True)
            ]
            yield pd.DataFrame(
                {
                    "query_id": frame["query_id"].to_numpy(),
                    "response": [m[0] for m in made],
                    "status": [m[1] for m in made],
                }
            )

    columns = prompt_rows.select("query_id", "system", "user", "error")
    return columns.mapInPandas(rows, schema)


def status_counts(generated: DataFrame) -> DataFrame:
    return generated.groupBy("status").agg(F.count("*").alias("n"))
