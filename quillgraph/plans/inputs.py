"""Views of the test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.substring import contains_pairs
from quillgraph.session import written
from quillgraph.sources.tables import spread, table

DIMENSION = 64
URL = "https://docs.example.org/"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each query's vector is the stored one of the same id."""
    rows = table(spark, d, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked.join(queries(spark, d).select("query_id"), "query_id", "left_semi")


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id) of documents that hold the whole query passage."""
    texts = documents(spark, d).select(F.col("doc_id").alias("text_id"), "text")
    needles = queries(spark, d).select(
        F.col("query_id").alias("needle_id"), F.col("query").alias("needle")
    )
    found = contains_pairs(texts, needles).select(
        F.col("needle_id").alias("query_id"), F.col("text_id").alias("doc_id")
    )
    # Few pairs from a pass over all texts, read more than once.
    return written(found, "truth")


def doc_url(column: str = "doc_id"):
    return F.concat(F.lit(URL), F.col(column).cast("string"))


def references(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select("query_id", doc_url().alias("reference"))
