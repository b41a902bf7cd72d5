"""Readers and writers of query sets, page trees, sitemaps, results and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import page_file_name

QUERY_COLUMNS = "query_id string, query string, ground_truth string, doc_reference string"
QUERY_SET_VERSION = "1.0"


def split_refs(references: Column) -> Column:
    """Comma-separated addresses to a list of trimmed non-empty ones."""
    parts = F.transform(F.split(F.coalesce(references, F.lit("")), ","), lambda r: F.trim(r))
    return F.filter(parts, lambda r: r != "")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query CSV (quoted fields may hold commas and newlines) with typed, trimmed columns."""
    raw = (
        spark.read.schema(QUERY_COLUMNS)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    blank = F.lit("")
    return raw.select(
        F.trim("query_id").try_cast("int").alias("query_id"),
        F.trim(F.coalesce("query", blank)).alias("query"),
        F.trim(F.coalesce("ground_truth", blank)).alias("ground_truth"),
        split_refs(F.col("doc_reference")).alias("doc_references"),
    )


def query_set_metadata(queries: DataFrame, source: str) -> DataFrame:
    return queries.agg(
        F.lit(source).alias("source"),
        F.count("*").alias("total_queries"),
        F.lit(QUERY_SET_VERSION).alias("version"),
    )


def write_queries_json(queries: DataFrame, path: str, source: str) -> None:
    """Queries as JSON lines next to a one-row metadata file."""
    queries.write.mode("overwrite").json(f"{path}/queries")
    query_set_metadata(queries, source).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_queries_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "query_id int, query string, ground_truth string, doc_references array<string>"
    return spark.read.schema(schema).json(f"{path}/queries")


def read_html_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of every ``*.html`` file below a folder."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html")
        .text(path)
        .select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, last_updated) of a sitemap; entries without address are dropped."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string")
    return sitemap_rows(rows.load(path))


def sitemap_rows(entries: DataFrame) -> DataFrame:
    return entries.where(F.coalesce(F.trim("loc"), F.lit("")) != "").select(
        F.trim("loc").alias("url"), F.coalesce(F.trim("lastmod"), F.lit("")).alias("last_updated")
    )


def sitemap_urls(sitemap: DataFrame) -> DataFrame:
    return sitemap.select("url")


def page_addresses(entities: DataFrame) -> DataFrame:
    """(file_name, url) of entities that have an address."""
    return (
        entities.where(F.col("url").isNotNull() & (F.col("url") != ""))
        .select(page_file_name(F.col("name")).alias("file_name"), "url")
        .distinct()
    )


def pages_to_fetch(entities: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages of entities with an address that the cache(file_name) does not hold yet."""
    return page_addresses(entities).join(cache.select("file_name"), "file_name", "left_anti")


RESULT_KEYS = ["run", "retriever", "experiment_id"]


def write_results(ranked: DataFrame, path: str, component: bool = False) -> None:
    """Long ranking rows partitioned by run, retriever and experiment (and component).

    An experiment that is written again replaces its rows; all others stay.
    """
    keys = [*RESULT_KEYS, "component"] if component else RESULT_KEYS
    writer = ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)


def read_results(
    spark: SparkSession, path: str, run: str | None = None, retriever: str | None = None
) -> DataFrame:
    """Stored rankings; run and retriever prune partitions."""
    rows = spark.read.option("basePath", path).parquet(path)
    if run is not None:
        rows = rows.where(F.col("run") == run)
    if retriever is not None:
        rows = rows.where(F.col("retriever") == retriever)
    return rows


def write_results_json(results: DataFrame, path: str) -> None:
    """Nested results (one line per query with its chunks)."""
    results.write.mode("overwrite").json(path)


def unnest_results(results: DataFrame) -> DataFrame:
    """Nested results back to ranking rows."""
    return results.select("query_id", F.explode("retrieved_chunks").alias("c")).select(
        "query_id", "c.*"
    )


def discover(configs: DataFrame, metrics: DataFrame, run: str | None = None) -> DataFrame:
    """Experiments that have both a configuration and metrics."""
    found = configs.join(metrics.select(*RESULT_KEYS).distinct(), RESULT_KEYS, "left_semi")
    return found if run is None else found.where(F.col("run") == run)


def read_experiments(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """Experiments below a root with ``configs`` and ``metrics`` partitioned tables."""
    configs = spark.read.parquet(f"{root}/configs")
    metrics = spark.read.parquet(f"{root}/metrics")
    return discover(configs, metrics, run)
