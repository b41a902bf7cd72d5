"""Cosine top-k over vector columns as blocked matrix products inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.ranking import SCORE_DIGITS, top_k

# Query vectors up to this size travel to every task; larger sets are blocked and shuffled.
BROADCAST_QUERY_BYTES = 64 * 1024 * 1024
DOCS_PER_BLOCK = 100_000
# Queries and documents whose scores exist at once: 32 MB.
TILE_QUERIES, TILE_DOCS = 512, 8192

# Vector column and dimension of each embedding provider.
PROVIDERS = {
    "hf": ("hf_embedding", 384),
    "openai": ("openai_embedding", 1536),
    "gemma": ("gemma_embedding", 768),
}


def provider_vectors(df: DataFrame, column: str, dimension: int) -> DataFrame:
    """Rows holding a vector, under the name ``vector``; one of another dimension fails the job."""
    found = F.size(column).cast("string")
    misfit = F.raise_error(F.concat(F.lit(f"vector of dimension {dimension} wanted, found "), found))
    checked = F.when(F.size(column) == dimension, F.col(column)).otherwise(misfit)
    held = df.where(F.col(column).isNotNull())
    return held.withColumn(column, checked).withColumnRenamed(column, "vector")


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def unit_matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(-1, dimension))


def best_pairs(
    query_ids: pa.Array, queries: np.ndarray, doc_ids: pa.Array, docs: np.ndarray, k: int
) -> pa.RecordBatch:
    """The k best rows of one block for every query, ids deciding ties.

    Scores exist for one tile of queries and documents at a time; k rows per query are carried
    from tile to tile, so memory does not grow with either side.
    """
    order_ids = doc_ids.to_numpy(zero_copy_only=False)
    rows, cols, values = [], [], []
    for first in range(0, len(queries), TILE_QUERIES):
        asked = queries[first : first + TILE_QUERIES]
        best_at = np.zeros((len(asked), 0), np.int64)
        best = np.zeros((len(asked), 0))
        for start in range(0, len(docs), TILE_DOCS):
            tile = np.round(asked @ docs[start : start + TILE_DOCS].T, SCORE_DIGITS)
            tile[~np.isfinite(tile)] = -np.inf
            at = np.broadcast_to(np.arange(start, start + tile.shape[1]), tile.shape)
            tile, at = np.concatenate([best, tile], axis=1), np.concatenate([best_at, at], axis=1)
            best, best_at = _cut(tile, at, order_ids, k)
        rows.append(np.repeat(np.arange(first, first + len(asked)), best.shape[1]))
        cols.append(best_at.ravel())
        values.append(best.ravel())
    row, col, score = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, rows), (np.int64, cols), (float, values)))
    good = np.isfinite(score)
    return pa.RecordBatch.from_arrays(
        [query_ids.take(pa.array(row[good])), doc_ids.take(pa.array(col[good])), pa.array(score[good])],
        names=["query_id", "doc_id", "score"],
    )


def _cut(scores: np.ndarray, at: np.ndarray, order_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every line, by score and then by id."""
    if scores.shape[1] <= k:
        return scores, at
    bars = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    line, col = np.nonzero(scores >= bars[:, None])
    order = np.lexsort((order_ids[at[line, col]], -scores[line, col], line))
    line, col = line[order], col[order]
    place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(scores)))[line]
    line, col = line[place < k], col[place < k]
    shape = (len(scores), k)
    return scores[line, col].reshape(shape), at[line, col].reshape(shape)


def _schema(queries: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def vector_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 10,
    dimension: int = 384,
    broadcast_bytes: int = BROADCAST_QUERY_BYTES,
) -> DataFrame:
    """Cosine top-k: ``queries(query_id, vector)`` against ``docs(doc_id, vector)``.

    Documents are never shuffled while the query block fits its size bound: every task
    keeps k rows per query and Arrow batch, and only those meet in the final ranking.
    The approximate search is :mod:`quillgraph.operators.ivf`.
    """
    queries = provider_vectors(queries, "vector", dimension).select("query_id", "vector")
    docs = provider_vectors(docs, "vector", dimension).select("doc_id", "vector")
    n_queries = queries.count()
    if n_queries * dimension * 8 <= broadcast_bytes:
        near = _scan(queries, docs, k, dimension)
    else:
        near = _blocked(queries, docs, k, dimension, n_queries, broadcast_bytes)
    return top_k(near, k).select("query_id", "rank", "doc_id", "score")


def _scan(queries: DataFrame, docs: DataFrame, k: int, dimension: int) -> DataFrame:
    block = queries.toArrow().combine_chunks()
    ids = block.column("query_id").combine_chunks()
    vectors = block.column("vector").combine_chunks()
    shared = queries.sparkSession.sparkContext.broadcast((ids, unit_matrix(vectors, dimension)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        for batch in batches:
            if batch.num_rows and len(query_ids):
                found = unit_matrix(batch.column("vector"), dimension)
                yield best_pairs(query_ids, query_matrix, batch.column("doc_id"), found, k)

    return docs.mapInArrow(best, _schema(queries, docs))


def _blocked(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    dimension: int,
    n_queries: int,
    block_bytes: int,
) -> DataFrame:
    """Query blocks meet document blocks as cogroups; both sides are bounded by construction."""
    n_query_blocks = -(-n_queries * dimension * 8 // block_bytes)
    n_doc_blocks = max(1, -(-docs.count() // DOCS_PER_BLOCK))
    every_query_block = F.sequence(F.lit(0), F.lit(n_query_blocks - 1))
    every_doc_block = F.sequence(F.lit(0), F.lit(n_doc_blocks - 1))
    left = docs.select(
        "doc_id",
        "vector",
        F.pmod(F.xxhash64("doc_id"), F.lit(n_doc_blocks)).cast("int").alias("doc_block"),
        F.explode(every_query_block).alias("query_block"),
    )
    right = queries.select(
        "query_id",
        "vector",
        F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks)).cast("int").alias("query_block"),
        F.explode(every_doc_block).alias("doc_block"),
    )

    def best(doc_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not doc_rows.num_rows or not query_rows.num_rows:
            empty = [query_rows["query_id"].type, doc_rows["doc_id"].type, pa.float64()]
            return pa.schema(list(zip(names, empty, strict=True))).empty_table()
        found = unit_matrix(doc_rows["vector"].combine_chunks(), dimension)
        asked = unit_matrix(query_rows["vector"].combine_chunks(), dimension)
        batch = best_pairs(
            query_rows["query_id"].combine_chunks(),
            asked,
            doc_rows["doc_id"].combine_chunks(),
            found,
            k,
        )
        return pa.Table.from_batches([batch])

    keys = ["query_block", "doc_block"]
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(best, _schema(queries, docs))
    )


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits an approximate ranking returned, per query."""
    found = approximate.select("query_id", "doc_id", F.lit(1).alias("found"))
    return (
        exact.join(found, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg((F.count("found") / F.count("*")).alias("recall"))
    )
