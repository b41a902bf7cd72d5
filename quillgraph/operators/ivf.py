"""Inverted-file vector index: cells around coarse centroids, searched only where a query probes.

Vectors are scaled to unit length and to whole numbers, so cells do not depend on how rows lie in
tasks. Coarse centroids come from k-means over a bounded sample (:data:`SAMPLE_ROWS`, by digest of
the id); every row is indexed, in files laid out by cell. A search gives each query its nearest
cells, reads only cells that some query probes, and multiplies a query only with rows of its own
cells, in blocks of bounded size on both sides.

How many cells to probe is measured: :meth:`IvfIndex.probes_for` takes exact neighbours of a query
set and returns the smallest number of cells that holds the wanted share of them.

Rows without a vector are left out; one of another dimension fails the job; a zero vector has
cosine zero with everything; an empty table gives an index without rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.ranking import SCORE_DIGITS, top_k
from quillgraph.operators.vector import best_pairs, provider_vectors, unit_matrix

#: Most rows that shape the centroids, most cells, whole-number scale of a unit component.
SAMPLE_ROWS, MOST_CELLS, SCALE = 1 << 16, 1 << 12, 1 << 15
#: Most documents and queries that meet in one task.
BLOCK_ROWS = 1 << 16
#: Vectors compared with all centroids at once.
_TOGETHER = 1 << 11


def whole_units(column: pa.Array, dimension: int) -> np.ndarray:
    return np.floor(unit_matrix(column, dimension) * SCALE)


def _nearest(rows: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the nearest centroids, nearest first; ties to the smaller number.

    Whole numbers below 2**53 in double precision: every distance is exact.
    """
    found = np.zeros((len(rows), count), np.int32)
    size = (centroids**2).sum(1)
    for start in range(0, len(rows), _TOGETHER):
        part = rows[start : start + _TOGETHER]
        found[start : start + _TOGETHER] = np.argsort(size - 2 * (part @ centroids.T), axis=1, kind="stable")[:, :count]
    return found


@dataclass
class IvfIndex:
    """``centroids``: one row per cell; ``sizes``: its documents; ``rows(cell, doc_id, vector)``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    dimension: int

    @property
    def rows(self) -> DataFrame:
        # A table without rows leaves no file that knows the columns.
        shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(shape).parquet(f"{self.path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        centroids = np.array([r["centroid"] for r in cells], float)
        return IvfIndex(spark, path, centroids, np.array([r["n"] for r in cells]), centroids.shape[1])

    def cell_order(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, vector, cell, place``: the nearest cells of every query, nearest first."""
        queries = provider_vectors(queries, "vector", self.dimension).select("query_id", "vector")
        centroids, dimension, count = self.centroids, self.dimension, min(probes, len(self.centroids))

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _nearest(whole_units(batch.column("vector"), dimension), centroids, count)
                at = pa.array(np.repeat(np.arange(batch.num_rows), count))
                place = np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel()), pa.array(place)],
                    names=["query_id", "vector", "cell", "place"],
                )

        schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("place", T.IntegerType())])
        return queries.mapInArrow(order, schema)

    def multiplied(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, n_multiplied``: documents whose cosine a search computes for each query."""
        sizes = self._sizes().select("cell", "n")
        asked = self.cell_order(queries, probes).join(F.broadcast(sizes), "cell")
        return asked.groupBy("query_id").agg(F.sum("n").alias("n_multiplied"))

    def _sizes(self) -> DataFrame:
        """``cell, n, blocks``: at most :data:`MOST_CELLS` rows."""
        rows = [(k, int(n), max(1, -(-int(n) // BLOCK_ROWS))) for k, n in enumerate(self.sizes)]
        return self.spark.createDataFrame(rows, "cell int, n long, blocks int")

    def probes_for(self, queries: DataFrame, exact: DataFrame, target: float = 0.95) -> int:
        """The smallest number of probed cells that holds ``target`` of the exact neighbours.

        ``exact(query_id, doc_id)``.
        """
        home = self.rows.select("doc_id", "cell")
        wanted = exact.select("query_id", "doc_id").join(home, "doc_id")
        places = self.cell_order(queries, len(self.centroids)).select("query_id", "cell", "place")
        held = wanted.join(places, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()
        total, seen = sum(r["count"] for r in held), 0
        for row in held:
            seen += row["count"]
            if seen >= target * total:
                return row["place"]
        return len(self.centroids)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """Cosine top-k among the rows of the probed cells: ``query_id, rank, doc_id, score``."""
        asked = self.cell_order(queries, probes)
        # At most MOST_CELLS numbers: the files of all other cells are not opened.
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
        rows = self.rows.where(F.col("cell").isin(cells) if cells else F.lit(False))
        parts = max(1, -(-queries.count() // BLOCK_ROWS))
        sizes = F.broadcast(self._sizes().select("cell", "blocks"))
        docs = rows.join(sizes, "cell").select(
            "cell",
            F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
            "doc_id",
            F.col("vector").alias("doc_vector"),
        )
        wanted = asked.join(sizes, "cell").select(
            "cell",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"),
            "query_id",
            "vector",
        )
        dimension = self.dimension
        schema = T.StructType([queries.schema["query_id"], rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

        def best(found: pa.Table, wanted: pa.Table) -> pa.Table:
            pairs = best_pairs(
                wanted["query_id"].combine_chunks(),
                unit_matrix(wanted["vector"].combine_chunks(), dimension),
                found["doc_id"].combine_chunks(),
                unit_matrix(found["doc_vector"].combine_chunks(), dimension),
                k,
            )
            return pa.Table.from_batches([pairs])

        keys = ["cell", "block", "part"]
        near = docs.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(best, schema)
        return top_k(near, k).select("query_id", "rank", "doc_id", "score")


def sample_step(n: int) -> int:
    """Every how many-th row (by digest of its id) shapes the centroids."""
    return max(1, -(-n // SAMPLE_ROWS))


def cell_count(n: int) -> int:
    return max(1, min(MOST_CELLS, math.isqrt(n)))


def build_ivf(docs: DataFrame, path: str, dimension: int, rounds: int = 5) -> IvfIndex:
    """Index of ``docs(doc_id, vector)``, written to ``path``."""
    spark = docs.sparkSession
    docs = provider_vectors(docs, "vector", dimension).select("doc_id", "vector")
    n = docs.count()
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    whole = T.StructType([docs.schema["doc_id"], T.StructField("ints", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = whole_units(batch.column(1), dimension)
            ends = pa.array(np.arange(len(ints) + 1, dtype=np.int32) * dimension)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ints.ravel()))], names=["doc_id", "ints"]
            )

    sample = docs.where(number % sample_step(n) == 0).mapInArrow(measure, whole)
    sample.write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    first = sample.select(digest.alias("digest"), "ints").orderBy("digest", "ints").limit(cell_count(n)).collect()
    centroids = np.array([r["ints"] for r in first], float).reshape(-1, dimension)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(sample, centroids, dimension)

    indexed = T.StructType([T.StructField("cell", T.IntegerType()), *docs.schema.fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(whole_units(batch.column(1), dimension), centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "doc_id", "vector"])

    # Ranges of (cell, id): a large cell spreads over tasks, a task writes few cells.
    spark.createDataFrame([], indexed).write.mode("overwrite").parquet(f"{path}/shape")
    docs.mapInArrow(place, indexed).repartitionByRange("cell", "doc_id").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
    counts = {r["cell"]: r["count"] for r in spark.read.schema(indexed).parquet(f"{path}/rows").groupBy("cell").count().collect()}
    cells = [(k, counts.get(k, 0), c.tolist()) for k, c in enumerate(centroids)]
    spark.createDataFrame(cells, "cell int, n long, centroid array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    return IvfIndex(spark, path, centroids, np.array([c[1] for c in cells]), dimension)


def _moved(sample: DataFrame, centroids: np.ndarray, dimension: int) -> np.ndarray:
    """One round of k-means: floors of the means of the rows of each cell; an empty cell stays."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ints = batch.column("ints").flatten().to_numpy().reshape(-1, dimension)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nearest(ints, centroids, 1)[:, 0]), batch.column("ints")], names=["cell", "ints"]
                )

    def mean(rows: pa.Table) -> pa.Table:
        ints = rows["ints"].combine_chunks().flatten().to_numpy().reshape(-1, dimension)
        return pa.table({"cell": rows["cell"][:1], "centroid": [np.floor(ints.sum(0) / len(ints)).tolist()]})

    found = sample.mapInArrow(assign, "cell int, ints array<double>").groupBy("cell").applyInArrow(mean, "cell int, centroid array<double>")
    moved = centroids.copy()
    for row in found.collect():
        moved[row["cell"]] = row["centroid"]
    return moved


def recall(index: IvfIndex, queries: DataFrame, exact: DataFrame, k: int, probes: int) -> DataFrame:
    """``query_id, recall, n_multiplied``: share of the exact neighbours found, and the work done."""
    found = index.search(queries, k, probes).select("query_id", "doc_id", F.lit(1).alias("found"))
    shares = exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.round(F.count("found") / F.count("*"), SCORE_DIGITS).alias("recall")
    )
    return shares.join(index.multiplied(queries, probes), "query_id")
