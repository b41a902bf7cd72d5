"""Exact integer k-means with PCA-rotated filtering of centroids.

Vectors are turned into integers once. One pass adds up their second moments; the eigenvectors of
the covariance (one small matrix) rotate the vectors, and every row keeps, besides its integers,
the leading rotated coordinates and the norm of what is left. In a round, the squared distance of
the leading coordinates plus the squared difference of the residual norms is never more than the
squared distance to a centroid, so only centroids whose bound does not exceed the distance to the
most promising one are verified, in 64-bit integers. Results do not depend on the rotation.

A round is one pass of Arrow tasks over the stored rows that sends one row per task and centroid;
sums of integers are added by Spark with map-side combining. The driver holds the centroids only.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component
are left out, and so are components beyond 131,072 in size, whose distances may not fit a long;
repeated rows count as often as they occur; of rows with one id as starting centroid the smaller
components come first; a null id takes part, and starts a centroid only where ids run out; fewer
rows than centroids give one centroid per row; an empty centroid stays where it is; an empty table
gives no rows; a sum beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import discard, stored

#: Largest component in size that keeps every squared distance of 64 components inside a long.
LARGEST = 1 << 17
#: Relative slack of a bound in double precision; rounding errors are far below it.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, width: int) -> DataFrame:
    """``vec_id, ints`` of the usable vectors: ``floor(scale * x)`` of every component as double."""
    values = F.col(vector_col).cast("array<double>")
    usable = (F.size(values) == width) & F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    )
    ints = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("ints"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


@dataclass
class Rotation:
    mean: np.ndarray
    axes: np.ndarray
    kept: int

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates and the norm of the others."""
        turned = (rows - self.mean) @ self.axes
        return turned[:, : self.kept], np.linalg.norm(turned[:, self.kept :], axis=1)


def fit_rotation(ints: DataFrame, width: int, kept: int) -> Rotation:
    """Eigenvectors of the covariance of all rows, by falling eigenvalue."""
    names = [f"c{k}" for k in range(width + 1)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            rows = np.ones((batch.num_rows, width + 1))
            rows[:, :width] = _rows(batch.column(0), width)
            total += rows.T @ rows
        if total[width, width]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width + 1)), *(pa.array(c) for c in total.T)], names=["line", *names]
            )

    schema = "line long, " + ", ".join(f"{name} double" for name in names)
    lines = ints.select("ints").mapInArrow(moments, schema).groupBy("line").agg(*_sums(names)).orderBy("line").collect()
    if not lines:
        return Rotation(np.zeros(width), np.eye(width), kept)
    total = np.array([[line[name] for name in names] for line in lines])
    mean = total[width, :width] / total[width, width]
    _, axes = np.linalg.eigh(total[:width, :width] / total[width, width] - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), kept)


def rotated(ints: DataFrame, rotation: Rotation) -> DataFrame:
    """``vec_id, ints, lead, rest``."""
    width = len(rotation.mean)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.split(_rows(batch.column(1), width))
            ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * rotation.kept)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)],
                names=["vec_id", "ints", "lead", "rest"],
            )

    return ints.mapInArrow(turn, "vec_id long, ints array<long>, lead array<double>, rest double")


class Nearest:
    """Exact nearest centroids of batches of rotated rows."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation):
        self.centroids = centroids
        self.lead, self.rest = rotation.split(centroids)
        #: Sizes that rounding errors are relative to.
        self.size = (self.lead**2).sum(1) + self.rest**2 + (rotation.mean**2).sum()
        #: Distances verified in integers, and all that there were.
        self.verified = self.pairs = 0

    def find(self, ints: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and squared distance per row; ties go to the smaller number."""
        bounds = np.stack(
            [((lead - c) ** 2).sum(1) + (rest - r) ** 2 for c, r in zip(self.lead, self.rest)], axis=1
        )
        own = (lead**2).sum(1) + rest**2
        bounds -= SLACK * (own[:, None] + self.size[None, :])
        best = bounds.argmin(1)
        first, least = best.copy(), ((ints - self.centroids[best]) ** 2).sum(1)
        self.pairs += bounds.size
        self.verified += len(ints)
        for number, centroid in enumerate(self.centroids):
            at = np.flatnonzero((bounds[:, number] <= least) & (first != number))
            if not len(at):
                continue
            exact = ((ints[at] - centroid) ** 2).sum(1)
            better = (exact < least[at]) | ((exact == least[at]) & (number < best[at]))
            best[at[better]], least[at[better]] = number, exact[better]
            self.verified += len(at)
        return best, least

    def batch(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ints = _rows(batch.column("ints"), self.centroids.shape[1])
        lead = _rows(batch.column("lead"), self.lead.shape[1])
        return ints, *self.find(ints, lead, batch.column("rest").to_numpy())


def starting_rows(ints: DataFrame, count: int, seed: int) -> np.ndarray:
    """The rows with the smallest digests of ``seed:id``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.select(mark.alias("mark"), "ints").orderBy(F.asc_nulls_last("mark"), "ints").limit(count).collect()
    return np.array([row["ints"] for row in rows], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after one round: floors of the exact means of their rows."""
    names = ["n", *(f"s{k}" for k in range(centroids.shape[1]))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, rotation)
        total = np.zeros((len(centroids), len(names)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ints, best, _ = nearest.batch(batch)
            total[:, 0] += np.bincount(best, minlength=len(centroids))
            order = np.argsort(best, kind="stable")
            present, starts = np.unique(best[order], return_index=True)
            total[present, 1:] += np.add.reduceat(ints[order], starts, axis=0)
        if total[:, 0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(centroids))), *(pa.array(c) for c in total.T)], names=["cluster", *names]
            )

    schema = "cluster long, " + ", ".join(f"{name} long" for name in names)
    sums = rows.mapInArrow(add, schema).groupBy("cluster").agg(*_sums(names)).collect()
    following = centroids.copy()
    for row in sums:
        if row["n"]:
            following[row["cluster"]] = [row[name] // row["n"] for name in names[1:]]
    return following


def centroid_clusters(
    vectors: DataFrame,
    count: int = 8,
    rounds: int = 10,
    seed: int = 3,
    scale: int = 1024,
    width: int = 64,
    kept: int = 16,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    ``kept``: rotated coordinates that rows keep besides their integers.
    """
    ints = stored(integer_vectors(vectors, id_col, vector_col, scale, width), "int-vectors")
    rotation = fit_rotation(ints, width, kept)
    rows = stored(rotated(ints, rotation), "rotated")
    centroids = starting_rows(ints, count, seed).reshape(-1, width)
    discard(ints)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, rotation)
        for batch in batches:
            if batch.num_rows:
                _, best, least = nearest.batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)],
                    names=["vec_id", "cluster", "distance"],
                )

    assigned = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    discard(rows)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(row["total"]) for row in sums)

    def held(value: int) -> int | None:
        return value if value < 1 << 63 else None

    totals = [
        (
            row["cluster"],
            held(int(row["total"])),
            held(inertia),
            hashlib.sha256(",".join(map(str, centroids[row["cluster"]].tolist())).encode()).hexdigest(),
        )
        for row in sums
    ]
    table = vectors.sparkSession.createDataFrame(
        totals, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # One row per centroid.
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
