"""Exact top-k by inner product with MaxScore over shards of postings.

A component is a term, its value the weight of a posting. Documents lie in shards of bounded
size; a shard holds its postings by term, and the largest and smallest weight of each term give
the most that a query can gain from it. The terms with the smallest gains whose sum stays below a
query's threshold (its k-th best score so far) are non-essential: a document cannot enter the
list by them alone. A shard's essential postings are traversed for a block of queries at once;
only documents whose score so far plus the gains still to come reaches the threshold stay, and
the non-essential postings are probed for them in falling order of gain, dropping documents as
soon as they cannot compete. A shard in which no term is essential is passed over.

Query blocks meet document groups in rounds of geometrically growing numbers of groups, each block
with each group once. Thresholds of one round prune the next, so a query sends a bounded number
of rows on average in a round, whatever the size of the table; the lists of the groups are then
merged per query.

Scores are exact: they are added up in single precision only where every partial sum is an
integer below 2**23, in double below 2**52, else in 64-bit integers.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
vectors whose scores may not fit a long (number of components times the square of the largest
beyond 2**62); vectors of other lengths take part, missing components are zero; repeated rows are
queries and candidates of their own; ties go to the smaller id, null ids last, then to the row
that comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.storage import discard, stored

#: Most rows of a block of queries and of a group of documents that meet in one task.
QUERY_ROWS = DOCUMENT_ROWS = 1 << 16
#: Documents of a shard, and queries that traverse it at once.
SHARD, TOGETHER = 4096, 512
#: Non-essential terms probed between two looks at who still competes.
PROBED = 8
_HITS = "query long, row long, vec_id long, score long"


def weights(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, vec_id, terms`` of usable vectors: ``floor(scale * x)`` of every component as double."""
    values = F.col(vector_col).cast("array<double>")
    largest = F.coalesce(F.array_max(F.transform(values, F.abs)), F.lit(0.0)) * scale + 1
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size(values) * largest * largest <= 2.0**62)
    terms = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    return vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(usable, terms).alias("terms"),
    ).where("terms is not null")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, zero where a vector is shorter than the widest."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((int(c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for c in column.chunks), default=0)


class Lists:
    """The k best documents of each query of a block, and the thresholds that follow from them."""

    def __init__(self, bars: np.ndarray, k: int):
        self.bars, self.k = bars, k
        self.query, self.row, self.known, self.vec, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, query: np.ndarray, row: np.ndarray, known: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        merged = [np.concatenate(p) for p in zip((self.query, self.row, self.known, self.vec, self.score), (query, row, known, vec, score))]
        query, row, known, vec, score = merged
        order = np.lexsort((row, vec, ~known, -score, query))
        query = query[order]
        starts = np.searchsorted(query, np.arange(len(self.bars)))
        place = np.arange(len(query)) - starts[query]
        kept = order[place < self.k]
        self.query, self.row, self.known, self.vec, self.score = (a[kept] for a in merged)
        last = order[place == self.k - 1]
        self.bars[merged[0][last]] = np.maximum(self.bars[merged[0][last]], merged[4][last])


class Shard:
    """Postings by term of up to :data:`SHARD` documents."""

    def __init__(self, rows: np.ndarray, known: np.ndarray, vec: np.ndarray, terms: np.ndarray, exact: type):
        self.rows, self.known, self.vec = rows, known, vec
        self.postings = np.ascontiguousarray(terms.T.astype(exact))
        self.most, self.least = self.postings.max(1), self.postings.min(1)

    def seed(self, queries: np.ndarray, own: np.ndarray, lists: Lists, numbers: np.ndarray) -> None:
        """Thresholds of queries without one: their k-th best score among the shard's first documents."""
        open_ = np.flatnonzero(lists.bars[numbers] == _NONE)
        few = min(len(self.rows), max(256, 2 * lists.k))
        if not len(open_) or few <= lists.k:
            return
        scores = (queries[open_] @ self.postings[:, :few]).astype(np.int64)
        scores[own[open_][:, None] == self.rows[None, :few]] = _NONE
        lists.bars[numbers[open_]] = np.partition(scores, few - lists.k, axis=1)[:, few - lists.k]

    def search(self, queries: np.ndarray, own: np.ndarray, lists: Lists, numbers: np.ndarray) -> None:
        """Enter the shard's competitive documents in the lists of these queries."""
        self.seed(queries, own, lists, numbers)
        bars = lists.bars[numbers].astype(queries.dtype)
        gains = np.maximum(queries * self.most, queries * self.least)
        rising = np.argsort(gains, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(gains, rising, 1), axis=1)
        # Non-essential: a prefix in rising order whose gains stay below the threshold in sum.
        other = np.logical_and.accumulate(sums < bars[:, None], axis=1)
        counts = other.sum(1)
        essential = np.zeros(gains.shape, bool)
        np.put_along_axis(essential, rising, ~other, 1)
        slack = np.where(counts > 0, np.take_along_axis(sums, np.maximum(counts - 1, 0)[:, None], 1)[:, 0], 0)
        live = np.flatnonzero(counts < gains.shape[1])
        if not len(live):
            return
        scores = np.where(essential, queries, 0)[live] @ self.postings
        at, doc = np.nonzero(scores >= (bars - slack)[live][:, None])
        score = scores[at, doc]
        at = live[at]
        mine = own[at] != self.rows[doc]
        at, doc, score = at[mine], doc[mine], score[mine]
        probing = counts[at] > 0
        done = [(at[~probing], doc[~probing], score[~probing])]
        at, doc, score = at[probing], doc[probing], score[probing]
        left = counts[at]
        while len(at):
            for _ in range(PROBED):
                more = np.flatnonzero(left > 0)
                left[more] -= 1
                term = rising[at[more], left[more]]
                score[more] += queries[at[more], term] * self.postings[term, doc[more]]
            rest = np.where(left > 0, sums[at, np.maximum(left - 1, 0)], 0)
            good = score + rest >= bars[at]
            ended = good & (left == 0)
            done.append((at[ended], doc[ended], score[ended]))
            stays = good & (left > 0)
            at, doc, score, left = at[stays], doc[stays], score[stays], left[stays]
        at, doc, score = (np.concatenate(p) for p in zip(*done))
        lists.add(numbers[at], self.rows[doc], self.known[doc], self.vec[doc], score.astype(np.int64))


#: Threshold of a query whose list is not full; below every score.
_NONE = -(1 << 62) - 1


def best_of_block(queries: pa.Table, documents: pa.Table, k: int) -> pa.Table:
    """Up to k competitive documents of a group for each query of a block."""
    width = max(_widest(queries["terms"]), _widest(documents["weights"]), 1)
    asked = _matrix(queries["terms"], width)
    terms = _matrix(documents["weights"], width)
    largest = float(np.abs(asked).max(initial=0)) * float(np.abs(terms).max(initial=0)) * max(width, 1)
    exact = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    asked = asked.astype(exact)
    own = queries["row"].to_numpy()
    lists = Lists(queries["bar"].to_numpy().astype(np.int64), k)
    rows, ids = documents["number"].to_numpy(), documents["vec_id"].combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    vec = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for start in range(0, len(rows), SHARD):
        part = slice(start, start + SHARD)
        shard = Shard(rows[part], known[part], vec[part], terms[part], exact)
        for first in range(0, len(own), TOGETHER):
            numbers = np.arange(first, min(first + TOGETHER, len(own)))
            shard.search(asked[numbers], own[numbers], lists, numbers)
    return pa.table(
        {
            "query": own[lists.query],
            "row": lists.row,
            "vec_id": pa.array(lists.vec, mask=~lists.known),
            "score": lists.score,
        }
    )


def _dealt(row: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(parts))


def top_documents(
    vectors: DataFrame,
    asked: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    document_rows: int = DOCUMENT_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row where ``asked``
    (a condition on ``vec_id``) holds."""
    spark = vectors.sparkSession
    rows = stored(weights(vectors, id_col, vector_col, scale), "weights")
    n, n_asked = rows.count(), rows.where(asked).count()
    cores = spark.sparkContext.defaultParallelism
    groups = max(-(-n // document_rows), 1)
    # As many blocks as the limit asks for, since documents are repeated for each; more of a few hundred
    # rows only while blocks and groups together make fewer than two tasks for each core.
    blocks = max(-(-n_asked // query_rows), min(-(-2 * cores // groups), n_asked // 256), 1)
    documents = rows.withColumn("group", _dealt(F.col("row"), groups))
    queries = rows.where(asked).withColumn("block", _dealt(F.col("row"), blocks)).select("block", "row", "terms")

    def search(queries: pa.Table, documents: pa.Table) -> pa.Table:
        return best_of_block(queries, documents, k)

    best, start = None, 0
    while start < groups:
        end = min(groups, max(4 * start, 1))
        barred = queries.withColumn("bar", F.lit(_NONE))
        if best is not None:
            full = best.groupBy("query").agg(F.min("score").alias("low"), F.count("*").alias("size")).where(F.col("size") == k)
            barred = queries.join(full.select(F.col("query").alias("row"), "low"), "row", "left").select(
                "block", "row", "terms", F.coalesce("low", F.lit(_NONE)).alias("bar")
            )
        left = barred.withColumn("group", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
        right = documents.where(F.col("group").between(start, end - 1))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pair = (F.col("block").cast("long") * groups + F.col("group").cast("long")).alias("pair")
        found = (
            left.select(pair, "row", "terms", "bar").groupBy("pair")
            .cogroup(right.select(pair, F.col("row").alias("number"), "vec_id", F.col("terms").alias("weights")).groupBy("pair"))
            .applyInArrow(search, _HITS)
        )
        if best is not None:
            found = found.unionByName(best)
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        merged = stored(
            found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place"), "best"
        )
        if best is not None:
            discard(best)
        best, start = merged, end
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ids = rows.where(asked).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return (
        best.withColumn("rank", F.row_number().over(place))
        .join(ids, "query")
        .select("query_id", "rank", "vec_id", "score")
    )
