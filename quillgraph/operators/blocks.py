"""Posting blocks and ranked search over them inside Arrow tasks.

A block holds the postings of up to :data:`BLOCK_DOCS` documents and :data:`BLOCK_TOKENS` tokens (a longer
document has a block of its own) of one input split, by term, with
the largest count and the smallest document length of each term: together they bound what the term
can add to any score in the block, whatever the constants of the ranking. Its first entry, under
:data:`HEADER`, holds the documents' ids and lengths; all others name documents by their place. A search adds up these
bounds per query and scores a block only for queries whose bound reaches the k-th best score that
the task has found so far; only k rows per query and task leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from quillgraph.operators.ranking import SCORE_DIGITS

#: Documents and tokens of a block, and queries scored against it at once.
BLOCK_DOCS, BLOCK_TOKENS, TILE_QUERIES = 512, 1 << 19, 4096
#: Bytes of ids and tokens that a task sends to Python at once, besides the last of the documents.
BATCH_BYTES = 8 << 20
#: Blocks of a row group. Spark decodes up to 4,096 rows of a row group at once, blocks by default.
FILE_OPTIONS = {"parquet.block.row.count.limit": "4"}
#: Stands in place of a term in the first entry of a block; no analyzer gives an empty token.
HEADER = ""


def block_schema(doc_id: T.DataType) -> T.StructType:
    posting = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("most_tf", T.IntegerType()),
            T.StructField("least_len", T.IntegerType()),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("docs", T.ArrayType(doc_id)),
            T.StructField("lens", T.ArrayType(T.IntegerType())),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
        ]
    )
    return T.StructType(
        [
            T.StructField("n_docs", T.LongType()),
            T.StructField("total_len", T.LongType()),
            T.StructField("postings", T.ArrayType(posting)),
        ]
    )


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows ``doc_id, tokens``."""
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            fitting = int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right"))
            stop = min(max(fitting, start + 1), start + BLOCK_DOCS, batch.num_rows)
            yield _block(batch.slice(start, stop - start))
            start = stop


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    ids, tokens = rows.column("doc_id"), rows.column("tokens")
    lens = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    flat = tokens.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(len(lens)), lens)
    keys, tfs = np.unique(codes * max(len(lens), 1) + place, return_counts=True)
    code, place = keys // max(len(lens), 1), (keys % max(len(lens), 1)).astype(np.int32)
    tfs = tfs.astype(np.int32)
    ends = np.append(np.searchsorted(code, np.arange(len(flat.dictionary))), len(code))
    starts = ends[:-1]
    most = np.maximum.reduceat(tfs, starts) if len(starts) else tfs
    least = np.minimum.reduceat(lens[place], starts) if len(starts) else tfs
    count = len(starts) + 1
    first, rest = np.minimum(np.arange(count + 1), 1) * len(ids), np.append(0, ends)
    postings = pa.StructArray.from_arrays(
        [
            pa.concat_arrays([pa.array([HEADER], flat.dictionary.type), flat.dictionary]),
            pa.array(np.append(np.int32(0), most)),
            pa.array(np.append(np.int32(0), least)),
            _lists(rest, pa.array(place)),
            _lists(first, ids),
            _lists(first, pa.array(lens)),
            _lists(rest, pa.array(tfs)),
        ],
        names=["term", "most_tf", "least_len", "places", "docs", "lens", "tfs"],
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([len(ids)]), pa.array([int(lens.sum())]), _lists(np.array([0, count]), postings)],
        names=["n_docs", "total_len", "postings"],
    )


class Asked:
    """Query weights by term number; a weight may be negative."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: int, queries: int):
        order = np.argsort(term, kind="stable")
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.query, self.weight, self.queries = query[order], weight[order], queries

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row in ``terms``, query and weight of everything asked for these terms."""
        sizes = self.first[terms + 1] - self.first[terms]
        row = np.repeat(np.arange(len(terms)), sizes)
        at = self.first[terms][row] + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, self.query[at], self.weight[at]


class BlockSearch:
    """The k best documents per query over the blocks of one task."""

    def __init__(self, asked: Asked, k: int, k1: float, b: float, gain: float, avg_len: float, only: np.ndarray | None = None):
        self.asked, self.k, self.k1, self.b, self.gain, self.avg_len = asked, k, k1, b, gain, avg_len
        self.only = only
        self.best = np.full((asked.queries, k), -np.inf)
        self.ids: np.ndarray | None = None
        #: (query, block) pairs scored, and all that share a term.
        self.scored = self.pairs = 0

    def _part(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a weight of one adds for these counts; never falls with the count or with brevity."""
        return tf * self.gain / (tf + self.k1 * (1 - self.b + self.b * length / self.avg_len))

    def table(self, rows: pa.Table) -> None:
        """Search whole blocks, their rows side by side, each after its header."""
        column = {name: rows[name].combine_chunks() for name in rows.column_names}
        block, code, most, least = (column[n].to_numpy(zero_copy_only=False) for n in ("block", "code", "most_tf", "least_len"))
        flat = {n: column[n].flatten().to_numpy(zero_copy_only=False) for n in ("places", "docs", "lens", "tfs")}
        ends, docs = (
            np.concatenate([[0], np.cumsum(column[n].value_lengths().to_numpy(zero_copy_only=False))]) for n in ("places", "docs")
        )
        cuts = np.flatnonzero(np.diff(block)) + 1
        for start, end in zip(np.append(0, cuts), np.append(cuts, len(block)), strict=True):
            if end == start + 1:
                continue
            entries, held = slice(start + 1, end), slice(docs[start], docs[start + 1])
            part = slice(ends[start + 1], ends[end])
            self._search(
                code[entries], most[entries], least[entries], ends[start + 1 : end + 1] - ends[start + 1],
                flat["places"][part], flat["tfs"][part], flat["docs"][held], flat["lens"][held],
            )

    def _search(
        self, code: np.ndarray, most: np.ndarray, least: np.ndarray, ends: np.ndarray,
        places: np.ndarray, tfs: np.ndarray, ids: np.ndarray, lens: np.ndarray,
    ) -> None:
        row, query, weight = self.asked.of(code)
        tops = np.maximum(weight, 0) * self._part(most, least)[row]
        bound = np.bincount(query, tops, minlength=self.asked.queries)
        shared = np.bincount(query, minlength=self.asked.queries) > 0
        bars = self.best[:, -1]
        live = np.flatnonzero(shared & (bound + 10.0**-SCORE_DIGITS >= bars))
        self.pairs += int(shared.sum())
        self.scored += len(live)
        if not len(live):
            return
        parts = self._part(tfs, lens[places])
        out = None if self.only is None else ~np.isin(ids, self.only)
        at = np.full(self.asked.queries, -1)
        edges = np.searchsorted(row, np.arange(len(code) + 1))
        for first in range(0, len(live), TILE_QUERIES):
            tile = live[first : first + TILE_QUERIES]
            at[:] = -1
            at[tile] = np.arange(len(tile))
            scores, hit = np.zeros((len(tile), len(ids))), np.zeros((len(tile), len(ids)), bool)
            line = at[query]
            for posting in range(len(code)):
                span = slice(edges[posting], edges[posting + 1])
                good = line[span] >= 0
                if good.any():
                    entries = slice(ends[posting], ends[posting + 1])
                    cell = np.ix_(line[span][good], places[entries])
                    scores[cell] += np.multiply.outer(weight[span][good], parts[entries])
                    hit[cell] = True
            if out is not None:
                hit[:, out] = False
            self._enter(tile, np.where(hit, np.round(scores, SCORE_DIGITS), -np.inf), ids)

    def _enter(self, tile: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.full(self.best.shape, ids[0], ids.dtype)
        better = np.flatnonzero((scores > -np.inf).any(1) & (scores.max(1) >= self.best[tile, -1]))
        tile, scores = tile[better], np.concatenate([self.best[tile[better]], scores[better]], axis=1)
        known = np.concatenate([self.ids[tile], np.broadcast_to(ids, (len(tile), len(ids)))], axis=1)
        bars = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        line, col = np.nonzero((scores >= bars[:, None]) & (scores > -np.inf))
        order = np.lexsort((known[line, col], -scores[line, col], line))
        line, col = line[order], col[order]
        place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(tile)))[line]
        line, col, place = line[place < self.k], col[place < self.k], place[place < self.k]
        self.best[tile] = -np.inf
        self.best[tile[line], place] = scores[line, col]
        self.ids[tile[line], place] = known[line, col]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, document ids and scores."""
        if self.ids is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, place = np.nonzero(self.best > -np.inf)
        return query, self.ids[query, place], self.best[query, place]


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from rows that arrive block by block."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        block = rows["block"].to_numpy()
        cut = int(np.flatnonzero(block == block[-1])[0])
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None:
        yield held
