"""Counts over whole texts, made once per document inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_chars",
    "n_lines",
    "n_distinct",
    "n_top",
    "n_adjacent",
    "n_digits",
    "n_upper",
    "n_ends",
    "n_short",
    "n_long",
    "n_symbol_words",
    "n_commas",
    "n_stops",
]
STATS_SCHEMA = "doc_id long, held_out boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def _ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs: equal numbers for equal pairs only."""
    width = int(right.max()) + 1
    return np.unique(left * width + right, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 5-word window found twice or more."""
    n = len(ids)
    if n <= WINDOW or distinct == n:
        return 0
    if 5 * max(1, (distinct - 1).bit_length()) <= 62:
        codes = ids[: n - 4].copy()
        for k in range(1, WINDOW):
            codes *= distinct
            codes += ids[k : n - 4 + k]
    else:
        pairs = _ranked(ids[:-1], ids[1:])
        codes = _ranked(_ranked(pairs[:-3], pairs[2:-1]), ids[4:])
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(codes) + WINDOW, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + WINDOW, -1)
    return int((np.cumsum(twice) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of :data:`COUNTS`; a null text counts as an empty one.

    Words are runs of characters other than ASCII space and control white space. Lines are
    split at line feeds; a line without a word never counts as repeated.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_chars = len(text or "")
    lines = [line for line in data.split(b"\n") if line.strip()]
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    raw = np.frombuffer(data, np.uint8)
    seen = np.bincount(raw, minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marks = tuple(s.encode() for s in SYMBOLS)
    return (
        len(words),
        n_chars - spaces,
        int(sum(seen[ord(s)] for s in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
        n_chars,
        len(lines),
        len(numbers),
        int(np.bincount(ids).max()) if len(ids) else 0,
        int((ids[1:] == ids[:-1]).sum()),
        int(seen[48:58].sum()),
        int(seen[65:91].sum()),
        int(seen[46] + seen[33] + seen[63]),
        int((lengths <= 3).sum()),
        int((lengths >= 12).sum()),
        sum(w.endswith(marks) for w in words) if seen[[ord(s) for s in SYMBOLS]].any() else 0,
        int(seen[44]),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines),
    )


def document_stats(
    docs: DataFrame, hold: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts per row; ``held_out`` marks ids whose crc32 leaves no remainder by ``hold``.

    A null id is never held out. Repeated rows give repeated rows; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([text_counts(t.as_py()) for t in batch.column(2)], np.int64)
            values = values.reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(values[:, k]) for k in range(len(COUNTS)))],
                names=["doc_id", "held_out", *COUNTS],
            )

    key = F.col(id_col)
    return docs.select(
        key.cast("long").alias("doc_id"),
        F.coalesce(F.crc32(key.cast("string").cast("binary")) % hold == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(count, STATS_SCHEMA)


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """Counts of at most ``limit`` labelled documents, those with the smallest digests of their ids.

    Repeated ids count once; labels other than 0 and 1 are no labels.
    """
    known = (
        labels.where(F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).alias("__label"))
    )
    once = stats.join(known, "doc_id").dropDuplicates(["doc_id"])
    # A count per head of the digests finds where the sample ends, so no more than the sample
    # and one head's rows are sorted, whatever the number of partitions.
    digest = F.md5(F.col("doc_id").cast("string"))
    head = F.substring(digest, 1, 4)
    heads = once.groupBy(head.alias("head")).count().toArrow().sort_by("head").to_pydict()
    within = np.cumsum(heads["count"]) >= limit
    if within.any():
        once = once.where(head <= heads["head"][int(within.argmax())])
    return once.orderBy(digest, "doc_id").limit(limit)
