"""Exact substring join: every text is read once, where it lies, by an automaton of the needles.

Needles are collected in chunks of at most about :data:`CHUNK_BYTES`, whatever their number; each
chunk is one pass over the texts, which are never shuffled and never split into characters. Of a
very long needle only the beginning is in the automaton; its candidates are verified in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.automaton import Automaton

#: Bytes of the needles of one pass, and of one needle inside the automaton.
CHUNK_BYTES, NEEDLE_BYTES = 1 << 18, 1 << 12
#: Bytes of text that a task matches at once.
TEXT_BYTES = 1 << 22


class Matcher:
    """Automata of one chunk: needles anywhere in a text, and needles as whole words."""

    def __init__(self, needles: list[bytes], whole: list[bool]):
        self.needles = needles
        self.parts = []
        for flag in (False, True):
            numbers = np.array([k for k, w in enumerate(whole) if w == flag], np.int64)
            if len(numbers):
                self.parts.append((flag, numbers, Automaton([needles[k] if flag else needles[k][:NEEDLE_BYTES] for k in numbers])))

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros((2, 0), np.int64)]
        for flag, numbers, automaton in self.parts:
            text, needle = automaton.pairs(texts, flag)
            needle = numbers[needle]
            good = [flag or len(self.needles[n]) <= NEEDLE_BYTES or self.needles[n] in texts[t] for t, n in zip(text, needle)]
            found.append(np.stack([text, needle])[:, np.array(good, bool)])
        text, needle = np.concatenate(found, axis=1)
        return text, needle


def _portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the row they begin at; only one run is held as texts."""
    raw = column.cast(pa.binary())
    ends = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(raw):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
        yield start, raw.slice(start, stop - start).to_pylist()
        start = stop


def matched_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (text_id, needle_id): ``texts(text_id, text)`` that hold ``needles(needle_id, needle, whole)``.

    A needle with ``whole`` (of word characters only) must be a maximal run of letters, marks,
    numbers and underscores. Nulls and empty needles match nothing.
    """
    spark = texts.sparkSession
    texts = texts.where("text is not null").select("text_id", "text")
    needles = needles.where("needle is not null and needle <> ''").select("needle_id", "needle", "whole").distinct()
    schema = T.StructType([texts.schema["text_id"], needles.schema["needle_id"]])
    size = needles.agg(F.sum(F.octet_length("needle"))).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    chunks = -(-size // CHUNK_BYTES)
    numbered = needles.withColumn("chunk", F.pmod(F.xxhash64("needle"), F.lit(chunks)))
    found = None
    for chunk in range(chunks):
        one = _chunk_pairs(texts, numbered.where(F.col("chunk") == chunk).drop("chunk"), schema)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _chunk_pairs(texts: DataFrame, needles: DataFrame, schema: T.StructType) -> DataFrame:
    held = needles.toArrow().combine_chunks()
    ids = held["needle_id"].combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast(
        (ids, held["needle"].cast(pa.binary()).to_pylist(), held["whole"].to_pylist())
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, whole = shared.value
        matcher = Matcher(words, whole)
        for batch in batches:
            for start, portion in _portions(batch.column("text")):
                text, needle = matcher.pairs(portion)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id").take(pa.array(start + text)), ids.take(pa.array(needle))],
                    names=["text_id", "needle_id"],
                )

    return texts.mapInArrow(match, schema)


def contains_pairs(texts: DataFrame, needles: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Distinct (text_id, needle_id) where ``texts.text`` holds ``needles.needle`` anywhere.

    ``texts(text_id, text)``, ``needles(needle_id, needle)``; blank needles match nothing.
    """
    if ignore_case:
        texts = texts.withColumn("text", F.lower("text"))
        needles = needles.withColumn("needle", F.lower("needle"))
    return matched_pairs(texts, needles.withColumn("whole", F.lit(False)))
