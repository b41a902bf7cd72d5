"""SimHash near duplicates found by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints that differ in at most ``radius`` bits
agree in some segment up to a small number of bits, so the small Hamming balls of every segment
value are enumerated as probes, matched with the table of exact segment values, and whole
distances are verified in the join itself. Copies share a fingerprint and meet as one row.

Defined cases: a null or empty text has fingerprint zero, which links like any other; a null id
takes part, but is never a component's id unless the component has no other; repeated rows are
repeated in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.components import components
from quillgraph.llm.storage import stored

BITS, SHINGLE, SEED = 64, 4, 42


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in more than half of the hashes of the word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    count, size = max(1, n - SHINGLE + 1), min(SHINGLE, n)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)),
        np.uint64,
        count,
    )
    votes = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8)
        votes += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
            )

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return chosen.mapInArrow(make, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def segment_balls(radius: int, segments: int) -> list[tuple[int, list[int]]]:
    """Per segment its mask and the flips to probe with.

    With radius = a * segments + b, either one of the first b + 1 segments differs in at most a
    bits or one of the others in at most a - 1.
    """
    a, b = divmod(radius, segments)
    plan, low = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        within = a if k <= b else a - 1
        places = range(low, low + width)
        if within >= 0:
            flips = [
                _signed(sum(1 << p for p in chosen))
                for size in range(within + 1)
                for chosen in combinations(places, size)
            ]
            plan.append((_signed(sum(1 << p for p in places)), flips))
        low += width
    return plan


def _ball(part: Column, segment: int, flips: list[int]) -> Column:
    flipped = F.array(*(F.lit(f).cast("long") for f in flips))
    return F.transform(
        flipped, lambda f: F.struct(F.lit(segment).alias("segment"), part.bitwiseXOR(f).alias("key"))
    )


def hamming_links(prints: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    Exact for every number of segments. More segments mean fewer probes and more candidates to
    compare: about probes * n * n / 2**(64 / segments), so 3 suits tens of millions of distinct
    fingerprints and 2 suits billions.
    """
    plan = segment_balls(radius, segments)
    fp = F.col("fp")
    exact, probes = [], []
    for k, (mask, flips) in enumerate(plan):
        part = fp.bitwiseAND(F.lit(mask).cast("long"))
        exact.append(F.struct(F.lit(k).alias("segment"), part.alias("key")))
        probes.append(_ball(part, k, flips))
    table = prints.select(fp.alias("b"), F.inline(F.array(*exact)))
    probe = prints.select(fp.alias("a"), F.inline(F.flatten(F.array(*probes))))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    on = (probe.segment == table.segment) & (probe.key == table.key) & near
    return probe.join(table, on).select("a", "b").distinct()


def simhash_groups(
    docs: DataFrame,
    radius: int = 4,
    segments: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and the smallest id that links reach."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(hamming_links(classes.select("fp"), radius, segments), "a", "b")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
