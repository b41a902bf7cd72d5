"""Removal of repeated passages by overlapping windows of three lines, built-in functions only.

Every three consecutive lines are hashed. Windows found more than once anywhere keep their first
occurrence, in the order of document id and line; the lines that later occurrences cover are
merged and removed.

Defined cases: a null text stays null; a text of fewer than three lines has no window; a window
without any word is none; a null id comes after all others; rows that share an id count as one
place, so the same lines leave each of them; an empty table gives no rows; all columns of the
input are kept under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_LAST = (1 << 63) - 1


def _at(lines, position):
    return F.get(lines, position)


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, position and the 128 hashed bits of every window with a word in it."""
    lines = F.split(F.col(text_col), "\n")

    def window(position):
        a, b, c = (_at(F.col("lines"), position + k) for k in range(WINDOW))
        return F.struct(
            position.cast("int").alias("position"),
            F.xxhash64(a, b, c).alias("h1"),
            F.xxhash64(c, F.lit(WINDOW), b, a).alias("h2"),
            F.concat(a, b, c).rlike("[^ \\t-\\r]").alias("worded"),
        )

    return (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("place"), lines.alias("lines"))
        .where(F.size("lines") >= WINDOW)
        .select("place", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)))
        .where("worded")
        .drop("worded")
    )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place and sorted line positions that later occurrences cover, merged per document."""
    windows = line_windows(docs, id_col, text_col)
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("place", "position")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(first, ["h1", "h2"]).where(F.struct("place", "position") > F.col("first"))
    covered = F.flatten(
        F.transform(F.collect_set("position"), lambda p: F.array(*(p + k for k in range(WINDOW))))
    )
    return later.groupBy("place").agg(F.array_sort(F.array_distinct(covered)).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its later repetitions, and how many lines went.

    ``n_lines`` and ``n_removed`` are added (columns of these names in the input are replaced).
    """
    covered = repeated_windows(docs, id_col, text_col).select(
        F.col("place").alias("__at"), F.col("covered").alias("__covered")
    )
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("__place"), *kept_columns)
    joined = rows.join(covered, F.col("__place") == F.col("__at"), "left")
    lines = F.split(F.col(text_col), "\n")
    size = F.coalesce(F.size(lines), F.lit(0))
    size = F.when(F.col(text_col).isNull(), 0).otherwise(size)
    positions = F.array_except(F.sequence(F.lit(0), size - 1), F.col("__covered"))
    shorter = F.array_join(F.transform(positions, lambda p: F.get(lines, p)), "\n")
    hit = F.col("__covered").isNotNull() & (size > 0)
    text = F.when(hit, shorter).otherwise(F.col(text_col))
    removed = F.when(hit, size - F.size(positions)).otherwise(F.lit(0))
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in kept_columns),
        size.cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
    )
