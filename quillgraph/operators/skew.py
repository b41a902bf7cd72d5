"""Equi joins of many rows with few rows per key, where one key may hold most of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key spread over; the few rows of a key are repeated so often.
SALTS = 32


def hot_join(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` on ``keys``; rows of a key are dealt by the hash of ``spread``.

    ``how``: inner or left. Spark may still broadcast the few.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
