"""Reading tables so CPU-heavy text work uses every core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table that arrives in fewer partitions than there are cores.

    Large tables already have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by key, as many as cores at least.

    A later grouping by the same key needs no further shuffle, and per-row Python work after
    it keeps every core busy even when the rows themselves are few bytes.
    """
    spark = df.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wide, spark.sparkContext.defaultParallelism), *keys)
