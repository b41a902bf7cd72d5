"""Vectors kept by content: a text is encoded once per model, whoever asks for it.

The store is a folder of ``digest, vector`` files per model. Texts are known by the digest of
their whole content; only narrow rows of keys and digests are compared with the store, and only
texts that it lacks are read again and encoded, one row for each distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.generation import ENCODE_BATCH, embed
from quillgraph.session import shared_path

_SHAPE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


@dataclass(frozen=True)
class VectorStore:
    spark: SparkSession
    path: str
    model: str

    @staticmethod
    def new(spark: SparkSession, model: str) -> VectorStore:
        """An empty store in the shared folder."""
        return VectorStore(spark, shared_path(spark, "vectors"), model)

    def _folder(self) -> str:
        return f"{self.path}/model={self.model}"

    def rows(self) -> DataFrame:
        """``digest, vector`` of everything encoded by this model."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder())
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], _SHAPE)
        return self.spark.read.schema(_SHAPE).parquet(self._folder())

    def fill(
        self,
        texts: DataFrame,
        encode: Callable[[Sequence[str]], Sequence[Sequence[float]]],
        key: str = "doc_id",
        text: str = "text",
        batch: int = ENCODE_BATCH,
    ) -> None:
        """Encode the texts that the store lacks, each distinct one once.

        A key (which identifies a row) or text that is null is left out.
        """
        held = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.sha2(text, 256).alias("digest"), F.col(text).alias("text")
        )
        lacking = held.select("key", "digest").join(self.rows().select("digest"), "digest", "left_anti")
        chosen = lacking.groupBy("digest").agg(F.min("key").alias("key"))
        # One row per missing text meets the texts: after the first fill mostly few.
        once = held.select("key", "text").join(chosen, "key").dropDuplicates(["digest"])
        fresh = embed(once, encode, batch, "digest", "text")
        fresh.write.mode("append").parquet(self._folder())

    def vectors(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``<key>, vector`` of every row whose text is in the store."""
        asked = texts.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("digest"))
        return asked.join(self.rows(), "digest").select(key, "vector")
