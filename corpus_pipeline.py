"""From raw documents to packed training sequences, in stages that each read the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.line_dedup import dedup_lines
from quillgraph.llm.mixing import fit_mixture
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.quality_classifier import classify_quality
from quillgraph.llm.queries import label_domains
from quillgraph.llm.simhash import simhash_groups
from quillgraph.llm.storage import read_table, stored

#: Shares of all tokens after the quality stage; no domain is repeated to reach them.
TARGETS = {"clean": 0.99, "toxic": 0.01}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1; a document of unknown id stays."""
    verdicts = classify_quality(docs, read_table(spark, sf_dir, "labels"))
    rejected = verdicts.where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repetitions of three-line passages; every document stays."""
    shorter = dedup_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return shorter
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return shorter.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents of unknown id stay."""
    groups = simhash_groups(docs)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = label_domains(read_table(spark, sf_dir, "labels"))
    return fit_mixture(docs, labelled, TARGETS, repeat=False).repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitted models, iterative rates and tokenization have no SQL form; tests compare the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
