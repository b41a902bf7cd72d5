"""Registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.centroids import centroid_clusters
from quillgraph.llm.line_dedup import dedup_lines
from quillgraph.llm.lm_scoring import score_texts
from quillgraph.llm.maxscore import top_documents
from quillgraph.llm.merkle import verified_manifest
from quillgraph.llm.mixing import mix_domains
from quillgraph.llm.neighbours import embedding_groups
from quillgraph.llm.oracle_sql import OP11_SQL, OP12_SQL, OP13_SQL
from quillgraph.llm.packing import ids_digest, pack_documents
from quillgraph.llm.quality_classifier import classify_quality
from quillgraph.llm.quality_rules import apply_quality_rules
from quillgraph.llm.simhash import simhash_groups
from quillgraph.llm.storage import read_table
from quillgraph.llm.warc import read_archives, write_archives
from quillgraph.llm.wrappers import extract_main_text

#: Shares of all tokens that the registered mixture aims at.
TARGETS = {"clean": 0.9, "poor": 0.08, "toxic": 0.02}


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", ids_digest(F.col("ids")), "doc_tokens", "sequence_id", "offset"
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, poor or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return labels.where("quality is not null").select("doc_id", domain.alias("domain"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    labelled = label_domains(read_table(spark, folder, "labels"))
    mixed = mix_domains(read_table(spark, folder, "documents"), labelled, TARGETS)
    posteriors = (F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS)))
    return mixed.select("doc_id", "n_tokens", *posteriors, "rate", "copies")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_quality_rules(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(read_table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
),
occ AS (
  SELECT doc_id, p AS pos, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM split WHERE len(l) >= 3)
  WHERE regexp_matches(l[p + 1] || l[p + 2] || l[p + 3], '[^ \\x09-\\x0D]')
),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM occ
),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM ranked CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1
),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM split),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text AS text
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(read_table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = read_archives(write_archives(read_table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM m
"""


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_groups(read_table(spark, folder, "embeddings"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read_table(spark, folder, "documents"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(read_table(spark, folder, "pages"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified_manifest(read_table(spark, folder, "documents"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(read_table(spark, folder, "embeddings"))


def op13_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return top_documents(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_embeddings": op8_embeddings,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_main_text": op10_main_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroids": op12_centroids,
    "op13_maxscore": op13_maxscore,
}

SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_centroids": OP12_SQL,
    "op13_maxscore": OP13_SQL,
}
