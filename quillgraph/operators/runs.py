"""Batch retrieval runs: every query of a set in one job, with a status per query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import index_tokens
from quillgraph.operators import enrichment, fusion, lexical, vector
from quillgraph.operators.rows import not_blank, to_result_rows

# Retriever kinds.
KINDS = [
    "bm25", "fulltext", "vector", "bm25_vector", "fulltext_vector", "bm25_fulltext_vector",
    "vector_then_cypher", "fulltext_then_cypher", "text2cypher", "text2cypher_vector",
]


@dataclass
class Corpus:
    """Tables a run may need; only those its kind uses have to be given.

    ``docs(doc_id, text[, source_url])``; ``candidate_status(query_id, succeeded[, query, error])``.
    """

    docs: DataFrame
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    dimension: int = 384
    edges: DataFrame | None = None
    candidates: DataFrame | None = None
    candidate_status: DataFrame | None = None
    stop_words_query: bool | None = None
    stop_words_docs: bool | None = None
    indexes: dict[str, lexical.LexicalIndex] = field(default_factory=dict)

    def index(self, kind: str, remove_stop_words: bool) -> lexical.LexicalIndex:
        """The index of an analyzer; built once, read by every retriever of this corpus."""
        name = f"{kind}-{remove_stop_words}"
        if name not in self.indexes:
            analyzer = lexical.word_analyzer(remove_stop_words) if kind == "words" else index_tokens
            self.indexes[name] = lexical.build_index(self.docs, analyzer)
        return self.indexes[name]


def retriever(kind: str, corpus: Corpus) -> Callable[[DataFrame, int], DataFrame]:
    """Ranking function ``(queries, k) -> ranked`` of a kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown retriever {kind!r}")

    def by_bm25(queries: DataFrame, k: int) -> DataFrame:
        flags = lexical.stop_word_flags("bm25", corpus.stop_words_query, corpus.stop_words_docs)
        return lexical.bm25(queries, corpus.index("words", flags[1]), k, flags[0])

    def by_fulltext(queries: DataFrame, k: int) -> DataFrame:
        flags = lexical.stop_word_flags("fulltext", corpus.stop_words_query)
        return lexical.fulltext(queries, corpus.index("tokens", False), k, flags[0])

    def by_vector(queries: DataFrame, k: int) -> DataFrame:
        asked = corpus.query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
        return vector.vector_topk(asked, corpus.vectors, k, corpus.dimension)

    def by_candidates(queries: DataFrame, k: int) -> DataFrame:
        asked = corpus.candidates.join(queries.select("query_id"), "query_id", "left_semi")
        return fusion.normalize_candidates(asked, k)

    single = {
        "bm25": by_bm25,
        "fulltext": by_fulltext,
        "vector": by_vector,
        "text2cypher": by_candidates,
    }
    if kind in single:
        return single[kind]
    if kind.endswith("_then_cypher"):
        base = single[kind.removesuffix("_then_cypher")]
        return lambda queries, k: enrichment.enrich_hits(base(queries, k), corpus.edges)
    if kind == "text2cypher_vector":
        return lambda queries, k: fusion.fuse_with_fallback(
            by_candidates(queries, 2 * k),
            corpus.candidate_status,
            by_vector(queries, 2 * k),
            k,
        )
    parts = [(name, single[name]) for name in kind.split("_")]
    return lambda queries, k: fusion.hybrid(queries, parts, k)[0]


def run(kind: str, queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """(query_id, query, status, error, execution, retrieved_chunks) for every non-blank query."""
    asked = not_blank(queries)
    ranked = retriever(kind, corpus)(asked, k)
    return collect_results(asked, ranked, kind, corpus.candidate_status, corpus.docs)


def result_chunks(ranked: DataFrame, search_type: str, docs: DataFrame | None = None) -> DataFrame:
    """Ranking rows with text, address and all their other columns in ``fields``.

    Texts and addresses come from ``docs`` where the ranking has none; only k rows per query
    meet the documents.
    """
    rows = ranked
    if docs is not None and "doc_id" in rows.columns:
        wanted = {"rag_context": "text", "source_url": "source_url"}
        held = [F.col(c).alias(name) for name, c in wanted.items() if c in docs.columns and name not in rows.columns]
        rows = rows.join(docs.select("doc_id", *held), "doc_id", "left") if held else rows
    if "search_type" not in rows.columns:
        rows = rows.withColumn("search_type", F.lit(search_type))
    return to_result_rows(rows)


def collect_results(
    queries: DataFrame,
    ranked: DataFrame,
    search_type: str,
    status: DataFrame | None = None,
    docs: DataFrame | None = None,
) -> DataFrame:
    """Nested form of a ranking; a query whose candidate source failed is a row of its own."""
    rows = result_chunks(ranked, search_type, docs)
    chunk = F.struct("rank", *[c for c in rows.columns if c not in ("query_id", "rank")])
    # A map has no order; ranks are distinct within a query, so they alone sort the chunks.
    by_rank = F.collect_list(F.struct("rank", chunk.alias("chunk")))
    in_order = F.array_sort(by_rank, lambda a, b: a["rank"] - b["rank"])
    nested = rows.groupBy("query_id").agg(F.transform(in_order, lambda c: c["chunk"]).alias("chunks"))
    out = queries.select("query_id", "query").join(nested, "query_id", "left")
    structured = status is not None and search_type.startswith("text2cypher")
    asked = said = F.lit(None).cast("string")
    failed = F.lit(False)
    if structured:
        out = out.join(status.withColumnsRenamed({"query": "_asked", "error": "_said"}), "query_id", "left")
        failed = ~F.coalesce("succeeded", F.lit(False))
        asked = F.col("_asked") if "_asked" in out.columns else asked
        said = F.col("_said") if "_said" in out.columns else said
    error = F.when(failed, F.coalesce(said, F.lit("candidate source failed")))
    # A hybrid goes on with its other component where the candidates failed.
    lost = failed & F.lit(search_type == "text2cypher")
    state = F.when(failed, "failed").otherwise("success")
    empty = F.array().cast(nested.schema["chunks"].dataType)
    return out.select(
        "query_id",
        "query",
        F.when(lost, "failed").otherwise("success").alias("status"),
        F.when(lost, error).alias("error"),
        F.struct(asked.alias("query"), state.alias("status"), error.alias("error")).alias("execution"),
        F.when(lost, empty).otherwise(F.coalesce("chunks", empty)).alias("retrieved_chunks"),
    )
