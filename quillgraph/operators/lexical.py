"""Inverted index, BM25 and full-text ranking for whole query sets at once.

The texts are tokenized once, where they lie, into posting blocks (:mod:`quillgraph.operators.blocks`)
that are written and can be kept. Document frequencies are sums over blocks. A search reads the
blocks, keeps the postings of asked terms by a broadcast join, scores blocks inside their tasks and
sends k rows per query and task to the final ranking: neither texts nor postings are shuffled.
Query sets of any size are searched in passes of bounded size.

Token arrays are unnested with ``explode_outer`` plus a null filter: for a plain ``explode``
the optimizer adds a "not empty" filter that repeats the whole tokenizer expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.functions.text import STOP_WORDS, index_tokens, tokenize
from quillgraph.operators.blocks import (
    BATCH_BYTES, BLOCK_DOCS, FILE_OPTIONS, HEADER, Asked, BlockSearch, block_schema, make_blocks, whole_blocks
)
from quillgraph.operators.ranking import top_k
from quillgraph.session import batches_of, shared_path

# BM25 constants of the two rankings.
OKAPI_K1, OKAPI_B, OKAPI_FLOOR = 1.5, 0.75, 0.25
FULLTEXT_K1, FULLTEXT_B = 1.2, 0.75

# Characters of the queries of one pass, and rows that a task may hold for them.
PASS_CHARS, PASS_ROWS = 4_000_000, 4_000_000


@dataclass(frozen=True)
class LexicalIndex:
    """Posting blocks, ``terms(term, df)`` and ``corpus(n_docs, avg_len)``, kept as files."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``term, doc_id, doc_len, tf``."""
        head = F.element_at("postings", 1)
        rows = self.blocks.select(head["docs"].alias("ids"), head["lens"].alias("all_lens"), F.inline("postings"))

        def entry(pair: Column) -> Column:
            at = pair["places"]
            return F.struct(
                F.get("ids", at).alias("doc_id"), F.get("all_lens", at).alias("doc_len"), pair["tfs"].cast("long").alias("tf")
            )

        return rows.where(F.col("term") != HEADER).select("term", F.inline(F.transform(F.arrays_zip("places", "tfs"), entry)))

    @property
    def doc_ids(self) -> DataFrame:
        return self.blocks.select(F.explode(F.element_at("postings", 1)["docs"]).alias("doc_id"))

    def save(self, path: str) -> None:
        for name in ("blocks", "terms", "corpus"):
            options = FILE_OPTIONS if name == "blocks" else {}
            getattr(self, name).write.mode("overwrite").options(**options).parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "corpus")))


def word_analyzer(remove_stop_words: bool = True) -> Callable[[Column], Column]:
    words = STOP_WORDS if remove_stop_words else ()
    return lambda text: tokenize(text, words)


def query_terms(queries: DataFrame, analyzer: Callable[[Column], Column]) -> DataFrame:
    """(query_id, term, times) for queries that hold text; repeated terms count each time."""
    asked = queries.where(F.col("query").isNotNull() & (F.col("query") != ""))
    return (
        asked.select("query_id", F.explode_outer(analyzer(F.col("query"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("times"))
    )


def document_frequencies(docs: DataFrame, analyzer: Callable[[Column], Column] = index_tokens) -> DataFrame:
    """``term, df`` without an index: one tokenizer pass, counts combined before the shuffle."""
    terms = F.explode_outer(F.array_distinct(analyzer(F.col("text")))).alias("term")
    held = docs.where("text is not null and doc_id is not null").select(terms)
    return held.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def build_index(
    docs: DataFrame, analyzer: Callable[[Column], Column] = index_tokens, path: str | None = None
) -> LexicalIndex:
    """Index of ``docs(doc_id, text)``; documents without text or id are left out.

    Written to ``path``, by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "index")
    tokens = docs.where("text is not null and doc_id is not null").select("doc_id", analyzer(F.col("text")).alias("tokens"))
    made = tokens.mapInArrow(make_blocks, block_schema(docs.schema["doc_id"].dataType))
    with batches_of(spark, BLOCK_DOCS, BATCH_BYTES):
        made.write.options(**FILE_OPTIONS).parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    entries = blocks.select(F.inline("postings")).where(F.col("term") != HEADER)
    entries.groupBy("term").agg(F.sum(F.size("places")).alias("df")).write.parquet(f"{path}/terms")
    n_docs = F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs")
    blocks.agg(n_docs, (F.sum("total_len") / F.sum("n_docs")).alias("avg_len")).write.parquet(f"{path}/corpus")
    return LexicalIndex.load(spark, path)


def okapi_weights(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, idf): terms in over half the documents get a quarter of the mean idf instead."""
    n_docs = corpus.select("n_docs").scalar()
    raw = terms.select(
        "term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    floor = raw.agg(F.avg("raw")).scalar() * F.lit(OKAPI_FLOOR)
    return raw.select(
        "term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")
    )


def fulltext_weights(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    n_docs = corpus.select("n_docs").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.select("term", idf.alias("idf"))


def _weighted(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, term, weight`` of the asked terms that some document holds."""
    return terms.join(weights, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))


def _scored(
    index: LexicalIndex, weighted: DataFrame, k: int, k1: float, b: float, gain: float, only: Sequence | None = None
) -> DataFrame:
    """The k best documents of each task for the queries of one pass: ``query_id, doc_id, score``.

    ``only``: ids that alone may be found.
    """
    spark = weighted.sparkSession
    blocks = index.blocks
    doc_id = blocks.schema["postings"].dataType.elementType["docs"].dataType.elementType
    schema = T.StructType([weighted.schema["query_id"], T.StructField("doc_id", doc_id), T.StructField("score", T.DoubleType())])
    held = weighted.toArrow().combine_chunks()
    if not held.num_rows:
        return spark.createDataFrame([], schema)
    query, term = (held[name].combine_chunks().dictionary_encode() for name in ("query_id", "term"))
    asked = Asked(
        term.indices.to_numpy(), query.indices.to_numpy(), held["weight"].to_numpy(), len(term.dictionary), len(query.dictionary)
    )
    avg_len = index.corpus.first()["avg_len"]
    names = pa.table(
        {
            "term": pa.concat_arrays([pa.array([HEADER], term.dictionary.type), term.dictionary]),
            "code": pa.array(range(-1, len(term.dictionary)), pa.int32()),
        }
    )
    allowed = None if only is None else np.array(only)
    shared = spark.sparkContext.broadcast((asked, query.dictionary, allowed))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, query_ids, allowed = shared.value
        task = BlockSearch(asked, k, k1, b, gain, avg_len, allowed)
        for rows in whole_blocks(batches):
            task.table(rows)
        number, docs, score = task.found()
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(number)), pa.array(docs.tolist(), to_arrow_type(doc_id)), pa.array(score)],
            names=["query_id", "doc_id", "score"],
        )

    # The asked terms of one pass are bounded; a broadcast join leaves the rows of a block side by side.
    postings = blocks.withColumn("block", F.monotonically_increasing_id()).select("block", F.inline("postings"))
    found = postings.join(F.broadcast(spark.createDataFrame(names)), "term").select(
        "block", "code", "most_tf", "least_len", "places", "docs", "lens", "tfs"
    )
    return found.mapInArrow(search, schema)


def _ranked(
    index: LexicalIndex,
    queries: DataFrame,
    weigh: Callable[[DataFrame], DataFrame],
    k: int,
    k1: float,
    b: float,
    gain: float,
    only: Sequence | None = None,
) -> DataFrame:
    """``query_id, rank, doc_id, score`` of all queries, in as many passes as their size asks for."""
    size = queries.agg(F.coalesce(F.sum(F.length("query")), F.lit(0)).alias("chars"), F.count("*").alias("n")).first()
    passes = max(1, -(-size["chars"] // PASS_CHARS), -(-size["n"] * k // PASS_ROWS))
    found = None
    for number in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number)
        near = _scored(index, weigh(part), k, k1, b, gain, only)
        found = near if found is None else found.unionByName(near)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")


def _first_ids(index: LexicalIndex, count: int) -> list:
    return [r["doc_id"] for r in index.doc_ids.orderBy("doc_id").limit(count).collect()]


def _pad(ranked: DataFrame, matched: DataFrame, queries: DataFrame, first: list, k: int) -> DataFrame:
    """Fill every query up to k rows with unmatched documents in id order, score zero.

    ``first``: the 2k smallest ids, all that a query short of k matches can need; ``matched``: its
    matches among them. None of those is a filler, also where its score is below zero and the
    ranking was cut before it.
    """
    asked = queries.where(F.col("query").isNotNull() & (F.col("query") != "")).select("query_id")
    kind = ranked.schema["doc_id"].dataType
    ids = ranked.sparkSession.createDataFrame([(first,)], T.StructType([T.StructField("ids", T.ArrayType(kind))]))
    filler = (
        asked.join(F.broadcast(ids))
        .select("query_id", F.explode("ids").alias("doc_id"))
        .join(matched.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    return top_k(ranked.drop("rank").unionByName(filler), k)


def bm25(
    queries: DataFrame,
    index: LexicalIndex,
    k: int = 10,
    remove_stop_words: bool = True,
    fill_zero: bool = False,
    k1: float = OKAPI_K1,
    b: float = OKAPI_B,
) -> DataFrame:
    """Okapi BM25 top-k: (query_id, rank, doc_id, score).

    With ``fill_zero`` documents without any query term still take the free places.
    """
    weights = okapi_weights(index.terms, index.corpus)

    def weigh(part: DataFrame) -> DataFrame:
        return _weighted(query_terms(part, word_analyzer(remove_stop_words)), weights)

    ranked = _ranked(index, queries, weigh, k, k1, b, k1 + 1)
    if fill_zero:
        first = _first_ids(index, 2 * k)
        matched = _ranked(index, queries, weigh, 2 * k, k1, b, k1 + 1, first)
        ranked = _pad(ranked, matched, queries, first, k)
    return ranked.select("query_id", "rank", "doc_id", "score")


def fulltext(
    queries: DataFrame, index: LexicalIndex, k: int = 10, remove_stop_words: bool = True
) -> DataFrame:
    """Any-term full-text top-k; only documents that match are returned."""
    weights = fulltext_weights(index.terms, index.corpus)

    def weigh(part: DataFrame) -> DataFrame:
        return _weighted(query_terms(part, word_analyzer(remove_stop_words)), weights)

    return _ranked(index, queries, weigh, k, FULLTEXT_K1, FULLTEXT_B, 1.0)


def bm25_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 10,
    remove_stop_words_query: bool = True,
    remove_stop_words_docs: bool = True,
    fill_zero: bool = False,
) -> DataFrame:
    """BM25 straight from a document table, through an index in the shared folder."""
    index = build_index(docs, word_analyzer(remove_stop_words_docs))
    return bm25(queries, index, k, remove_stop_words_query, fill_zero)


def fulltext_search(
    queries: DataFrame, docs: DataFrame, k: int = 10, remove_stop_words_query: bool = True
) -> DataFrame:
    """Full-text search straight from a document table (stop words stay in the documents)."""
    return fulltext(queries, build_index(docs, index_tokens), k, remove_stop_words_query)


def stop_word_flags(
    retriever: str, query: bool | None = None, docs: bool | None = None, both: bool | None = None
) -> tuple[bool, bool]:
    """Effective (query, document) stop-word removal: single flag, then ``both``, then default."""
    default_docs = retriever == "bm25"
    effective_query = query if query is not None else both if both is not None else True
    effective_docs = docs if docs is not None else both if both is not None else default_docs
    return effective_query, effective_docs


def hit_texts(ranked: DataFrame, docs: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """Attach document columns to a ranking."""
    return ranked.join(docs.select("doc_id", *columns), "doc_id")
