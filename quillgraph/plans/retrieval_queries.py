"""Registered retrieval queries: index, BM25, full text, vectors, fusion, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import STOP_WORDS, tokenize
from quillgraph.operators import enrichment, fusion, ivf, lexical, runs, vector
from quillgraph.plans import inputs
from quillgraph.plans import sql_parts as S
from quillgraph.plans.registry import query
from quillgraph.session import shared_path, written
from quillgraph.sources import io
from quillgraph.sources.tables import table

RANKED = "SELECT query_id, rank, doc_id, score FROM "


@query(
    "tokenize_terms",
    f"""WITH t AS (SELECT unnest({S.word_tokens("text")}) AS term FROM documents)
SELECT term, count(*) AS n FROM t GROUP BY term""",
)
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    terms = docs.select(F.explode_outer(tokenize(F.col("text"), STOP_WORDS)).alias("term"))
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


@query(
    "index_df",
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({S.index_tokens("text")})) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term""",
)
def index_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(inputs.documents(spark, d))


@query(
    "index_postings",
    f"""WITH t AS (SELECT doc_id, {S.word_tokens("text")} AS tokens FROM documents),
p AS (SELECT doc_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM t)
SELECT term, doc_id, doc_len, count(*) AS tf FROM p GROUP BY ALL""",
)
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(inputs.documents(spark, d), lexical.word_analyzer()).postings


@query(
    "index_corpus",
    f"""SELECT count(*) AS n_docs, round(avg(len({S.index_tokens("text")})), 6) AS avg_len
FROM documents WHERE text IS NOT NULL""",
)
def index_corpus(spark: SparkSession, d: str) -> DataFrame:
    corpus = lexical.build_index(inputs.documents(spark, d)).corpus
    return corpus.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("bm25_topk", f"WITH {S.bm25()} {RANKED} bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_search(inputs.queries(spark, d), inputs.documents(spark, d), 10)


@query("bm25_topk_with_stop_words", f"WITH {S.bm25(stop=False)} {RANKED} bm")
def bm25_topk_with_stop_words(spark: SparkSession, d: str) -> DataFrame:
    flags = lexical.stop_word_flags("bm25", query=False, docs=False)
    return lexical.bm25_search(inputs.queries(spark, d), inputs.documents(spark, d), 10, *flags)


@query(
    "bm25_topk_padded",
    f"""WITH {S.bm25(k=1000)},
every AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b, documents d),
filled AS (SELECT e.query_id, e.doc_id, coalesce(s.score, 0.0) AS score
  FROM every e LEFT JOIN bm_scores s ON s.query_id = e.query_id AND s.doc_id = e.doc_id)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM filled) WHERE rank <= 1000""",
)
def bm25_topk_padded(spark: SparkSession, d: str) -> DataFrame:
    """A k large enough that zero-score documents have to fill places."""
    return lexical.bm25_search(
        inputs.queries(spark, d), inputs.documents(spark, d), 1000, fill_zero=True
    )


@query("fulltext_topk", f"WITH {S.fulltext()} {RANKED} ft")
def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.fulltext_search(inputs.queries(spark, d), inputs.documents(spark, d), 10)


_LABEL_VECTORS = """
flat AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(x::DOUBLE) AS m FROM flat GROUP BY label, i),
cent AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM mean GROUP BY label)"""


def label_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One query vector per label: the mean of its stored vectors."""
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return mean.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda s: s["m"]).alias("vector")
    )


@query(
    "vector_topk",
    f"""WITH {_LABEL_VECTORS},
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(v,
  list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM cent, embeddings)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.vector_topk(
        label_vectors(spark, d), inputs.vectors(spark, d), 10, inputs.DIMENSION
    )


@query("vector_topk_by_query", f"WITH {S.vectors()} {RANKED} vec")
def vector_topk_by_query(spark: SparkSession, d: str) -> DataFrame:
    """Same search through the shuffled block path used when the query set is large."""
    return vector.vector_topk(
        inputs.query_vectors(spark, d),
        inputs.vectors(spark, d),
        10,
        inputs.DIMENSION,
        broadcast_bytes=8192,
    )


def hundredth_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors whose id is divisible by 100, as queries."""
    rows = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def fitted_ivf(spark: SparkSession, d: str) -> tuple[ivf.IvfIndex, DataFrame, int]:
    """The index, the exact neighbours of the fixed query set, and the cells to probe for 0.95 of them."""
    index = ivf.build_ivf(inputs.vectors(spark, d), shared_path(spark, "ivf"), inputs.DIMENSION)
    asked = hundredth_vectors(spark, d)
    exact = written(vector.vector_topk(asked, inputs.vectors(spark, d), 10, inputs.DIMENSION), "exact")
    return index, exact, index.probes_for(asked, exact)


@query(
    "vector_topk_approximate",
    f"WITH {_LABEL_VECTORS}, {S.ivf('cent')} {RANKED} ivf",
)
def vector_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Inverted-file search; the number of cells comes from measured recall."""
    index, _, probes = fitted_ivf(spark, d)
    return index.search(label_vectors(spark, d), 10, probes)


@query(
    "vector_recall",
    f"""WITH hundredth AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings WHERE vec_id % 100 = 0), {S.ivf('hundredth')},
sizes AS (SELECT k, count(*) AS n FROM homes GROUP BY k),
work AS (SELECT query_id, sum(coalesce(n, 0))::BIGINT AS n_multiplied FROM places LEFT JOIN sizes USING (k) GROUP BY query_id)
SELECT e.query_id, round(count(ivf.doc_id) / count(*), 6) AS recall, any_value(n_multiplied) AS n_multiplied
FROM fit_exact e LEFT JOIN ivf USING (query_id, doc_id) JOIN work ON work.query_id = e.query_id GROUP BY e.query_id""",
)
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force, and the rows multiplied per query."""
    index, exact, probes = fitted_ivf(spark, d)
    return ivf.recall(index, hundredth_vectors(spark, d), exact, 10, probes)


@query(
    "vector_provider_rows",
    "SELECT vec_id, len(embedding) AS dimension FROM embeddings WHERE len(embedding) = 64",
)
def vector_provider_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = vector.provider_vectors(table(spark, d, "embeddings"), "embedding", inputs.DIMENSION)
    return rows.select("vec_id", F.size("vector").alias("dimension"))


def _bm25(spark: SparkSession, d: str):
    return lambda q, k: lexical.bm25_search(q, inputs.documents(spark, d), k)


def _fulltext(spark: SparkSession, d: str):
    return lambda q, k: lexical.fulltext_search(q, inputs.documents(spark, d), k)


def _vector(spark: SparkSession, d: str):
    return lambda q, k: vector.vector_topk(
        inputs.query_vectors(spark, d), inputs.vectors(spark, d), k, inputs.DIMENSION
    )


FUSED_COLUMNS = ["query_id", "rank", "doc_id", "score"]


@query(
    "rrf_fused",
    f"WITH {S.bm25(k=20)}, {S.fulltext(k=20)}, {S.fused([('bm', 1.0), ('ft', 1.0)])} {RANKED} fused",
)
def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    parts = [("bm25", _bm25(spark, d)), ("fulltext", _fulltext(spark, d))]
    return fusion.hybrid(inputs.queries(spark, d), parts, 10)[0].select(*FUSED_COLUMNS)


@query(
    "rrf_weighted",
    f"WITH {S.bm25(k=20)}, {S.fulltext(k=20)}, {S.fused([('bm', 2.0), ('ft', 0.5)])} {RANKED} fused",
)
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    parts = [("bm25", _bm25(spark, d)), ("fulltext", _fulltext(spark, d))]
    fused = fusion.hybrid(inputs.queries(spark, d), parts, 10, weights=[2.0, 0.5])[0]
    return fused.select(*FUSED_COLUMNS)


@query(
    "hybrid_bm25_vector",
    f"WITH {S.bm25(k=20)}, {S.vectors(k=20)}, {S.fused([('bm', 1.0), ('vec', 1.0)])} {RANKED} fused",
)
def hybrid_bm25_vector(spark: SparkSession, d: str) -> DataFrame:
    parts = [("bm25", _bm25(spark, d)), ("vector", _vector(spark, d))]
    return fusion.hybrid(inputs.queries(spark, d), parts, 10)[0].select(*FUSED_COLUMNS)


@query(
    "hybrid_fulltext_vector",
    f"WITH {S.fulltext(k=20)}, {S.vectors(k=20)}, {S.fused([('ft', 1.0), ('vec', 1.0)])} {RANKED} fused",
)
def hybrid_fulltext_vector(spark: SparkSession, d: str) -> DataFrame:
    parts = [("fulltext", _fulltext(spark, d)), ("vector", _vector(spark, d))]
    return fusion.hybrid(inputs.queries(spark, d), parts, 10)[0].select(*FUSED_COLUMNS)


_THREE = S.fused([("bm", 1.0), ("ft", 1.0), ("vec", 1.0)])


@query(
    "rrf_three_way",
    f"""WITH {S.bm25(k=20)}, {S.fulltext(k=20)}, {S.vectors(k=20)}, {_THREE},
src AS (SELECT query_id, doc_id, 'bm25' AS c, 0 AS p, score FROM bm UNION ALL
  SELECT query_id, doc_id, 'fulltext', 1, score FROM ft UNION ALL
  SELECT query_id, doc_id, 'vector', 2, score FROM vec)
SELECT f.query_id, f.rank, f.doc_id, f.score, arg_max(c, p) AS source_retriever,
  string_agg(c || '=' || printf('%.6f', src.score), ',' ORDER BY p) AS retriever_scores
FROM fused f JOIN src USING (query_id, doc_id) GROUP BY f.query_id, f.rank, f.doc_id, f.score""",
)
def rrf_three_way(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        ("bm25", _bm25(spark, d)),
        ("fulltext", _fulltext(spark, d)),
        ("vector", _vector(spark, d)),
    ]
    fused = fusion.hybrid(inputs.queries(spark, d), parts, 10)[0]
    scores = F.transform(
        F.map_entries("retriever_scores"),
        lambda e: F.format_string("%s=%.6f", e["key"], e["value"]),
    )
    return fused.select(
        *FUSED_COLUMNS, "source_retriever", F.array_join(scores, ",").alias("retriever_scores")
    )


@query(
    "rrf_text_identity",
    f"""WITH {S.bm25(k=20)}, {S.fulltext(k=20)},
u AS (SELECT query_id, rank, md5(text) || '_' || source AS identity FROM
  (SELECT * FROM bm UNION ALL SELECT * FROM ft) JOIN documents USING (doc_id)),
s AS (SELECT query_id, identity, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, rank, identity, score FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, identity) AS rank FROM s) WHERE rank <= 10""",
)
def rrf_text_identity(spark: SparkSession, d: str) -> DataFrame:
    """Fusion on the identity of whole texts: copies from one source count as one document."""
    identity = fusion.text_identity(F.col("text"), F.col("source")).alias("identity")
    names = table(spark, d, "documents").select("doc_id", identity)
    asked = inputs.queries(spark, d)
    parts = [
        (name, search(asked, 20).join(names, "doc_id").drop("doc_id").withColumnRenamed("identity", "doc_id"))
        for name, search in (("bm25", _bm25(spark, d)), ("fulltext", _fulltext(spark, d)))
    ]
    fused = fusion.rrf(parts, 10)
    return fused.select("query_id", "rank", F.col("doc_id").alias("identity"), "score")


@query(
    "fallback_fusion",
    f"""WITH {S.fulltext(k=20)}, {S.vectors(k=20)},
good AS (SELECT item_id AS query_id FROM benchmark WHERE length(text) > 200),
a AS (SELECT * FROM ft WHERE query_id IN (SELECT query_id FROM good)),
b AS (SELECT * FROM vec WHERE query_id IN (SELECT query_id FROM good)),
{S.fused([("a", 1.0), ("b", 1.0)])}
SELECT query_id, rank, doc_id, score, 'hybrid_rrf' AS search_type FROM fused
UNION ALL SELECT query_id, rank, doc_id, score, 'text2cypher_vector_fallback' FROM vec
WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM good)""",
)
def fallback_fusion(spark: SparkSession, d: str) -> DataFrame:
    asked = inputs.queries(spark, d)
    status = asked.select("query_id", (F.length("query") > 200).alias("succeeded"))
    structured = _fulltext(spark, d)(asked, 20)
    return fusion.fuse_with_fallback(structured, status, _vector(spark, d)(asked, 20), 10).select(
        *FUSED_COLUMNS, "search_type"
    )


@query(
    "candidate_rows",
    """SELECT query_id, rank, doc_id, 1.0 AS score FROM (SELECT conv_id AS query_id, turn AS doc_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) WHERE rank <= 3""",
)
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.col("turn").alias("doc_id"),
        F.col("turn").alias("result_index"),
        F.lit(None).cast("double").alias("score"),
    )
    return fusion.normalize_candidates(rows, 3).select(*FUSED_COLUMNS)


_CHUNKS = """concat_ws('|', rank::VARCHAR, {0}.doc_id::VARCHAR, printf('%.6f', {0}.score), '{1}', md5(d.text),
  'https://docs.example.org/' || {0}.doc_id)"""


@query(
    "retrieval_run",
    f"""WITH {S.bm25(k=5)},
c AS (SELECT query_id, string_agg({_CHUNKS.format("bm", "bm25")}, ',' ORDER BY rank) AS chunks
  FROM bm JOIN documents d ON d.doc_id = bm.doc_id GROUP BY query_id)
SELECT b.item_id AS query_id, 'success' AS status, coalesce(chunks, '') AS chunks
FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id WHERE b.text <> ''""",
)
def retrieval_run(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows of a run with place, score, text and address of every hit."""
    results = runs.run("bm25", inputs.queries(spark, d), _corpus(spark, d), 5)

    def spelled(c: Column) -> Column:
        score = F.format_string("%.6f", c["score"])
        return F.concat_ws(
            "|", c["rank"].cast("string"), c["doc_id"].cast("string"), score, c["search_type"],
            F.md5(c["retrieved_text"]), c["source_url"],
        )

    chunks = F.array_join(F.transform("retrieved_chunks", spelled), ",")
    return results.select("query_id", "status", chunks.alias("chunks"))


def _corpus(spark: SparkSession, d: str, edges: DataFrame | None = None) -> runs.Corpus:
    docs = inputs.documents(spark, d).withColumn("source_url", inputs.doc_url())
    return runs.Corpus(docs, edges=edges)


@query(
    "results_sink",
    f"""WITH {S.fulltext(k=5)}, {S.bm25(k=5)}
SELECT 'bm25' AS retriever, query_id, rank, bm.doc_id, score, md5(text) AS digest, source AS card
FROM bm JOIN documents d ON d.doc_id = bm.doc_id
UNION ALL SELECT 'fulltext', query_id, rank, ft.doc_id, score, md5(text), source
FROM ft JOIN documents d ON d.doc_id = ft.doc_id""",
)
def results_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two graph-enriched runs, one of them written twice, read back from the sink."""
    corpus = _corpus(spark, d, source_graph(spark, d))
    path = shared_path(spark, "results")
    graph = {"bm25": lambda q: enrichment.enrich_hits(runs.retriever("bm25", corpus)(q, 5), corpus.edges)}
    asked = inputs.queries(spark, d)
    for name in ("bm25", "fulltext", "bm25"):
        if name in graph:
            rows = runs.result_chunks(graph[name](asked), name, corpus.docs)
        else:
            rows = io.unnest_results(runs.run("fulltext_then_cypher", asked, corpus, 5))
        keys = {"run": F.lit("1"), "retriever": F.lit(name), "experiment_id": F.lit("001")}
        io.write_results(rows.withColumns(keys), path)
    return io.read_results(spark, path, run="1").select(
        "retriever", "query_id", "rank", "doc_id", "score",
        F.md5("retrieved_text").alias("digest"), F.col("fields")["card"].alias("card"),
    )


@query(
    "component_results",
    f"""WITH {S.bm25(k=10)}, {S.fulltext(k=10)}
SELECT 'bm25' AS component, * FROM bm UNION ALL SELECT 'fulltext', * FROM ft""",
)
def component_results(spark: SparkSession, d: str) -> DataFrame:
    parts = [("bm25", _bm25(spark, d)), ("fulltext", _fulltext(spark, d))]
    _, ranked = fusion.hybrid(inputs.queries(spark, d), parts, 5)
    named = [r.withColumn("component", F.lit(n)) for n, r in ranked]
    return named[0].unionByName(named[1]).select("component", *FUSED_COLUMNS)


# ------------------------------------------------------------- graph enrichment


def order_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customers own documents; they have orders by status, segments and stat values."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    none = F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, src: str, src_label: str, rel: str, dst: str, dst_label: str, props=None):
        return df.select(
            F.lit(src_label).alias("src_label"),
            F.col(src).cast("string").alias("src_key"),
            F.lit(rel).alias("rel"),
            F.lit(dst_label).alias("dst_label"),
            F.col(dst).cast("string").alias("dst_key"),
            (none if props is None else props).alias("props"),
        )

    price = F.create_map(F.lit("value"), F.col("o_totalprice").cast("string"))
    return (
        rows(customer, "c_name", "Card", "HAS_DOCUMENT", "c_custkey", "Document")
        .unionByName(rows(customer, "c_mktsegment", "Shop", "HAS_DOCUMENT", "c_custkey", "Document"))
        .unionByName(rows(customer, "c_name", "Card", "BELONGS_TO_TRIBE", "c_nationkey", "Tribe"))
        .unionByName(
            rows(
                orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
                "c_name", "Card", "HAS_KEYWORD", "o_orderkey", "Keyword",
            )
        )
        .unionByName(
            rows(
                orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
                "c_name", "Card", "HAS_STAT", "o_orderkey", "Stat", price,
            )
        )
    )


def rich_customers(spark: SparkSession, d: str) -> DataFrame:
    """Ranking: the ten richest customers of every nation."""
    from quillgraph.operators.ranking import top_k

    rows = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("query_id"),
        F.col("c_custkey").alias("doc_id"),
        F.col("c_acctbal").alias("score"),
    )
    return top_k(rows, 10)


_HITS = """hits AS (SELECT * FROM (SELECT c_nationkey AS query_id, c_custkey AS doc_id, c_acctbal AS score,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
  WHERE rank <= 10)"""


@query(
    "hit_enrichment",
    f"""WITH {_HITS}
SELECT query_id, rank, doc_id, score, c_name AS card, c_mktsegment AS shop, c_nationkey::VARCHAR AS tribe,
  coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FROM orders
            WHERE o_custkey = doc_id), '') AS keywords
FROM hits JOIN customer ON c_custkey = doc_id""",
)
def hit_enrichment(spark: SparkSession, d: str) -> DataFrame:
    out = enrichment.enrich_hits(rich_customers(spark, d), order_graph(spark, d))
    return out.select(
        "query_id", "rank", "doc_id", "score", "card", "shop", "tribe",
        F.array_join("keywords", ",").alias("keywords"),
    )


@query(
    "hit_enrichment_with_stats",
    f"""WITH {_HITS}
SELECT query_id, rank, doc_id,
  (SELECT count(*) FROM orders WHERE o_custkey = doc_id) AS n_stats,
  coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = doc_id), 0) AS total FROM hits""",
)
def hit_enrichment_with_stats(spark: SparkSession, d: str) -> DataFrame:
    out = enrichment.enrich_hits(
        rich_customers(spark, d), order_graph(spark, d), enrichment.PRESETS["with_stats"]
    )
    total = F.aggregate(
        "stats", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["value"].cast("double"), F.lit(0.0))
    )
    return out.select(
        "query_id", "rank", "doc_id", F.size("stats").cast("long").alias("n_stats"),
        F.round(total, 2).alias("total"),
    )


def source_graph(spark: SparkSession, d: str) -> DataFrame:
    """Documents owned by their source (a card), which carries a language keyword per language."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    none = F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, rel: str, dst: str, dst_label: str) -> DataFrame:
        return df.select(
            F.lit("Card").alias("src_label"),
            F.col("source").alias("src_key"),
            F.lit(rel).alias("rel"),
            F.lit(dst_label).alias("dst_label"),
            F.col(dst).cast("string").alias("dst_key"),
            none.alias("props"),
        )

    langs = docs.select("source", "lang").distinct()
    return rows(docs, "HAS_DOCUMENT", "doc_id", "Document").unionByName(
        rows(langs, "HAS_KEYWORD", "lang", "Keyword")
    )


# documents nobody owns have an empty keyword list, not a missing one
_LANGS = """coalesce((SELECT string_agg(lang, ',' ORDER BY lang) FROM
  (SELECT DISTINCT lang FROM documents x WHERE x.source = d.source)), '')"""


@query(
    "vector_then_graph",
    f"""WITH {S.vectors(k=10)}
SELECT query_id, rank, vec.doc_id, score, d.source AS card, {_LANGS} AS keywords
FROM vec LEFT JOIN documents d ON d.doc_id = vec.doc_id""",
)
def vector_then_graph(spark: SparkSession, d: str) -> DataFrame:
    corpus = runs.Corpus(
        inputs.documents(spark, d),
        inputs.vectors(spark, d),
        inputs.query_vectors(spark, d),
        inputs.DIMENSION,
        source_graph(spark, d),
    )
    out = runs.retriever("vector_then_cypher", corpus)(inputs.queries(spark, d), 10)
    return out.select(*FUSED_COLUMNS, "card", F.array_join("keywords", ",").alias("keywords"))


@query(
    "fulltext_then_graph",
    f"""WITH {S.fulltext(k=10)}
SELECT query_id, rank, ft.doc_id, score, d.source AS card, {_LANGS} AS keywords
FROM ft JOIN documents d ON d.doc_id = ft.doc_id""",
)
def fulltext_then_graph(spark: SparkSession, d: str) -> DataFrame:
    corpus = runs.Corpus(inputs.documents(spark, d), edges=source_graph(spark, d))
    out = runs.retriever("fulltext_then_cypher", corpus)(inputs.queries(spark, d), 10)
    return out.select(*FUSED_COLUMNS, "card", F.array_join("keywords", ",").alias("keywords"))
