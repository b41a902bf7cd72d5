"""Registered queries for typed text functions, row shaping and generation data flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import generation, rows
from quillgraph.operators.vector_store import VectorStore
from quillgraph.plans import inputs
from quillgraph.plans import sql_parts as S
from quillgraph.plans.registry import query
from quillgraph.session import shared_path
from quillgraph.sources import io
from quillgraph.sources.tables import table

# ---------------------------------------------------------------- native text functions


@query(
    "normalize_text",
    r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '[\p{Z}\s]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, trim(regexp_replace(t, ' ([.,;:!?])', '\1', 'g')) AS text FROM a""",
)
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    return docs.select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query(
    "normalize_blocks",
    r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '\n', '|||', 'g') AS t FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(replace(regexp_replace(t, '[\p{Z}\s]+', ' ', 'g'), '|||', chr(10)), ' ([.,;:!?])', '\1', 'g') AS t FROM a),
c AS (SELECT conv_id, turn, regexp_replace(t, ' *\n *', chr(10), 'g') AS t FROM b)
SELECT conv_id, turn, trim(regexp_replace(t, '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM c""",
)
def normalize_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Newlines given as block markers become line breaks again."""
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit("|||"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.normalize_text(marked, "|||").alias("text")
    )


@query(
    "strip_comments",
    r"SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages",
)
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_comments(F.col("html")).alias("html"))


@query(
    "page_meta",
    r"""SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN regexp_extract(html, '<title>([^<"]*)', 1) END AS description
FROM pages""",
)
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Secure pages get a description tag made from their title first."""
    title = F.regexp_extract("html", r'<title>([^<"]*)', 1)
    tag = F.concat(F.lit('<meta name="description" content="'), title, F.lit('">'))
    html = F.when(F.col("url").startswith("https:"), F.concat(tag, F.col("html"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", X.meta_description(html).alias("description"))


@query(
    "element_text",
    r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:nav|h1|li|p)>.*?</(?:nav|h1|li|p)>')) AS element,
  generate_subscripts(regexp_extract_all(html, '(?s)<(?:nav|h1|li|p)>.*?</(?:nav|h1|li|p)>'), 1) AS position FROM pages)
SELECT page_id, position::INT AS position, trim(regexp_replace(regexp_replace(element, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM e""",
)
def element_text(spark: SparkSession, d: str) -> DataFrame:
    """Every navigation bar, heading, list item and paragraph of every page, in page order."""
    elements = F.regexp_extract_all("html", F.lit(r"(?s)<(?:nav|h1|li|p)>.*?</(?:nav|h1|li|p)>"), F.lit(0))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(elements).alias("at", "element"))
    return rows.select("page_id", (F.col("at") + 1).alias("position"), X.strip_tags(F.col("element")).alias("text"))


@query(
    "file_names",
    r"SELECT page_id, regexp_replace(url, '[\\/:*?\"<>|]', '', 'g') || '.html' AS file_name FROM pages",
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.page_file_name(F.col("url")).alias("file_name"))


@query(
    "url_names",
    r"""SELECT p_partkey, 'https://wiki.example.org/' || regexp_replace(p_name || '  ' || p_type, '\s+', '_', 'g') AS url
FROM part""",
)
def url_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("  ", "p_name", "p_type")
    return table(spark, d, "part").select(
        "p_partkey", X.page_url(name, "https://wiki.example.org/").alias("url")
    )


@query(
    "stat_ranges",
    """SELECT p_partkey, CASE WHEN p_type NOT IN ('PROMO', 'LARGE') THEN p_size END AS low,
  CASE p_type WHEN 'ECONOMY' THEN p_size WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN NULL ELSE p_size + 4 END AS high
FROM part""",
)
def stat_ranges(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    spelled = (
        F.when(F.col("p_type") == "ECONOMY", size)
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("x"), size))
        .when(F.col("p_type") == "LARGE", F.lit(""))
        .otherwise(F.concat(F.lit(" "), size, F.lit("-"), (F.col("p_size") + 4).cast("string")))
    )
    parsed = table(spark, d, "part").select("p_partkey", X.stat_range(spelled).alias("r"))
    return parsed.select("p_partkey", "r.low", "r.high")


@query(
    "typed_values",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s')) AS w,
  generate_subscripts(regexp_split_to_array(text, '\s'), 1) AS position FROM documents)
SELECT doc_id, position::INT AS position, try_cast(CASE WHEN regexp_full_match(w, '\d+') THEN w END AS INT) AS number,
  nullif(w, '') AS raw FROM w""",
)
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every text; blank ones are null."""
    words = F.split("text", r"\s")
    rows = inputs.documents(spark, d).select("doc_id", F.posexplode(words).alias("at", "word"))
    value = X.typed_value(F.col("word"))
    return rows.select("doc_id", (F.col("at") + 1).alias("position"), value["number"].alias("number"), value["raw"].alias("raw"))


@query(
    "parsed_ints",
    r"""SELECT c_custkey, try_cast(CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN v END AS INT) AS value FROM
(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS v FROM customer)""",
)
def parsed_ints(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))
    )
    return table(spark, d, "customer").select("c_custkey", X.parse_int(spelled).alias("value"))


@query(
    "base_names",
    """SELECT p_partkey, p_name AS base, CASE WHEN p_size < 20 THEN 'non_boss_enemies' WHEN p_size < 30
  THEN 'companions' ELSE lower(p_type) END AS card_type FROM part""",
)
def base_names(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("p_size") < 20, " (Enemy)").when(F.col("p_size") < 30, " (Companion)")
    name = F.concat(F.col("p_name"), F.coalesce(suffix, F.lit(" (medium) ")))
    return table(spark, d, "part").select(
        "p_partkey",
        X.base_name(name).alias("base"),
        X.variant_type(name, F.lower("p_type")).alias("card_type"),
    )


@query(
    "image_phases",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 30 THEN p_size ELSE 1 END AS phase FROM part""",
)
def image_phases(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    ref = (
        F.when(F.col("p_size") < 10, F.lit(None).cast("string"))
        .when(F.col("p_size") < 20, F.concat(F.lit("/a/Foo_(Boss"), size, F.lit(").png")))
        .when(F.col("p_size") < 30, F.concat(F.lit("/a/Foo_%28Boss"), size, F.lit("%29.PNG")))
        .otherwise(F.lit("/a/Foo.png"))
    )
    return table(spark, d, "part").select("p_partkey", X.image_phase(ref).alias("phase"))


@query(
    "other_stats",
    """SELECT p_partkey, unnest(['Resist Snow', p_type, split_part(p_name, ' ', 2)]) AS name,
  unnest([1, p_size, 1]) AS value FROM part""",
)
def other_stats(spark: SparkSession, d: str) -> DataFrame:
    noun = F.element_at(F.split("p_name", " "), 2)
    text = F.concat(
        F.lit("x"), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit(" Resist Snow , "), noun
    )
    parsed = table(spark, d, "part").select("p_partkey", F.explode(X.other_stats(text)).alias("s"))
    return parsed.select("p_partkey", F.col("s.name").alias("name"), F.col("s.value").alias("value"))


@query(
    "keyword_names",
    """SELECT p_partkey, CASE WHEN p_size > 20 THEN p_type ELSE p_brand END AS name FROM part""",
)
def keyword_names(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("p_size") > 20, F.concat("p_type", F.lit("X"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.keyword_name(spelled).alias("name"))


@query(
    "name_lists",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name || '|' || p_brand END AS names FROM part""",
)
def name_lists(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("p_type") == "PROMO", " None ").otherwise(
        F.concat("p_name", F.lit(" ,, "), "p_brand", F.lit(","))
    )
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(X.name_list(spelled), "|").alias("names")
    )


@query(
    "accepted_keys",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'SMALL' WHEN 'ECONOMY' THEN 'ECONOMY' WHEN 'SMALL' THEN 'SMALL' END
  AS kind FROM part""",
)
def accepted_keys(spark: SparkSession, d: str) -> DataFrame:
    kind = X.accepted_key(F.col("p_type"), {"PROMO": "SMALL"}, ["ECONOMY", "SMALL"])
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("display_words", f"SELECT item_id, coalesce(nullif({S.DISPLAY}, ''), '—') AS shown FROM benchmark")
def display_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        "item_id", X.display_without_stop_words(F.col("text")).alias("shown")
    )


@query(
    "padded_ids",
    "SELECT o_orderkey, printf('%03d', o_orderkey) AS id FROM orders",
)
def padded_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.padded_id(F.col("o_orderkey")).alias("id"))


@query(
    "url_matches",
    """SELECT a.page_id, count_if(contains(a.url, host) OR contains(host, a.url)) AS n FROM pages a JOIN
(SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages) b USING (page_id) GROUP BY a.page_id""",
)
def url_matches(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"//([^/?#]+)", 1)
    match = X.urls_match(F.col("url"), host)
    return table(spark, d, "pages").groupBy("page_id").agg(F.count_if(match).alias("n"))


# ---------------------------------------------------------------- row shaping


@query(
    "id_filters",
    "SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1) "
    "AND item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def id_filters(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "query_id")
    asked = inputs.queries(spark, d)
    return rows.filter_ids(asked, labels.where("quality = 1"), labels.where("toxic = 1")).select("query_id")


@query("blank_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text <> ''")
def blank_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", "")
    asked = table(spark, d, "conversations").select("conv_id", "turn", text.alias("query"))
    return rows.not_blank(asked).select("conv_id", "turn")


@query(
    "document_columns",
    r"""SELECT page_id, 'page ' || page_id AS title, 'data/html/page ' || page_id || '.html' AS source_file,
  CASE WHEN starts_with(url, 'https:') THEN url ELSE '' END AS source_url FROM pages""",
)
def document_columns(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    name = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(".html"))
    docs = pages.select("page_id", F.concat(F.lit("/srv/x/data/html/"), name).alias("path"))
    urls = pages.where(F.col("url").startswith("https:")).select(name.alias("file_name"), "url")
    return rows.derive_document_columns(docs, urls).select("page_id", "title", "source_file", "source_url")


@query(
    "context_text",
    """SELECT p_partkey, 'P Name: ' || p_name || chr(10) || 'P Brand: ' || p_brand ||
  CASE WHEN p_size > 9 THEN chr(10) || 'P Size: ' || p_size ELSE '' END AS context FROM part""",
)
def context_text(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") > 9, F.col("p_size")))
    part = part.withColumn("rag_context", F.lit("hidden"))
    shown = rows.format_context(part, ["p_name", "p_brand", "p_size", "rag_context"])
    return part.select("p_partkey", shown.alias("context"))


@query(
    "context_choice",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'ready' ELSE c_name END AS rag_context, 'bm25' AS search_type
FROM customer""",
)
def context_choice(spark: SparkSession, d: str) -> DataFrame:
    ready = F.when(F.col("c_acctbal") > 5000, "ready")
    customer = table(spark, d, "customer").withColumn("rag_context", ready)
    out = rows.with_context(customer, "bm25", "c_name")
    return out.select("c_custkey", "rag_context", "search_type")


@query(
    "result_rows",
    """SELECT p_retailprice AS score, p_name AS retrieved_text, CASE WHEN p_size < 10 THEN p_brand ELSE p_type END
  AS source_url, 'p_partkey=' || p_partkey || CASE WHEN p_size > 20 THEN ';size=' || p_size ELSE '' END AS fields FROM part""",
)
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(
        F.col("p_retailprice").alias("score"),
        F.lit("bm25").alias("search_type"),
        F.col("p_name").alias("rag_context"),
        F.when(F.col("p_size") < 10, F.col("p_brand")).otherwise("").alias("source_url"),
        F.col("p_type").alias("doc_source_url"),
        "p_partkey",
        F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"),
        F.array(F.lit(0.5)).alias("hf_embedding"),
    )
    entries = F.array_sort(F.map_entries("fields"))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.to_result_rows(raw).select("score", "retrieved_text", "source_url", text.alias("fields"))


@query(
    "flattened_join",
    """SELECT c_custkey, c_name, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey FROM customer
JOIN nation ON n_nationkey = c_nationkey""",
)
def flattened_join(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    nested = both.select(
        F.struct("c_custkey", "c_name").alias("customer"), F.struct("n_name", "n_regionkey").alias("nation")
    )
    return rows.flatten_joined(nested, "customer", ["nation"])


@query(
    "fixed_split",
    """SELECT p_partkey, CASE WHEN p_size > 9 THEN 'p_size' ELSE '' END AS kept FROM part""",
)
def fixed_split(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") > 9, F.col("p_size")).alias("p_size")
    )
    out = rows.split_fixed(part, ["p_partkey"])
    return out.select("p_partkey", F.array_join(F.map_keys("entity_fields"), ",").alias("kept"))


@query(
    "fixed_join",
    """SELECT p_partkey, CASE WHEN p_size > 9 THEN 'brand=' || p_brand || ';' ELSE '' END || 'type=' || p_type AS flat
FROM part""",
)
def fixed_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 9, F.array("p_brand"))
        .otherwise(F.array().cast("array<string>"))
        .alias("brand"),
        F.create_map(F.lit("type"), "p_type").alias("entity_fields"),
    )
    out = rows.join_fixed(part, ["brand"])
    entries = F.transform(
        F.array_sort(F.map_entries("flat")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return out.select("p_partkey", F.array_join(entries, ";").alias("flat"))


@query(
    "card_records",
    """SELECT p_partkey, 'card_name=' || p_name || ';filename=' || CASE WHEN p_type = 'PROMO' THEN 'Leaders' ELSE p_name END
  || '.html' || CASE WHEN p_size > 9 THEN ';health=' || p_size ELSE '' END AS props FROM part""",
)
def card_records(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("card_name"),
        F.when(F.col("p_type") == "PROMO", "leaders").otherwise("items").alias("card_type"),
        F.when(F.col("p_size") > 9, F.col("p_size")).alias("health"),
    )
    props = rows.card_properties(cards, ["card_name", "health"])
    entries = F.array_sort(F.map_entries(props))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return cards.select("p_partkey", text.alias("props"))


# ---------------------------------------------------------------- sources


@query(
    "split_references",
    """SELECT c_custkey, len(list_filter([c_name, trim(c_mktsegment)], lambda x: x <> '')) AS n,
  c_name || '|' || c_mktsegment AS refs FROM customer""",
)
def split_references(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.concat(F.lit(" "), "c_name", F.lit(" ,, "), "c_mktsegment", F.lit(" , "))
    out = table(spark, d, "customer").select("c_custkey", io.split_refs(spelled).alias("r"))
    return out.select("c_custkey", F.size("r").cast("long").alias("n"), F.array_join("r", "|").alias("refs"))


@query(
    "query_set_round_trip",
    """SELECT item_id AS query_id, 'say, "' || text || '"' || chr(10) || item_id AS query, '' AS ground_truth,
  'https://a/' || item_id || '|b' AS refs FROM benchmark""",
)
def query_set_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A query CSV with quotes, commas and line breaks in its fields, read, kept as JSON and read again."""
    path = shared_path(spark, "query-set")
    ident = F.col("query_id").cast("string")
    rows = inputs.queries(spark, d).select(
        F.concat(F.lit(" "), ident).alias("query_id"),
        F.concat(F.lit('  say, "'), "query", F.lit('"\n'), ident, F.lit(" ")).alias("query"),
        F.lit(None).cast("string").alias("ground_truth"),
        F.concat(F.lit("https://a/"), ident, F.lit(" ,, b,")).alias("doc_reference"),
    )
    rows.write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    io.write_queries_json(io.read_queries(spark, f"{path}/csv"), f"{path}/json", "benchmark")
    out = io.read_queries_json(spark, f"{path}/json")
    return out.select(F.col("query_id").cast("long"), "query", "ground_truth", F.array_join("doc_references", "|").alias("refs"))


@query("query_set_metadata", "SELECT 'benchmark' AS source, count(*) AS total_queries, '1.0' AS version FROM benchmark")
def query_set_metadata(spark: SparkSession, d: str) -> DataFrame:
    return io.query_set_metadata(inputs.queries(spark, d), "benchmark")


@query(
    "sitemap_rows",
    """SELECT url, CASE WHEN starts_with(url, 'https:') THEN '2024-01-01' ELSE '' END AS last_updated FROM pages
WHERE NOT contains(url, '?')""",
)
def sitemap_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap entries rebuilt as XML from the pages and parsed back."""
    loc = F.when(~F.col("url").contains("?"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")))
    mod = F.when(F.col("url").startswith("https:"), "<lastmod>2024-01-01</lastmod>").otherwise("")
    xml = F.concat(F.lit("<url><loc>"), F.coalesce(loc, F.lit("")), F.lit("</loc>"), mod, F.lit("</url>"))
    entries = table(spark, d, "pages").select(
        F.from_xml(xml, "loc string, lastmod string").alias("e")
    )
    return io.sitemap_rows(entries.select("e.*"))


@query(
    "fetch_frontier",
    """SELECT DISTINCT p_name || '.html' AS file_name, 'https://wiki.example.org/' || replace(p_name, ' ', '_') AS url
FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50
  AND l_tax = 0.08))""",
)
def fetch_frontier(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    entities = part.select(
        F.col("p_name").alias("name"), X.page_url(F.col("p_name"), "https://wiki.example.org/").alias("url")
    )
    seen = table(spark, d, "lineitem").where("l_quantity = 50 and l_tax = 0.08")
    cached = part.join(seen, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return io.pages_to_fetch(entities, cached.select(X.page_file_name(F.col("p_name")).alias("file_name")))


# ---------------------------------------------------------------- embedding and generation


@query(
    "missing_vectors",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    stored = inputs.vectors(spark, d)
    return generation.missing_vectors(inputs.documents(spark, d), "vector", stored).select("doc_id")


def letter_vector(texts) -> list[list[float]]:
    """Toy encoder: characters, spaces and line breaks of each text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query(
    "query_embedding",
    """WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'query', item_id, text FROM benchmark)
SELECT kind, id, length(text)::FLOAT AS chars, (length(text) - length(replace(text, ' ', '')))::FLOAT AS spaces,
  (length(text) - length(replace(text, chr(10), '')))::FLOAT AS lines,
  (SELECT count(DISTINCT text) FROM t) AS n_encoded FROM t WHERE text IS NOT NULL""",
)
def query_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Documents and queries through one store; equal texts are encoded once, also across both."""
    store = VectorStore.new(spark, "letters")
    docs, asked = inputs.documents(spark, d), inputs.queries(spark, d)
    store.fill(docs, letter_vector)
    store.fill(asked, letter_vector, "query_id", "query")
    store.fill(docs, letter_vector)
    rows = store.vectors(docs).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "vector")
    queries = store.vectors(asked, "query_id", "query").select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), "vector")
    parts = (F.get("vector", F.lit(k)).alias(name) for k, name in enumerate(("chars", "spaces", "lines")))
    return rows.unionByName(queries).select("kind", "id", *parts, F.lit(store.rows().count()).alias("n_encoded"))


@query(
    "embed_documents",
    """SELECT doc_id, length(text)::FLOAT AS chars, (length(text) - length(replace(text, ' ', '')))::FLOAT AS spaces,
  (length(text) - length(replace(text, chr(10), '')))::FLOAT AS lines FROM documents""",
)
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    out = generation.embed(inputs.documents(spark, d), letter_vector)
    return out.select(
        "doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("spaces"),
        F.col("vector")[2].alias("lines"),
    )


@query(
    "store_vectors",
    """SELECT d.doc_id, coalesce(len(e.embedding), 3) AS dimension FROM documents d LEFT JOIN embeddings e ON vec_id = doc_id""",
)
def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Only documents without a stored vector are encoded, then put beside the stored ones."""
    docs = inputs.documents(spark, d).join(inputs.vectors(spark, d), "doc_id", "left")
    fresh = generation.embed(generation.missing_vectors(docs, "vector"), letter_vector)
    out = generation.store_vectors(docs, fresh, "vector")
    return out.select("doc_id", F.size("vector").cast("long").alias("dimension"))


@query(
    "rag_context",
    """SELECT conv_id AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context
FROM conversations WHERE text <> '' GROUP BY conv_id""",
)
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"
    )
    return generation.context(ranked)


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "conversations")
    asked = chat.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    answers = chat.where("role = 'assistant'").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"
    )
    return generation.prompts(asked, generation.context(answers), F.lit("Answer briefly."))


_PROMPTS = """c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations
  WHERE role = 'assistant' GROUP BY 1),
q AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY 1),
p AS (SELECT q.conv_id AS query_id, 'Use the following context to answer the question.' || chr(10) || 'Query: ' || query ||
  chr(10) || 'Context: ' || context AS prompt FROM q LEFT JOIN c USING (conv_id))"""


@query(
    "prompt_table",
    f"""WITH {_PROMPTS} SELECT query_id, 'Answer briefly.' AS system, prompt AS user,
  CASE WHEN prompt IS NULL THEN 'ERROR: no context' END AS error FROM p""",
)
def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d)


def toy_answer(system: str, user: str) -> str:
    """Toy generator that fails on prompts of many lines."""
    if user.count("\n") > 12:
        raise ValueError("too long")
    return f"{len(system)} {len(user)}"


@query(
    "generation_status",
    f"""WITH {_PROMPTS} SELECT CASE WHEN prompt IS NULL OR length(prompt) - length(replace(prompt, chr(10), '')) > 12
  THEN 'failed' ELSE 'success' END AS status, count(*) AS n FROM p GROUP BY 1""",
)
def generation_status(spark: SparkSession, d: str) -> DataFrame:
    return generation.status_counts(generation.generate(_prompts(spark, d), toy_answer))
