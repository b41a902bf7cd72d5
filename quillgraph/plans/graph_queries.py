"""Registered graph and entity queries over the relational tables seen as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import closure
from quillgraph.operators import entities as N
from quillgraph.operators import graph as G
from quillgraph.operators.ranking import global_top_k
from quillgraph.plans import inputs
from quillgraph.operators.rules import CROWN_REDUCTION, rule_props
from quillgraph.plans.registry import query
from quillgraph.sources.tables import spread_by, table


def prop_text(column: str = "props") -> Column:
    """Map as sorted ``key=value`` text."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def edges_of(
    df: DataFrame, src: str, rel: str, dst: str, src_label: str, dst_label: str, props: Column | None = None
) -> DataFrame:
    pairs = df.withColumn("src", F.col(src)).withColumn("dst", F.col(dst))
    return G.edge_rows(pairs, src_label, rel, dst_label, props)


def nodes_of(df: DataFrame, label: str, key: str, **props: str) -> DataFrame:
    return df.select(
        F.lit(label).alias("label"),
        F.col(key).cast("string").alias("key"),
        F.array(F.lit(label)).alias("labels"),
        G.present_props(**{n: F.col(c) for n, c in props.items()}).alias("props"),
    )


def _line_order() -> Column:
    """Write order of line items: order, line, then quantity where lines repeat."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")


# ---------------------------------------------------------------- nodes


@query(
    "node_upsert",
    """WITH new AS (SELECT l_partkey AS key, arg_max([l_quantity::VARCHAR, CASE WHEN l_returnflag <> 'N'
  THEN l_returnflag || l_linestatus END], (l_orderkey, l_linenumber, l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(p_partkey, key) AS key, p_name AS name, CASE WHEN key IS NULL THEN p_size ELSE v[1]::DOUBLE END AS size,
  CASE WHEN key IS NULL THEN p_type ELSE v[2] END AS kind FROM part FULL JOIN new ON p_partkey = key""",
)
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Last line item of a part overwrites its size and kind, nulls included."""
    stored = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_type").alias("kind"),
    )
    given = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("key"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
        F.col("l_quantity").alias("size"),
        F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("kind"),
    )
    return G.upsert_nodes(stored, given, ["key"], ["size", "kind"]).select("key", "name", "size", "kind")


@query(
    "property_merge",
    """WITH cells AS (
  SELECT p_partkey AS key, 'brand' AS k, p_brand AS v, -1 AS seq FROM part
  UNION ALL SELECT p_partkey, 'type', p_type, -1 FROM part
  UNION ALL SELECT l_partkey, 'status', l_linestatus, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity::INT FROM lineitem
  UNION ALL SELECT l_partkey, 'type', CASE WHEN l_returnflag = 'R' THEN 'returned' END,
    (l_orderkey * 10 + l_linenumber) * 100 + l_quantity::INT FROM lineitem),
last AS (SELECT key, k, arg_max(v, seq) AS v FROM cells WHERE v IS NOT NULL GROUP BY key, k)
SELECT key, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM last GROUP BY key""",
)
def property_merge(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"),
        G.present_props(brand=F.col("p_brand"), type=F.col("p_type")).alias("props"),
    )
    returned = F.when(F.col("l_returnflag") == "R", "returned")
    given = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("key"),
        _line_order().alias("seq"),
        G.present_props(status=F.col("l_linestatus"), type=returned).alias("props"),
    )
    return G.merge_properties(stored, given, ["key"]).select("key", prop_text().alias("props"))


@query(
    "dedup_documents",
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
)
def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return G.dedup_documents(docs).select(F.col("seq").alias("doc_id"))


@query(
    "label_add",
    """SELECT label, n FROM (SELECT CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'Stat'
  ELSE 'Stat,Keyword' END AS label, count(*) AS n FROM customer GROUP BY 1)""",
)
def label_add(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    nodes = nodes_of(rows, "Stat", "c_mktsegment", name="c_name")
    out = G.add_label(nodes, "Stat", "Keyword", ["MACHINERY", "FURNITURE"])
    return out.groupBy(F.array_join("labels", ",").alias("label")).agg(F.count("*").alias("n"))


@query(
    "labelled_upsert",
    """WITH stat AS (SELECT DISTINCT c_mktsegment AS key FROM customer),
kw AS (SELECT DISTINCT c_mktsegment AS key FROM customer UNION SELECT DISTINCT p_type FROM part)
SELECT key, CASE WHEN key IN (SELECT key FROM stat) THEN 'Stat' ELSE 'Keyword' END AS label,
  CASE WHEN key = 'MACHINERY' THEN 'kind=stat' WHEN key IN (SELECT key FROM stat)
    THEN 'category=word;kind=stat' ELSE 'category=word' END AS props FROM kw
UNION ALL SELECT 'MACHINERY', 'Keyword', 'category=word'""",
)
def labelled_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Keyword rows land on stat nodes that carry the keyword label."""
    names = table(spark, d, "customer").select("c_mktsegment").distinct()
    nodes = nodes_of(names.withColumn("kind", F.lit("stat")), "Stat", "c_mktsegment", kind="kind")
    nodes = G.add_label(nodes, "Stat", "Keyword", ["MACHINERY"])
    words = names.union(table(spark, d, "part").select("p_type").distinct())
    given = words.select(
        F.col("c_mktsegment").alias("key"),
        F.lit(1).alias("seq"),
        F.create_map(F.lit("category"), F.lit("word")).alias("props"),
    )
    out = G.upsert_labelled(nodes, given, "Keyword")
    return out.select("key", "label", prop_text().alias("props"))


# ---------------------------------------------------------------- edges


def _bought(spark: SparkSession, d: str) -> DataFrame:
    """Customer to part of every line item.

    Edges are grouped by strings and maps, for which Spark sorts all rows of a task: a whole file
    split without the exchange. Dealt by order, copies of an edge still combine before the next one.
    """
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag"
    )
    lines = spread_by(lines, "l_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    "edge_upsert",
    """SELECT DISTINCT o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 0 AND p_size > 10""",
)
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends exist among solvent customers and larger parts."""
    nodes = nodes_of(table(spark, d, "customer").where("c_acctbal > 0"), "Customer", "c_custkey")
    nodes = nodes.unionByName(nodes_of(table(spark, d, "part").where("p_size > 10"), "Part", "p_partkey"))
    edges = edges_of(_bought(spark, d), "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part")
    return G.link(edges, nodes).select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))


@query(
    "edge_upsert_valued",
    """SELECT DISTINCT o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_quantity AS value
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def edge_upsert_valued(spark: SparkSession, d: str) -> DataFrame:
    props = G.present_props(value=F.col("l_quantity"))
    edges = edges_of(_bought(spark, d), "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part", props)
    return G.link_valued(edges).select(
        F.col("src_key").alias("src"),
        F.col("dst_key").alias("dst"),
        F.col("props")["value"].cast("double").alias("value"),
    )


@query(
    "edge_unless_any",
    """WITH e AS (SELECT o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_quantity, l_returnflag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
old AS (SELECT DISTINCT src, dst, 'value=' || l_quantity AS props FROM e WHERE l_returnflag = 'R')
SELECT * FROM old UNION ALL SELECT DISTINCT src, dst, '' FROM e
WHERE (src, dst) NOT IN (SELECT (src, dst) FROM old)""",
)
def edge_unless_any(spark: SparkSession, d: str) -> DataFrame:
    rows = _bought(spark, d)
    valued = G.link_valued(
        edges_of(
            rows.where("l_returnflag = 'R'"), "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part",
            G.present_props(value=F.col("l_quantity")),
        )
    )
    plain = edges_of(rows, "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part")
    return G.link_unless_any(valued, plain).select(
        F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), prop_text().alias("props")
    )


@query(
    "edge_set_property",
    """SELECT o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst,
  arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity::INT) AS amount,
  max(CASE WHEN l_returnflag = 'R' THEN 'yes' END) AS returned
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def edge_set_property(spark: SparkSession, d: str) -> DataFrame:
    """The last amount is set on edges of which some already say that the part was returned."""
    rows = _bought(spark, d).withColumn("seq", _line_order())
    pairs = rows.withColumn("src", F.col("o_custkey")).withColumn("dst", F.col("l_partkey"))
    given = G.edge_rows(pairs, "Customer", "BOUGHT", "Part", G.present_props(amount=F.col("l_quantity")), ["seq"])
    returned = G.edge_rows(pairs.where("l_returnflag = 'R'"), "Customer", "BOUGHT", "Part", G.present_props(returned=F.lit("yes")))
    return G.link_setting(G.link(returned), given).select(
        F.col("src_key").alias("src"),
        F.col("dst_key").alias("dst"),
        F.col("props")["amount"].cast("double").alias("amount"),
        F.col("props")["returned"].alias("returned"),
    )


@query(
    "edge_counts",
    """WITH e AS (SELECT o_custkey AS src, l_partkey AS dst, l_returnflag FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey), u AS (SELECT DISTINCT src, dst FROM e)
SELECT (SELECT count(*) FROM e) AS matched_pairs, (SELECT count(*) FROM u) AS edges,
  (SELECT count(*) FROM u WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e WHERE l_returnflag = 'R')) AS new_edges""",
)
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _bought(spark, d)
    edges = edges_of(rows, "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part")
    old = edges_of(
        rows.where("l_returnflag = 'R'"), "o_custkey", "BOUGHT", "l_partkey", "Customer", "Part"
    )
    return G.link_counts(edges, G.link(edges), G.link(old))


# ---------------------------------------------------------------- hierarchy and chains


def geography(spark: SparkSession, d: str) -> DataFrame:
    """Nations below regions, regions below the world: (child, parent)."""
    nation = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    below = nation.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    top = table(spark, d, "region").select(
        F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")
    )
    return below.unionByName(top)


_GEO = """geo AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'WORLD' FROM region)"""
_UP = """up AS (SELECT child AS node, parent AS ancestor FROM geo
  UNION SELECT up.node, geo.parent FROM up JOIN geo ON geo.child = up.ancestor)"""


@query(
    "hierarchy_edges",
    f"WITH {_GEO} SELECT DISTINCT child AS src, parent AS dst FROM geo",
)
def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = geography(spark, d)
    edges = G.link(edges_of(rows, "child", "SUBTYPE_OF", "parent", "Place", "Place"))
    return edges.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))


@query("ancestor_closure", f"WITH RECURSIVE {_GEO}, {_UP} SELECT DISTINCT node, ancestor FROM up")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure.ancestors(geography(spark, d))


@query(
    "closure_members",
    f"""WITH RECURSIVE {_GEO}, {_UP}, own AS (SELECT n_name AS type, c_custkey AS member
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT type, member FROM own UNION SELECT ancestor, member FROM own JOIN up ON up.node = own.type""",
)
def closure_members(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    membership = own.select(F.col("n_name").alias("type"), F.col("c_custkey").alias("member"))
    return closure.members_of(geography(spark, d), membership)


@query(
    "partition_check",
    """WITH m AS (SELECT n_name AS type, o_orderkey AS member FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, l_orderkey FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT r_name, o_orderkey FROM orders JOIN region ON r_name = 'ASIA' WHERE o_orderpriority LIKE '1%'),
geo AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'direct member' AS breach, type, member FROM m WHERE type IN (SELECT r_name FROM region)
UNION ALL SELECT 'several subtypes', parent, member FROM m JOIN geo ON child = type
GROUP BY parent, member HAVING count(DISTINCT type) > 1""",
)
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "lineitem", "supplier", "region")}
    buyers = (
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("type"), F.col("o_orderkey").alias("member"))
    )
    sellers = (
        t["lineitem"]
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("type"), F.col("l_orderkey").alias("member"))
    )
    direct = t["orders"].where(F.col("o_orderpriority").startswith("1")).select(
        F.lit("ASIA").alias("type"), F.col("o_orderkey").alias("member")
    )
    membership = buyers.unionByName(sellers).unionByName(direct)
    below = geography(spark, d).where("parent <> 'WORLD'")
    abstract = t["region"].select(F.col("r_name").alias("type"))
    return G.check_partition(membership, below, abstract)


def line_key() -> Column:
    """Line item identity; order and line number alone repeat in the tables."""
    quantity = F.col("l_quantity").cast("int")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity)


def order_phases(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order as infoboxes of one page, grouped by flag."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        line_key().alias("pos"),
        line_key().alias("card_name"),
        F.col("l_returnflag").alias("base"),
        F.lit("bosses").alias("card_type"),
        F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("image_phase"),
    )
    return N.assign_phases(rows, variants=["N"])


_PHASES = """ph AS (SELECT l_orderkey AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS pos,
    l_returnflag AS base, CASE WHEN l_quantity > 10 THEN l_linenumber ELSE 1 END AS place FROM lineitem),
phased AS (SELECT page, pos, base, CASE WHEN n > 1 AND base <> 'N' THEN r END AS phase,
    CASE WHEN n > 1 AND base <> 'N' THEN n END AS total FROM (SELECT *, count(*) OVER (PARTITION BY page, base) AS n,
    row_number() OVER (PARTITION BY page, base ORDER BY place, pos) AS r FROM ph))"""


@query(
    "phase_assign",
    f"WITH {_PHASES} SELECT page, pos, base, phase, total AS total_phases FROM phased",
)
def phase_assign(spark: SparkSession, d: str) -> DataFrame:
    return order_phases(spark, d).select("page", "pos", "base", "phase", "total_phases")


def _phase_chain(spark: SparkSession, d: str) -> DataFrame:
    # The place on the page is the card's name here; one of the two columns is enough in the exchange.
    cards = order_phases(spark, d).where("phase is not null").select(
        F.concat_ws("/", "page", "base").alias("base_name"), "phase", "total_phases", F.col("pos").alias("card")
    )
    return G.successor_pairs(cards)


@query(
    "successor_link",
    f"""WITH {_PHASES} SELECT DISTINCT a.pos AS src, b.pos AS dst FROM phased a JOIN phased b
ON a.page = b.page AND a.base = b.base AND b.phase = a.phase + 1""",
)
def successor_link(spark: SparkSession, d: str) -> DataFrame:
    return _phase_chain(spark, d)


@query(
    "terminal_propagate",
    f"""WITH {_PHASES}, v AS (SELECT pos AS node, max(l_extendedprice) AS value FROM phased
  JOIN lineitem ON pos = l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT GROUP BY pos),
chain AS (SELECT DISTINCT a.pos AS src, b.pos AS dst, a.page, a.base FROM phased a JOIN phased b
  ON a.page = b.page AND a.base = b.base AND b.phase = a.phase + 1),
ends AS (SELECT page, base, arg_max(pos, phase) AS terminal FROM phased WHERE phase IS NOT NULL GROUP BY ALL),
moved AS (SELECT terminal AS node, max(value) AS value FROM chain JOIN ends USING (page, base)
  JOIN v ON v.node = chain.src GROUP BY terminal)
SELECT node, value FROM v WHERE node NOT IN (SELECT src FROM chain) AND node NOT IN (SELECT node FROM moved)
UNION ALL SELECT node, value FROM moved""",
)
def terminal_propagate(spark: SparkSession, d: str) -> DataFrame:
    """Line prices of phased items end on the last phase of their chain."""
    values = table(spark, d, "lineitem").groupBy(
        line_key().alias("node")
    ).agg(F.max("l_extendedprice").alias("value"))
    return closure.propagate_to_terminals(values, _phase_chain(spark, d))


# ---------------------------------------------------------------- curated and predicate links


@query(
    "rule_links",
    """WITH r AS (SELECT p_brand, unnest(['ECONOMY', 'MISSING', p_type]) AS t FROM part)
SELECT DISTINCT p_brand AS src, t AS dst FROM r WHERE t IN (SELECT p_type FROM part)""",
)
def rule_links(spark: SparkSession, d: str) -> DataFrame:
    """One-to-many rules per brand; targets that are no node link nothing."""
    parts = table(spark, d, "part")
    nodes = nodes_of(parts.select("p_brand").distinct(), "Bell", "p_brand").unionByName(
        nodes_of(parts.select("p_type").distinct(), "CardType", "p_type")
    )
    rules = parts.select(
        F.lit("Bell").alias("src_label"),
        F.col("p_brand").alias("src_key"),
        F.lit("TARGETS_TYPE").alias("rel"),
        F.lit("CardType").alias("dst_label"),
        F.array(F.lit("ECONOMY"), F.lit("MISSING"), F.col("p_type")).alias("targets"),
    )
    return G.rule_links(rules, nodes).select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))


@query(
    "reduction_rules",
    f"""SELECT DISTINCT p_brand AS src, p_type AS dst, {CROWN_REDUCTION} AS amount FROM part WHERE p_size < 10""",
)
def reduction_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every brand reduces the types of its small parts, each by the amount of the crown rules."""
    parts = table(spark, d, "part")
    nodes = nodes_of(parts.select("p_brand").distinct(), "Crown", "p_brand").unionByName(
        nodes_of(parts.select("p_type").distinct(), "Stat", "p_type")
    )
    props = F.create_map(*(F.lit(x) for pair in rule_props("REDUCES").items() for x in pair))
    rules = parts.where("p_size < 10").select(
        F.lit("Crown").alias("src_label"),
        F.col("p_brand").alias("src_key"),
        F.lit("REDUCES").alias("rel"),
        F.lit("Stat").alias("dst_label"),
        F.array("p_type").alias("targets"),
        props.alias("props"),
    )
    return G.rule_links(rules, nodes).select(
        F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), F.col("props")["amount"].cast("int").alias("amount")
    )


@query(
    "flag_links",
    """SELECT r_name AS src, p_partkey AS dst FROM region JOIN part ON
  CASE WHEN r_regionkey % 2 = 0 THEN p_retailprice > 950 ELSE p_size > 25 END""",
)
def flag_links(spark: SparkSession, d: str) -> DataFrame:
    """Regions with an even key reach for dear parts, the others for large ones."""
    wanted = F.when(F.col("r_regionkey") % 2 == 0, "is_dear").otherwise("is_large")
    sources = table(spark, d, "region").select(F.col("r_name").alias("src"), wanted.alias("flag"))
    targets = table(spark, d, "part").select(
        F.col("p_partkey").alias("dst"),
        (F.col("p_retailprice") > 950).alias("is_dear"),
        (F.col("p_size") > 25).alias("is_large"),
    )
    return G.flag_links(sources, targets, ["is_dear", "is_large"])


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct single words of part names and addresses' hosts, as names to look for."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("dst"))
    stems = table(spark, d, "pages").select(
        F.regexp_extract("url", r"//(?:[a-z]+\.)?([a-z]+)\.example", 1).alias("dst")
    )
    return words.union(stems).where("dst <> ''").distinct()


_WORDS = r"""w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part
  UNION ALL SELECT regexp_extract(url, '//(?:[a-z]+\.)?([a-z]+)\.example', 1) FROM pages) WHERE w <> '')"""


@query(
    "contains_link",
    f"WITH {_WORDS} SELECT doc_id AS src, w AS dst FROM documents JOIN w ON contains(lower(text), lower(w))",
)
def contains_link(spark: SparkSession, d: str) -> DataFrame:
    texts = inputs.documents(spark, d).select(F.col("doc_id").alias("src"), "text")
    return G.mention_links(texts, _words(spark, d))


@query(
    "keyword_link",
    f"""WITH {_WORDS}, docs AS (SELECT doc_id, lower(text) AS t FROM documents),
roots AS (SELECT w, CASE WHEN ends_with(w, 'e') THEN left(w, length(w) - 1)
  WHEN ends_with(w, 'y') THEN left(w, length(w) - 1) || 'i' END AS root FROM w),
forms AS (SELECT w, root || unnest(['', 'ing', 'ed', 'es', 's', 'ied', 'ies', 'er', 'ers', 'ly']) AS form
  FROM roots WHERE root IS NOT NULL),
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS form FROM docs)
SELECT doc_id AS src, w AS dst FROM docs JOIN w ON contains(t, w)
UNION SELECT doc_id, w FROM tokens JOIN forms USING (form)""",
)
def keyword_link(spark: SparkSession, d: str) -> DataFrame:
    texts = inputs.documents(spark, d).select(F.col("doc_id").alias("src"), "text")
    return G.keyword_links(texts, _words(spark, d))


@query(
    "unpivot_edges",
    """SELECT p_partkey AS src, 'Size' AS dst, p_size::DOUBLE AS value FROM part WHERE p_size > 3
UNION ALL SELECT p_partkey, 'Price', p_retailprice FROM part""",
)
def unpivot_edges(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").select(
        F.col("p_partkey").alias("src"),
        F.when(F.col("p_size") > 3, F.col("p_size").cast("double")).alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    return G.stat_edges(cards, {"size": "Size", "price": "Price"})


@query(
    "card_stat_edges",
    """WITH stats AS (SELECT 'Size' AS dst UNION SELECT 'Price' UNION SELECT p_type FROM part WHERE p_type <> 'PROMO'
  UNION SELECT split_part(p_name, ' ', 1) FROM part),
valued AS (SELECT DISTINCT src, dst, value FROM
  (SELECT p_partkey AS src, 'Size' AS dst, p_size::DOUBLE AS value FROM part WHERE p_size > 3
   UNION ALL SELECT p_partkey, 'Price', p_retailprice FROM part
   UNION ALL SELECT p_partkey, unnest([p_type, 'Resist Snow']), unnest([p_size, 1]) FROM part)
  WHERE dst IN (SELECT dst FROM stats)),
said AS (SELECT DISTINCT p_partkey AS src, dst FROM part JOIN stats ON contains(lower(p_name), lower(dst)))
SELECT src, dst, value FROM valued UNION ALL
SELECT said.src, said.dst, NULL FROM said ANTI JOIN valued USING (src, dst)""",
)
def card_stat_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stats of parts from columns, free text and mentions in their names."""
    parts = table(spark, d, "part")
    cards = parts.select(
        F.col("p_partkey").alias("src"),
        F.when(F.col("p_size") > 3, F.col("p_size").cast("double")).alias("size"),
        F.col("p_retailprice").cast("double").alias("price"),
        F.concat(F.lit("x"), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit(" , Resist Snow")).alias("other_stats"),
        F.col("p_name").alias("ability"),
    )
    named = parts.where("p_type <> 'PROMO'").select(F.col("p_type").alias("dst"))
    first = parts.select(F.element_at(F.split("p_name", " "), 1).alias("dst"))
    listed = parts.select(F.explode(F.array(F.lit("Size"), F.lit("Price"))).alias("dst"))
    stats = named.unionByName(first).unionByName(listed).distinct()
    return G.card_stat_edges(cards, stats, {"size": "Size", "price": "Price"})


@query(
    "prefix_link",
    """WITH cards AS (SELECT DISTINCT p_name || CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN ' Phase ' || p_size
  WHEN p_size < 30 THEN ' (' || p_brand || ')' ELSE 'x' END AS c FROM part),
wanted AS (SELECT DISTINCT p_type AS src, p_name AS name FROM part)
SELECT DISTINCT src, c AS dst FROM wanted JOIN cards ON c = name OR starts_with(c, name || ' Phase')
  OR starts_with(c, name || ' (')""",
)
def prefix_link(spark: SparkSession, d: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    shown = (
        F.when(size < 10, name)
        .when(size < 20, F.concat(name, F.lit(" Phase "), size.cast("string")))
        .when(size < 30, F.concat(name, F.lit(" ("), "p_brand", F.lit(")")))
        .otherwise(F.concat(name, F.lit("x")))
    )
    parts = table(spark, d, "part")
    cards = parts.select(shown.alias("card_name")).distinct()
    wanted = parts.select(F.col("p_type").alias("src"), F.col("p_name").alias("name")).distinct()
    return G.prefix_links(wanted, cards)


@query(
    "name_resolution",
    """SELECT DISTINCT p_name AS src, l_orderkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("slug"), F.col("l_orderkey").alias("name")
    )
    names = table(spark, d, "part").select(
        F.col("p_partkey").alias("slug"), F.col("p_name").alias("display_name")
    )
    return G.resolve_names(pairs, names).distinct()


@query(
    "hub_star",
    """SELECT DISTINCT 'Map' AS src, 'HAS_ZONE' AS rel, n_name AS dst, NULL::VARCHAR AS fight_number FROM nation
UNION ALL SELECT DISTINCT n_name, 'HAS_FIGHT', o_orderpriority, month(o_orderdate)::VARCHAR
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def hub_star(spark: SparkSession, d: str) -> DataFrame:
    """A literal hub linked to zones, zones to fights with the number as part of the edge."""
    zones = table(spark, d, "nation").withColumn("hub", F.lit("Map"))
    fights = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(zones, F.col("n_nationkey") == F.col("c_nationkey"))
    )
    star = G.link(edges_of(zones, "hub", "HAS_ZONE", "n_name", "Map", "Zone"))
    slots = G.link_valued(
        edges_of(
            fights, "n_name", "HAS_FIGHT", "o_orderpriority", "Zone", "Fight",
            G.present_props(fight_number=F.month("o_orderdate")),
        ),
        prop="fight_number",
    )
    return star.unionByName(slots).select(
        F.col("src_key").alias("src"), "rel", F.col("dst_key").alias("dst"),
        F.col("props")["fight_number"].alias("fight_number"),
    )


@query(
    "shop_sells",
    """SELECT s_name AS src, 'Part' AS dst_label, l_partkey::VARCHAR AS dst, max(l_extendedprice) AS base_price
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
UNION ALL SELECT s_name, 'Nation', s_nationkey::VARCHAR, s_acctbal FROM supplier""",
)
def shop_sells(spark: SparkSession, d: str) -> DataFrame:
    """SELLS edges to two kinds of targets; the dearest listing sets the price."""
    supplier = table(spark, d, "supplier")
    lines = table(spark, d, "lineitem").join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    parts = lines.withColumn("price", F.col("l_extendedprice"))
    goods = edges_of(
        parts, "s_name", "SELLS", "l_partkey", "Shop", "Part", G.present_props(base_price=F.col("price"))
    )
    homes = edges_of(
        supplier, "s_name", "SELLS", "s_nationkey", "Shop", "Nation",
        G.present_props(base_price=F.col("s_acctbal")),
    )
    both = goods.unionByName(homes)
    price = F.col("props")["base_price"].cast("double")
    ordered = both.withColumn("seq", F.round(price * 100).cast("long") + 100_000_000)
    return G.link_setting(G.link(homes), ordered).select(
        F.col("src_key").alias("src"), "dst_label", F.col("dst_key").alias("dst"),
        F.col("props")["base_price"].cast("double").alias("base_price"),
    )


@query(
    "tribe_membership",
    """SELECT tribe, count(DISTINCT c_custkey) AS n FROM (SELECT c_custkey, unnest(CASE c_mktsegment
  WHEN 'MACHINERY' THEN ['Snowdwellers', 'Shademancers', 'Clunkmasters'] WHEN 'FURNITURE' THEN ['Snowdwellers']
  WHEN 'HOUSEHOLD' THEN ['Shademancers', 'Clunkmasters'] ELSE [] END) AS tribe FROM customer) GROUP BY tribe""",
)
def tribe_membership(spark: SparkSession, d: str) -> DataFrame:
    spelled = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "All")
        .when(F.col("c_mktsegment") == "FURNITURE", "Snowdwellers")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Shademancers, Clunkmasters")
        .otherwise("")
    )
    cards = table(spark, d, "customer").select("c_custkey", spelled.alias("tribe"))
    return N.expand_values(cards, "tribe").groupBy("tribe").agg(
        F.countDistinct("c_custkey").alias("n")
    )


# ---------------------------------------------------------------- documents and urls


def page_entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages as documents with a path, orders as entities with a file name or an address."""
    pages = table(spark, d, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"/(\d+)", 1)
    docs = pages.select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("data/html/"), number, F.lit(".html")).alias("source_file"),
        F.concat(F.lit("https://wiki.example.org/"), number).alias("source_url"),
    )
    entities = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("src"),
        F.when(
            F.col("o_orderstatus") != "P", F.concat(F.col("o_custkey").cast("string"), F.lit(".html"))
        ).alias("filename"),
        F.concat(F.lit("https://wiki.example.org/"), F.col("o_custkey").cast("string")).alias("url"),
        F.col("o_orderstatus").alias("kind"),
    )
    return docs, entities


_PAGES = r"""docs AS (SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS num FROM pages),
by_file AS (SELECT DISTINCT o_orderkey AS src, page_id AS dst FROM orders JOIN docs
  ON num = o_custkey::VARCHAR WHERE o_orderstatus <> 'P')"""


@query("link_suffix", f"WITH {_PAGES} SELECT * FROM by_file")
def link_suffix(spark: SparkSession, d: str) -> DataFrame:
    return G.link_by_suffix(*page_entities(spark, d))


@query(
    "link_fallback",
    f"""WITH {_PAGES} SELECT DISTINCT o_orderkey AS src, page_id AS dst FROM orders JOIN docs
ON num = o_custkey::VARCHAR WHERE o_orderkey NOT IN (SELECT src FROM by_file)""",
)
def link_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs, entities = page_entities(spark, d)
    return G.link_fallback(docs, entities, G.link_by_suffix(docs, entities))


@query(
    "summary_link",
    f"""WITH {_PAGES} SELECT DISTINCT o_orderkey AS src, page_id AS dst FROM orders JOIN
(SELECT 'F' AS k, min(num) AS n FROM docs UNION ALL SELECT 'O', max(num) FROM docs) s ON k = o_orderstatus
JOIN docs ON num = n""",
)
def summary_link(spark: SparkSession, d: str) -> DataFrame:
    docs, entities = page_entities(spark, d)
    pages = docs.agg(F.min("source_file").alias("F"), F.max("source_file").alias("O")).unpivot(
        [], ["F", "O"], "kind", "source_file"
    )
    return G.summary_links(entities, pages, docs)


@query(
    "url_nodes",
    r"""SELECT url, count(DISTINCT (label, key)) AS n FROM (SELECT 'Page' AS label, page_id AS key,
  regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION ALL
  SELECT 'Host', page_id, regexp_extract(url, '^(https?://[^/]+)', 1) FROM pages) GROUP BY url""",
)
def url_nodes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        "page_id",
        F.regexp_replace("url", r"[?#].*$", "").alias("url"),
        F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("host"),
    )
    nodes = nodes_of(pages, "Page", "page_id", url="url").unionByName(
        nodes_of(pages, "Host", "page_id", url="host")
    )
    urls, edges = G.url_nodes(nodes)
    return urls.join(edges.groupBy(F.col("dst_key").alias("url")).agg(F.count("*").alias("n")), "url")


# ---------------------------------------------------------------- inspection


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return (
        nodes_of(table(spark, d, "region"), "Region", "r_regionkey", name="r_name")
        .unionByName(nodes_of(table(spark, d, "nation"), "Nation", "n_nationkey", name="n_name"))
        .unionByName(
            nodes_of(
                table(spark, d, "customer")
                .withColumn("vip", F.expr("if(c_acctbal > 9000, 1, null)"))
                .withColumn("rich", F.col("c_acctbal") > 5000),
                "Customer", "c_custkey", name="c_name", segment="c_mktsegment", vip="vip",
                balance="c_acctbal", rich="rich",
            )
        )
    )


@query(
    "graph_schema",
    """WITH p AS (SELECT 'Region' AS label, r_regionkey AS key, 'name' AS property, 'String' AS kind FROM region
UNION ALL SELECT 'Nation', n_nationkey, 'name', 'String' FROM nation
UNION ALL SELECT 'Customer', c_custkey, 'name', 'String' FROM customer
UNION ALL SELECT 'Customer', c_custkey, 'segment', 'String' FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT 'Customer', c_custkey, 'vip', 'Long' FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'Customer', c_custkey, 'balance', 'Double' FROM customer WHERE c_acctbal IS NOT NULL
UNION ALL SELECT 'Customer', c_custkey, 'rich', 'Boolean' FROM customer WHERE c_acctbal IS NOT NULL),
total AS (SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation
UNION ALL SELECT 'Customer', count(*) FROM customer)
SELECT label, property, count(*) AS n, kind AS type, count(*) = any_value(total.n) AS mandatory
FROM p JOIN total USING (label) GROUP BY label, property, kind""",
)
def graph_schema(spark: SparkSession, d: str) -> DataFrame:
    return G.schema_properties(_all_nodes(spark, d))


@query(
    "graph_schema_text",
    """SELECT 1 AS part, 'Customer {balance: Double, name: String, rich: Boolean, segment: String' ||
  CASE WHEN max(c_acctbal) > 9000 THEN ', vip: Long' ELSE '' END || '}'
  AS line FROM customer UNION ALL SELECT 1, 'Nation {name: String}' UNION ALL SELECT 1, 'Region {name: String}'
UNION ALL SELECT 2, '(:Customer)-[:LIVES_IN]->(:Nation)' UNION ALL SELECT 2, '(:Nation)-[:PART_OF]->(:Region)'""",
)
def graph_schema_text(spark: SparkSession, d: str) -> DataFrame:
    edges = edges_of(
        table(spark, d, "nation"), "n_nationkey", "PART_OF", "n_regionkey", "Nation", "Region"
    ).unionByName(
        edges_of(
            table(spark, d, "customer"), "c_custkey", "LIVES_IN", "c_nationkey", "Customer", "Nation"
        )
    )
    return G.schema_text(_all_nodes(spark, d), edges)


@query(
    "degree_topn",
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT p_partkey AS vertex, count(src) AS fan_in FROM part LEFT JOIN e ON dst = p_partkey
GROUP BY p_partkey ORDER BY fan_in DESC, vertex LIMIT 20""",
)
def degree_topn(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")
    )
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("vertex"))
    out = G.degrees(parts, edges).select("vertex", "fan_in")
    return global_top_k(out, 20, "fan_in", ["vertex"])


@query(
    "degree_all",
    """WITH e AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
o AS (SELECT src, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT c_custkey AS vertex, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM customer
LEFT JOIN o ON src = c_custkey LEFT JOIN i ON dst = c_custkey""",
)
def degree_all(spark: SparkSession, d: str) -> DataFrame:
    edges = _bought(spark, d).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    return G.degrees(table(spark, d, "customer").select(F.col("c_custkey").alias("vertex")), edges)


# ---------------------------------------------------------------- entity assembly


@query(
    "tribe_enrichment",
    """SELECT c_name AS name, CASE WHEN s_name IS NOT NULL THEN CASE WHEN s_acctbal > 0 THEN 'All' END
  WHEN c_nationkey < 12 THEN 'Snowdwellers' END AS tribe FROM customer
LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def tribe_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Lookup from customers overridden by one from suppliers; unknown tribes are unset."""
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    first = customer.select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") < 12, "Snowdwellers").otherwise("Nobody").alias("tribe"),
    )
    named = supplier.join(customer, F.col("s_suppkey") == F.col("c_custkey"))
    second = named.select(
        F.col("c_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, "All").otherwise("Unknown").alias("tribe"),
    )
    return N.enrich_tribes(customer.select(F.col("c_name").alias("name")), first, second)


@query(
    "value_expansion",
    """SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'F' THEN ['Snowdwellers', 'Shademancers', 'Clunkmasters']
  WHEN 'O' THEN ['A', 'B'] ELSE [] END) AS tribe FROM orders""",
)
def value_expansion(spark: SparkSession, d: str) -> DataFrame:
    spelled = (
        F.when(F.col("o_orderstatus") == "F", "All")
        .when(F.col("o_orderstatus") == "O", " A ,B, ")
        .otherwise(" ")
    )
    rows = table(spark, d, "orders").select("o_orderkey", spelled.alias("tribe"))
    return N.expand_values(rows, "tribe")


@query(
    "default_drops",
    """WITH t AS (SELECT l_partkey AS name, max(l_quantity)::INT AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT name, amount FROM t UNION ALL SELECT p_partkey, CASE WHEN p_size < 25 THEN 13 ELSE 27 END FROM part
WHERE p_partkey NOT IN (SELECT name FROM t)""",
)
def default_drops(spark: SparkSession, d: str) -> DataFrame:
    """Table rows first, rule rows only for names the table lacks."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(
        F.col("l_partkey").alias("name")
    ).agg(F.max("l_quantity").cast("int").alias("amount"))
    parts = table(spark, d, "part")
    small = parts.where("p_size < 25").select(F.col("p_partkey").alias("name"))
    large = parts.where("p_size >= 25").select(F.col("p_partkey").alias("name"))
    return N.with_defaults(rows, N.boss_defaults(large, small))


@query(
    "card_list",
    """SELECT DISTINCT p_type AS type, p_name AS name, 'https://wiki.example.org/' || replace(p_name, ' ', '_') AS url
FROM part WHERE p_type <> 'PROMO'""",
)
def card_list(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.functions.text import page_url

    schema = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name")).distinct()
    return N.card_list(schema, page_url(F.col("name"), "https://wiki.example.org/"), ["PROMO"])


@query(
    "map_merge",
    """SELECT n_name AS name, coalesce(max(s_name), max(c_name)) AS url FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    first = nation.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    second = nation.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return N.merge_maps(
        first.groupBy(F.col("n_name").alias("name")).agg(F.max("c_name").alias("url")),
        second.groupBy(F.col("n_name").alias("name")).agg(F.max("s_name").alias("url")),
        "name",
        "url",
    )


@query(
    "leader_naming",
    """SELECT card_name, c_custkey FROM (SELECT c_custkey, c_acctbal, c_mktsegment || ' Leader #' ||
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS card_name FROM customer) WHERE c_acctbal > 0""",
)
def leader_naming(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("tribe"),
        F.col("c_custkey").alias("row_no"),
        F.when(F.col("c_acctbal") > 0, 5).otherwise(2).alias("n_cells"),
        "c_custkey",
    )
    return N.number_leaders(rows).select("card_name", "c_custkey")


@query(
    "query_sample",
    """SELECT p_name AS item, row_number() OVER (ORDER BY md5('42:' || p_name), p_name)::INT AS query_id
FROM (SELECT DISTINCT p_name FROM part) QUALIFY query_id <= 20""",
)
def query_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty drawn part names."""
    return N.sample_queries(table(spark, d, "part").select(F.col("p_name").alias("item")).distinct(), 20)


@query(
    "slot_explosion",
    """SELECT DISTINCT n_name AS zone, c_custkey AS fight_number, f AS name, CASE WHEN p_type IS NULL
  THEN replace(f, ' ', '_') ELSE p_type END AS slug FROM (SELECT n_name, c_custkey, unnest([c_mktsegment, c_name, 'small ring'])
  AS f FROM customer JOIN nation ON n_nationkey = c_nationkey) LEFT JOIN
  (SELECT p_name, max(p_type) AS p_type FROM part GROUP BY 1) ON p_name = f""",
)
def slot_explosion(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    slots = slots.select(
        F.col("n_name").alias("zone"),
        F.col("c_custkey").alias("fight_number"),
        F.array("c_mktsegment", "c_name", F.lit("small ring")).alias("possible_fights"),
    )
    slugs = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.max("p_type").alias("slug")
    )
    return N.explode_slots(slots, slugs).select("zone", "fight_number", "name", "slug")
