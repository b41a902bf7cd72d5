"""Property graph as two tables, with the upsert and link rules of an entity graph.

nodes(label, key, labels array, props map<string,string>)
edges(src_label, src_key, rel, dst_label, dst_key, props map<string,string>)

All node tables are complete before edges are linked, so link steps need no order.
Group-wise choices use max_by / min_by aggregates, which combine map-side and therefore
do not care how many rows share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import WHOLE_WORD, keyword_forms, other_stats
from quillgraph.operators.skew import hot_join
from quillgraph.operators.substring import contains_pairs, matched_pairs

END_POINTS = ["src_label", "src_key", "rel", "dst_label", "dst_key"]


def no_props() -> Column:
    return F.create_map().cast("map<string,string>")


def present_props(**columns: Column) -> Column:
    """Map of the non-null values; absent and null mean the same."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


# ---------------------------------------------------------------- nodes


def upsert_nodes(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], written: Sequence[str]
) -> DataFrame:
    """Create by key or overwrite the written columns (nulls included); last ``seq`` wins."""
    latest = incoming.groupBy(*key).agg(F.max_by(F.struct(*written), "seq").alias("new"))
    kept = [c for c in existing.columns if c not in (*key, *written)]
    given = F.col("new").isNotNull()
    return existing.join(latest, list(key), "full_outer").select(
        *key,
        *[F.when(given, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in written],
        *kept,
    )


def merge_properties(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``props`` of incoming rows laid over the stored ones, property by property.

    Rows are (key..., seq, props); key columns may be null (a card without phase is keyed by
    name only). Only non-null values overwrite.
    """
    stored = existing.select(*key, F.lit(-1).cast("long").alias("seq"), "props")
    given = incoming.select(*key, F.col("seq").cast("long").alias("seq"), "props")
    cells = (
        stored.unionByName(given)
        .select(*key, "seq", F.explode_outer("props").alias("name", "value"))
        .where(F.col("value").isNotNull() | F.col("name").isNull())
        .groupBy(*key, "name")
        .agg(F.max_by("value", "seq").alias("value"))
    )
    entries = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    return cells.groupBy(*key).agg(F.map_from_entries(F.array_sort(entries)).alias("props"))


def split_key_regimes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards keyed by name alone and cards keyed by (name, phase)."""
    return rows.where(F.col("phase").isNull()), rows.where(F.col("phase").isNotNull())


def dedup_documents(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First row (by ``seq``) of every distinct text; texts already stored are left out.

    Texts meet as digests, so the shuffle carries no text.
    """
    digest = F.sha2(F.col("text"), 256)
    firsts = docs.groupBy(digest.alias("digest")).agg(F.min("seq").alias("seq"))
    if existing is not None:
        stored = existing.select(digest.alias("digest")).distinct()
        firsts = firsts.join(stored, "digest", "left_anti")
    return docs.join(firsts.select("seq"), "seq", "left_semi")


def add_label(nodes: DataFrame, label: str, added: str, excluded: Sequence[str]) -> DataFrame:
    """Second label on all nodes of a label whose key is not excluded."""
    wanted = F.array_contains("labels", label) & ~F.col("key").isin(*excluded)
    return nodes.withColumn(
        "labels",
        F.when(wanted, F.array_union("labels", F.array(F.lit(added)))).otherwise(F.col("labels")),
    )


def upsert_labelled(nodes: DataFrame, incoming: DataFrame, label: str) -> DataFrame:
    """Upsert by name among all nodes carrying the label, whatever their first label is.

    ``incoming(key, seq, props)``: its properties overwrite those of a matching node.
    """
    latest = incoming.groupBy("key").agg(F.max_by("props", "seq").alias("new_props"))
    carrying = nodes.where(F.array_contains("labels", label))
    others = nodes.where(~F.array_contains("labels", label))
    names = F.coalesce(F.col("new_props"), no_props())
    kept = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys(names), k))
    merged = carrying.join(latest, "key", "full_outer").select(
        F.coalesce("label", F.lit(label)).alias("label"),
        "key",
        F.coalesce("labels", F.array(F.lit(label))).alias("labels"),
        F.map_concat(F.coalesce(kept, no_props()), names).alias("props"),
    )
    return others.select("label", "key", "labels", "props").unionByName(merged)


def url_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct non-null urls over all nodes, and one HAS_LINK edge from each node."""
    linked = nodes.select("label", "key", F.col("props")["url"].alias("url")).where(
        F.col("url").isNotNull()
    )
    urls = linked.select("url").distinct()
    edges = (
        linked.select("label", "key", "url")
        .distinct()
        .select(
            F.col("label").alias("src_label"),
            F.col("key").alias("src_key"),
            F.lit("HAS_LINK").alias("rel"),
            F.lit("URL").alias("dst_label"),
            F.col("url").alias("dst_key"),
            no_props().alias("props"),
        )
    )
    return urls, edges


# ---------------------------------------------------------------- edges


def edge_rows(
    pairs: DataFrame,
    src_label: str,
    rel: str,
    dst_label: str,
    props: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Edge rows of ``pairs(src, dst)``, with further columns kept when named."""
    return pairs.select(
        F.lit(src_label).alias("src_label"),
        F.col("src").cast("string").alias("src_key"),
        F.lit(rel).alias("rel"),
        F.lit(dst_label).alias("dst_label"),
        F.col("dst").cast("string").alias("dst_key"),
        (no_props() if props is None else props).alias("props"),
        *keep,
    )


def with_end_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist; the others vanish silently."""
    ids = nodes.select("label", "key")
    src = ids.select(F.col("label").alias("src_label"), F.col("key").alias("src_key"))
    dst = ids.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"))
    return edges.join(src, ["src_label", "src_key"], "left_semi").join(
        dst, ["dst_label", "dst_key"], "left_semi"
    )


def link(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edge upsert: one edge per (src, rel, dst)."""
    rows = with_end_points(edges, nodes) if nodes is not None else edges
    return rows.groupBy(*END_POINTS).agg(F.first("props").alias("props"))


def link_valued(edges: DataFrame, nodes: DataFrame | None = None, prop: str = "value") -> DataFrame:
    """Edge upsert whose property belongs to the key: each distinct value is an edge."""
    rows = with_end_points(edges, nodes) if nodes is not None else edges
    value = F.col("props")[prop].alias(prop)
    return (
        rows.select(*END_POINTS, value)
        .distinct()
        .select(*END_POINTS, present_props(**{prop: F.col(prop)}).alias("props"))
    )


def link_unless_any(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """Existing edges plus new ones between pairs that have no edge of that type yet."""
    fresh = link(edges).join(existing.select(*END_POINTS), END_POINTS, "left_anti")
    return existing.select(*END_POINTS, "props").unionByName(fresh)


def link_setting(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge upsert that sets single properties; all others of a stored edge stay.

    Of several values for one property the last ``seq`` wins, then the larger value; given ones
    win over stored ones.
    """
    stored = existing.select(*END_POINTS, "props", F.lit(-1).cast("long").alias("seq"))
    given = edges.select(*END_POINTS, "props", F.col("seq").cast("long").alias("seq"))
    entries = stored.unionByName(given).select(*END_POINTS, "seq", F.explode_outer("props").alias("name", "value"))
    # The struct holds the value once; a task sorts rows of this width.
    last = F.max(F.struct("seq", "value"))["value"]
    latest = entries.groupBy(*END_POINTS, "name").agg(last.alias("value"))
    # One entry per property name; an edge without any has a null name alone.
    pairs = F.filter(F.collect_list(F.struct("name", "value")), lambda e: e["name"].isNotNull())
    return latest.groupBy(*END_POINTS).agg(F.map_from_entries(pairs).alias("props"))


def link_counts(matched: DataFrame, linked: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: pairs matched, edges linked and edges that are new."""
    known = existing.select(*END_POINTS, F.lit(1).alias("known"))
    pairs = matched.select(F.lit(1).alias("pair"), F.lit(0).alias("edge"), F.lit(0).alias("new"))
    marked = linked.join(known, END_POINTS, "left").select(
        F.lit(0).alias("pair"),
        F.lit(1).alias("edge"),
        F.when(F.col("known").isNull(), 1).otherwise(0).alias("new"),
    )
    return pairs.unionByName(marked).agg(
        F.sum("pair").alias("matched_pairs"),
        F.sum("edge").alias("edges"),
        F.sum("new").alias("new_edges"),
    )


def successor_pairs(cards: DataFrame) -> DataFrame:
    """Phase n -> n + 1 within a base name: (src, dst) card keys."""
    steps = cards.where("phase > 0 and phase < total_phases").select(
        "base_name", (F.col("phase") + 1).alias("phase"), F.col("card").alias("src")
    )
    nxt = cards.select("base_name", "phase", F.col("card").alias("dst"))
    return steps.join(nxt, ["base_name", "phase"]).select("src", "dst").distinct()


def rule_links(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Curated links: ``rules(src_label, src_key, rel, dst_label, targets array[, props map])``."""
    props = F.col("props") if "props" in rules.columns else no_props()
    rows = rules.select(
        "src_label",
        "src_key",
        "rel",
        "dst_label",
        F.explode("targets").alias("dst_key"),
        props.alias("props"),
    )
    return link(rows, nodes)


def flag_links(sources: DataFrame, targets: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Each source linked to every target that carries the flag it reaches for: (src, dst).

    ``sources(src, flag)``, ``targets(dst, <flag>, ...)`` with a boolean column per flag. Every
    target offers its own flags, so the match is an equi join, spread also where most targets
    carry one flag.
    """
    carried = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))
    offered = targets.select("dst", F.explode(carried).alias("flag"))
    return hot_join(offered, sources.select("src", "flag"), ["flag"], "dst").select("src", "dst")


def mention_links(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names found (any case) in the joined text parts: (src, dst).

    ``texts(src, text)``, ``names(dst)``.
    """
    found = contains_pairs(
        texts.select(F.col("src").alias("text_id"), "text"),
        names.select(F.col("dst").alias("needle_id"), F.col("dst").alias("needle")).distinct(),
        ignore_case=True,
    )
    return found.select(F.col("text_id").alias("src"), F.col("needle_id").alias("dst")).distinct()


def keyword_links(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Mentions (any case) plus inflected forms of one-word keywords as whole words: (src, dst).

    Both kinds of needles are looked for in the same pass over the texts.
    """
    names = keywords.select(F.col("dst").alias("needle_id"))
    mentions = names.select("needle_id", F.lower("needle_id").alias("needle"), F.lit(False).alias("whole"))
    forms = names.select("needle_id", F.explode(keyword_forms(F.col("needle_id"))).alias("needle"))
    forms = forms.where(F.col("needle").rlike(WHOLE_WORD)).withColumn("whole", F.lit(True))
    lowered = texts.select(F.col("src").alias("text_id"), F.lower("text").alias("text"))
    found = matched_pairs(lowered, mentions.unionByName(forms))
    return found.select(F.col("text_id").alias("src"), F.col("needle_id").alias("dst"))


def stat_edges(cards: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Non-null numeric columns unpivoted to (src, dst, value); ``columns`` maps name to stat."""
    renamed = cards.select("src", *[F.col(c).alias(stat) for c, stat in columns.items()])
    rows = renamed.unpivot(["src"], list(columns.values()), "dst", "value")
    return rows.where(F.col("value").isNotNull())


def card_stat_edges(cards: DataFrame, stats: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All stats of cards as (src, dst, value), the value null where a text only mentions the stat.

    ``cards(src, other_stats, ability, <columns>)``, ``stats(dst)``: the stats that exist. Numeric
    columns and parsed free text give values; a mention adds an edge only between pairs without one.
    """
    written_out = cards.select("src", F.explode(other_stats(F.col("other_stats"))).alias("s")).select(
        "src", F.col("s.name").alias("dst"), F.col("s.value").cast("double").alias("value")
    )
    numbers = stat_edges(cards, columns).select("src", "dst", F.col("value").cast("double").alias("value"))
    valued = numbers.unionByName(written_out).join(stats.select("dst").distinct(), "dst", "left_semi")
    valued = valued.select("src", "dst", "value").distinct()
    mentioned = mention_links(cards.select("src", F.col("ability").alias("text")), stats)
    bare = mentioned.join(valued, ["src", "dst"], "left_anti").withColumn("value", F.lit(None).cast("double"))
    return valued.unionByName(bare)


def prefix_links(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """Wanted names matched to equal, `` Phase...`` or `` (...`` card names: (src, dst).

    Every card offers the names it may be asked by, so the match is an equi join.
    """
    name = F.col("card_name")
    cut = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.when(
            F.substring(name, i, F.lit(2)).isin(" (")
            | (F.substring(name, i, F.lit(6)) == " Phase"),
            F.substring(name, F.lit(1), i - 1),
        ),
    )
    asked_by = F.array_union(F.array(name), F.array_compact(cut))
    offered = cards.select("card_name", F.explode(asked_by).alias("name"))
    return (
        wanted.select("src", "name")
        .join(offered, "name")
        .select("src", F.col("card_name").alias("dst"))
        .distinct()
    )


def resolve_names(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace page slugs by every display name they stand for: (src, name)."""
    return pairs.join(mapping, "slug").select(F.col("display_name").alias("src"), "name")


# ---------------------------------------------------------------- documents


def file_base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def link_by_suffix(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities to documents whose path ends with ``/`` + file name: (src, dst).

    ``docs(doc_id, source_file)``, ``entities(src, filename)``; equi join on the base name.
    """
    named = docs.where(F.col("source_file").contains("/")).select(
        F.col("doc_id").alias("dst"), file_base(F.col("source_file")).alias("filename")
    )
    return entities.select("src", "filename").join(named, "filename").select("src", "dst").distinct()


def link_fallback(docs: DataFrame, entities: DataFrame, linked: DataFrame) -> DataFrame:
    """Entities without a document joined on url = source_url: (src, dst)."""
    missing = entities.join(linked.select("src").distinct(), "src", "left_anti")
    by_url = docs.select(F.col("doc_id").alias("dst"), F.col("source_url").alias("url"))
    return missing.select("src", "url").join(by_url, "url").select("src", "dst").distinct()


def summary_links(entities: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Every entity of a kind to the document of its summary page: (src, dst).

    ``entities(src, kind)``, ``pages(kind, source_file)``; two equi joins, the second spread over
    tasks because there are few kinds.
    """
    targets = pages.join(docs.select("doc_id", "source_file"), "source_file").select("kind", F.col("doc_id").alias("dst"))
    return hot_join(entities.select("src", "kind"), targets, ["kind"], "src").select("src", "dst").distinct()


# ---------------------------------------------------------------- inspection


# Kinds of values as bits: the kinds seen under a property join to one by bitwise or.
_BOOLEAN, _LONG, _DOUBLE, _STRING = 1, 2, 4, 8


def _kind_bit(value: Column) -> Column:
    return (
        F.when(value.isin("true", "false"), _BOOLEAN)
        .when(value.rlike(r"^[+-]?\d{1,18}$"), _LONG)
        .when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), _DOUBLE)
        .otherwise(_STRING)
    )


def _kind_name(bits: Column) -> Column:
    """The smallest type that holds all kinds seen: whole numbers are doubles, all else is text."""
    return (
        F.when(bits == _BOOLEAN, "Boolean")
        .when(bits == _LONG, "Long")
        .when(bits.isin(_DOUBLE, _LONG | _DOUBLE), "Double")
        .otherwise("String")
    )


def schema_properties(nodes: DataFrame) -> DataFrame:
    """(label, property, n, type, mandatory): nodes that have it, the type of all its values, and
    whether every node of the label has it.

    Types join by an aggregate that combines before the shuffle.
    """
    totals = nodes.groupBy("label").agg(F.count("*").alias("total"))
    values = nodes.select("label", F.explode("props").alias("property", "value"))
    seen = values.groupBy("label", "property").agg(
        F.count("*").alias("n"), F.bit_or(_kind_bit(F.col("value"))).alias("bits")
    )
    return seen.join(totals, "label").select(
        "label", "property", "n", _kind_name(F.col("bits")).alias("type"), (F.col("n") == F.col("total")).alias("mandatory")
    )


def schema_patterns(edges: DataFrame) -> DataFrame:
    """Distinct (start label, relation, end label)."""
    return edges.select("src_label", "rel", "dst_label").distinct()


def schema_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line per label and per pattern, as given to a query writer."""
    labels = schema_properties(nodes).groupBy("label").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("property", F.lit(": "), "type"))), ", ").alias("props")
    )
    lines = labels.select(
        F.lit(1).alias("part"), F.concat("label", F.lit(" {"), "props", F.lit("}")).alias("line")
    )
    arrows = schema_patterns(edges).select(
        F.lit(2).alias("part"),
        F.concat(
            F.lit("(:"), "src_label", F.lit(")-[:"), "rel", F.lit("]->(:"), "dst_label", F.lit(")")
        ).alias("line"),
    )
    return lines.unionByName(arrows).orderBy("part", "line")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct fan-in and fan-out of every vertex, zero included; ``edges(src, dst)``."""
    pairs = edges.select("src", "dst").distinct()
    fan_in = pairs.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("fan_in"))
    fan_out = pairs.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("fan_out"))
    return (
        vertices.select("vertex")
        .join(fan_in, "vertex", "left")
        .join(fan_out, "vertex", "left")
        .na.fill(0, ["fan_in", "fan_out"])
    )


def check_partition(membership: DataFrame, hierarchy: DataFrame, abstract: DataFrame) -> DataFrame:
    """Rule breaches: direct members of abstract types, members of several sibling types.

    ``membership(type, member)``, ``hierarchy(child, parent)``, ``abstract(type)``.
    """
    direct = membership.join(abstract, "type", "left_semi").select(
        F.lit("direct member").alias("breach"), "type", "member"
    )
    shared = (
        membership.join(hierarchy.withColumnRenamed("child", "type"), "type")
        .groupBy("parent", "member")
        .agg(F.countDistinct("type").alias("n"))
        .where("n > 1")
        .select(F.lit("several subtypes").alias("breach"), F.col("parent").alias("type"), "member")
    )
    return direct.unionByName(shared)
