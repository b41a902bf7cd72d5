"""Graph neighbours attached to retrieval hits, one row per hit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import hot_join


@dataclass(frozen=True)
class Relation:
    """Column filled from one owner kind over one relation; ``single`` keeps the first key."""

    column: str
    owner: str
    rel: str
    single: bool = False
    value: str | None = None


# Owner kinds of a document and the neighbour columns of the full traversal.
OWNER_KINDS = ["Card", "Bell", "Charm", "Fight", "Crown", "Stat", "Zone", "MapEvent", "Shop"]
FULL = [
    Relation("tribe", "Card", "BELONGS_TO_TRIBE", single=True),
    Relation("cardtype", "Card", "HAS_CARD_TYPE", single=True),
    Relation("keywords", "Card", "HAS_KEYWORD"),
    Relation("stats", "Card", "HAS_STAT"),
    Relation("summons", "Card", "SUMMONS"),
    Relation("transforms_into", "Card", "TRANSFORMS_INTO"),
    Relation("can_recruit_as", "Card", "CAN_BE_RECRUITED_AS"),
    Relation("fight_enemies", "Fight", "FEATURES_ENEMY"),
    Relation("bell_charms", "Bell", "APPLIES_CHARM"),
    Relation("bell_adds_cards", "Bell", "ADDS_TO_FIGHT"),
    Relation("bell_grants_keywords", "Bell", "GRANTS_KEYWORD"),
]
CARD_ONLY: list[Relation] = []
WITH_STATS = [
    Relation("tribe", "Card", "BELONGS_TO_TRIBE", single=True),
    Relation("cardtype", "Card", "HAS_CARD_TYPE", single=True),
    Relation("keywords", "Card", "HAS_KEYWORD"),
    Relation("stats", "Card", "HAS_STAT", value="value"),
]
PRESETS = {"card_only": CARD_ONLY, "full": FULL, "with_stats": WITH_STATS}


def owners(hits: DataFrame, edges: DataFrame, kinds: Sequence[str] = OWNER_KINDS) -> DataFrame:
    """(doc_id, owner_label, owner_key): the first owner of each kind of every hit document."""
    wanted = hits.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    held = edges.where((F.col("rel") == "HAS_DOCUMENT") & F.col("src_label").isin(list(kinds)))
    return (
        held.withColumnRenamed("dst_key", "doc_id")
        .join(wanted, "doc_id", "left_semi")
        .groupBy("doc_id", F.col("src_label").alias("owner_label"))
        .agg(F.min("src_key").alias("owner_key"))
    )


def enrich_hits(
    hits: DataFrame,
    edges: DataFrame,
    relations: Sequence[Relation] = FULL,
    kinds: Sequence[str] = OWNER_KINDS,
) -> DataFrame:
    """Hits with their owners and neighbour columns.

    Every relation is aggregated once per distinct owner, however many hits it owns, so columns
    never multiply each other; only edges of owners that were hit are read past the first join.
    """
    owned = owners(hits, edges, kinds)
    by_kind = owned.groupBy("doc_id").agg(
        *[
            F.max(F.when(F.col("owner_label") == k, F.col("owner_key"))).alias(k.lower())
            for k in kinds
        ]
    )
    out = hits.withColumn("_doc", F.col("doc_id").cast("string")).join(
        by_kind.withColumnRenamed("doc_id", "_doc"), "_doc", "left"
    )
    asked_kinds = sorted({r.owner for r in relations} & set(kinds))
    for owner in asked_kinds:
        own = [r for r in relations if r.owner == owner]
        near = _neighbours(owned.where(F.col("owner_label") == owner), edges, owner, own)
        # Many hits may share an owner: they are dealt by document too.
        out = hot_join(out, near, [owner.lower()], "_doc", "left")
    for r in relations:
        if r.owner not in asked_kinds:
            out = out.withColumn(r.column, F.lit(None).cast("string" if r.single else "array<string>"))
        if not r.single:
            out = out.withColumn(r.column, F.coalesce(r.column, F.array().cast(out.schema[r.column].dataType)))
    return out.drop("_doc").select(*hits.columns, *(k.lower() for k in kinds), *(r.column for r in relations))


def _neighbours(owned: DataFrame, edges: DataFrame, owner: str, relations: Sequence[Relation]) -> DataFrame:
    """``<owner kind>`` and a column per relation, one row for each distinct owner."""
    wanted = owned.select("owner_key").distinct()
    near = edges.where((F.col("src_label") == owner) & F.col("rel").isin([r.rel for r in relations])).select(
        F.col("src_key").alias("owner_key"), "rel", "dst_key", "props"
    )
    near = near.join(wanted, "owner_key", "left_semi")
    columns = []
    for r in relations:
        this = F.col("rel") == r.rel
        if r.single:
            column = F.min(F.when(this, F.col("dst_key")))
        elif r.value:
            pair = F.struct(F.col("dst_key").alias("name"), F.col("props")[r.value].alias("value"))
            column = F.array_sort(F.collect_list(F.when(this, pair)))
        else:
            column = F.array_sort(F.collect_list(F.when(this, F.col("dst_key"))))
        columns.append(column.alias(r.column))
    return near.groupBy(F.col("owner_key").alias(owner.lower())).agg(*columns)
