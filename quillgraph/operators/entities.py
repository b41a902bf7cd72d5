"""Assembly of entity tables: phases, enrichment, defaults, unions, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import variant_type
from quillgraph.operators.numbering import numbered_within

# Exclusive tribes and the word that stands for all of them.
TRIBES = ["Snowdwellers", "Shademancers", "Clunkmasters"]
EVERY_TRIBE = "All"

# Default drop amounts for bosses missing from the drops table.
MINIBOSS_DROP = 13
NAMED_BOSS_DROP = 13
OTHER_BOSS_DROP = 27
NAMED_BOSSES = ["Bam", "Boozle"]
BOSSES_WITHOUT_DROP = ["Bamboozle"]

# Type hierarchy (child, parent) and the renamed schema key.
CARD_TYPES = [
    "leaders", "pets", "companions", "shades", "clunkers", "items", "enemies",
    "non_boss_enemies", "enemy_clunkers", "minibosses", "bosses",
]
TYPE_PARENTS = [
    ("pets", "companions"),
    ("non_boss_enemies", "enemies"),
    ("enemy_clunkers", "non_boss_enemies"),
    ("enemy_clunkers", "clunkers"),
    ("minibosses", "enemies"),
    ("bosses", "enemies"),
]
SCHEMA_KEY_RENAMES = {"enemies": "non_boss_enemies"}


def assign_phases(
    rows: DataFrame, overrides: DataFrame | None = None, variants: Sequence[str] = ()
) -> DataFrame:
    """Add phase, total_phases and base_name to infobox rows.

    ``rows(page, pos, card_name, base, card_type, image_phase)``; the order inside a base name
    is the override position, then the image phase (none counts 1), then the place on the page.
    ``overrides(base, card_name, place)``.
    """
    group = Window.partitionBy("page", "base")
    if overrides is not None:
        rows = rows.join(overrides, ["base", "card_name"], "left")
        known = overrides.select("base", F.lit(True).alias("overridden")).distinct()
        rows = rows.join(known, "base", "left")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("int")).withColumn(
            "overridden", F.lit(None).cast("boolean")
        )
    image = F.when(F.coalesce("image_phase", F.lit(0)) == 0, 1).otherwise(F.col("image_phase"))
    by_override = F.coalesce("place", F.lit(999))
    place = F.when(F.col("overridden"), by_override).otherwise(image)
    size = F.count("*").over(group)
    is_variant = F.col("base").isin(list(variants)) if variants else F.lit(False)
    phased = (size > 1) & ~is_variant
    number = F.row_number().over(group.orderBy("_place", "pos"))
    return (
        rows.withColumn("_place", place)
        .withColumn("phase", F.when(phased, number))
        .withColumn("total_phases", F.when(phased, size))
        .withColumn("base_name", F.when(phased, F.col("base")))
        .withColumn(
            "card_type",
            F.when(
                (size > 1) & is_variant, variant_type(F.col("card_name"), F.col("card_type"))
            ).otherwise(F.col("card_type")),
        )
        .drop("_place", "place", "overridden")
    )


def enrich_tribes(
    cards: DataFrame, first: DataFrame, second: DataFrame, accepted: Sequence[str] = ()
) -> DataFrame:
    """Tribe by name, the second lookup overriding the first; unknown values are unset."""
    accepted = list(accepted) or [*TRIBES, EVERY_TRIBE]
    lookup = (
        first.select("name", F.col("tribe"), F.lit(1).alias("priority"))
        .unionByName(second.select("name", F.col("tribe"), F.lit(2).alias("priority")))
        .groupBy("name")
        .agg(F.max_by("tribe", "priority").alias("tribe"))
    )
    return cards.join(lookup, "name", "left").withColumn(
        "tribe", F.when(F.col("tribe").isin(accepted), F.col("tribe"))
    )


def expand_values(
    df: DataFrame, column: str, everything: Sequence[str] = TRIBES, word: str = EVERY_TRIBE
) -> DataFrame:
    """One row per value: the special word gives all values, commas split, blank gives none."""
    parts = F.filter(F.transform(F.split(F.col(column), ","), lambda p: F.trim(p)), lambda p: p != "")
    every = F.array(*[F.lit(v) for v in everything])
    values = F.when(F.trim(column) == word, every).otherwise(parts)
    return df.withColumn("_values", values).select(
        *[c for c in df.columns if c != column], F.explode("_values").alias(column)
    )


def boss_defaults(bosses: DataFrame, minibosses: DataFrame) -> DataFrame:
    """Rule rows (name, amount): minibosses first, then bosses that drop anything."""
    name = F.col("name").cast("string")
    amount = F.when(name.isin(NAMED_BOSSES), NAMED_BOSS_DROP).otherwise(OTHER_BOSS_DROP)
    small = minibosses.select("name", F.lit(MINIBOSS_DROP).alias("amount"), F.lit(1).alias("turn"))
    large = bosses.where(~name.isin(BOSSES_WITHOUT_DROP)).select(
        "name", amount.alias("amount"), F.lit(2).alias("turn")
    )
    rows = small.unionByName(large)
    return rows.groupBy("name").agg(F.min_by("amount", "turn").alias("amount"))


def with_defaults(rows: DataFrame, defaults: DataFrame, key: str = "name") -> DataFrame:
    """Rows first, then default rows for keys no row has."""
    return rows.unionByName(
        defaults.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns)
    )


def card_list(schema: DataFrame, base: Column, excluded: Sequence[str] = ("leaders",)) -> DataFrame:
    """(type, name, url) for every member of a type schema, excluded types left out.

    ``schema(type, members array)`` or, one row per member, ``schema(type, name)``.
    """
    name = F.explode("members").alias("name") if "members" in schema.columns else F.col("name")
    return schema.where(~F.col("type").isin(list(excluded))).select("type", name).withColumn("url", base)


def merge_maps(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value tables merged, the second one winning."""
    both = first.select(key, value, F.lit(1).alias("_turn")).unionByName(
        second.select(key, value, F.lit(2).alias("_turn"))
    )
    return both.groupBy(key).agg(F.max_by(value, "_turn").alias(value))


def number_leaders(rows: DataFrame, min_cells: int = 5) -> DataFrame:
    """``<tribe> Leader #i`` numbered per tribe before short rows are dropped.

    ``rows(tribe, row_no, n_cells, ...)``.
    """
    placed = numbered_within(rows, ["tribe"], ["row_no"], "_number")
    named = placed.withColumn(
        "card_name", F.concat("tribe", F.lit(" Leader #"), F.col("_number").cast("string"))
    ).drop("_number")
    return named.where(F.col("n_cells") >= min_cells)


def sample_queries(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, repeatable by seed (digests of ``seed:item``), numbered from 1."""
    drawn = (
        items.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), "item")))
        .orderBy("_draw", "item")
        .limit(k)
    )
    number = F.row_number().over(Window.orderBy("_draw", "item"))
    return drawn.withColumn("query_id", number).drop("_draw")


def explode_slots(slots: DataFrame, slugs: DataFrame) -> DataFrame:
    """One row per possible fight of a slot, with the page slug or the name with ``_``."""
    return (
        slots.select("zone", "fight_number", F.explode("possible_fights").alias("name"))
        .join(slugs, "name", "left")
        .withColumn("slug", F.coalesce("slug", F.regexp_replace("name", " ", "_")))
    )
