"""Curated link rules as tables for :func:`quillgraph.operators.graph.rule_links`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Curated effects of bells, by relation: (relation, target label, {bell: targets}).
BELL_RULES = [
    ("GRANTS_KEYWORD", "Keyword", {"Bell of Death": ["Injured"], "Noomlin Sun Bell": ["Noomlin"]}),
    ("AFFECTS_KEYWORD", "Keyword", {"Breakfast Sun Bell": ["Consume"]}),
    (
        "MODIFIES_STAT",
        "Stat",
        {
            "Battle Bell": ["Attack"],
            "Frenzy Bell": ["Frenzy"],
            "Heart Bell": ["Health"],
            "Blood Bell": ["Health"],
            "Sun Bell of Health": ["Health"],
            "Sun Bell of Strength": ["Attack"],
        },
    ),
    (
        "AFFECTS_BLING",
        "Bling",
        {
            "Blingsack Bell": ["Bling"],
            "Gold Blade Bell": ["Bling"],
            "Blingsnail Bell": ["Bling"],
        },
    ),
    ("ADDS_TO_FIGHT", "Card", {"Gobbler Bell": ["Gobbler"]}),
    (
        "TARGETS_CARD_TYPE",
        "CardType",
        {
            "Bombskull Bell": ["clunkers"],
            "Dread Bell": ["non_boss_enemies", "enemy_clunkers"],
            "Fog Bell": ["non_boss_enemies"],
            "Goat Bell": ["non_boss_enemies"],
            "Frostbourne Bell": ["non_boss_enemies"],
            "Frosthand Bell": ["non_boss_enemies"],
            "Icebourne Bell": ["non_boss_enemies"],
            "Gloom Bell": ["companions", "items"],
            "Battle Bell": ["companions"],
            "Blood Bell": ["companions", "leaders"],
            "Sun Bell of Health": ["leaders"],
            "Sun Bell of Strength": ["items"],
            "Frenzy Bell": ["items"],
        },
    ),
    (
        "AFFECTS_MAP_EVENT",
        "MapEvent",
        {
            "Gloom Bell": [
                "Frozen Travellers",
                "Treasure Chest",
                "Gnome Traveller",
                "The Woolly Snail",
                "Charm Merchant",
            ]
        },
    ),
    ("INTRODUCES", "Crown", {"Tyrant Bell": ["Cursed Crown"]}),
]

# Bells that apply every cursed charm.
CURSED_CHARM_BELLS = ["Gloom Bell"]

# Rules of crowns, leaders and recruits (source label, source, relation, label, targets).
OTHER_RULES = [
    ("Crown", "Cursed Crown", "IS_CURSED_VERSION_OF", "Crown", ["Crown"]),
    ("Crown", "Crown", "CAN_BE_PLACED_ON", "CardType", ["companions", "items", "clunkers", "pets"]),
    (
        "Crown",
        "Cursed Crown",
        "CAN_BE_PLACED_ON",
        "CardType",
        ["companions", "items", "clunkers", "pets"],
    ),
    ("Crown", "Cursed Crown", "REDUCES", "Stat", ["Health", "Attack"]),
    ("CardType", "leaders", "STARTS_WITH_PERMANENT", "Crown", ["Crown"]),
    (
        "Card",
        "Naked Gnome (Enemy)",
        "CAN_BE_RECRUITED_AS",
        "Card",
        ["Naked Gnome (Companion)"],
    ),
]

# Amount on REDUCES edges, and base names whose infoboxes are variants.
CROWN_REDUCTION = 1
VARIANT_CARDS = ["Naked Gnome"]

# Phase order where image names mislead (base name -> card names in order).
PHASE_ORDER = {"Frost Guardian": ["Frost Guardian (Frost Wizard)", "Frost Guardian"]}

# Stats that never count as keywords.
STATS_NOT_KEYWORDS = ["Reaction", "Resist Snow"]

RULE_COLUMNS = (
    "src_label string, src_key string, rel string, dst_label string, targets array<string>, props map<string,string>"
)


def curated_rules(spark: SparkSession) -> DataFrame:
    """All curated rules, one row per source and relation."""
    rows = [
        ("Bell", bell, rel, label, targets)
        for rel, label, effects in BELL_RULES
        for bell, targets in effects.items()
    ]
    return spark.createDataFrame([(*row, rule_props(row[2])) for row in rows + OTHER_RULES], RULE_COLUMNS)


def rule_props(rel: str) -> dict[str, str]:
    """Properties of the edges of a rule: reductions say by how much."""
    return {"amount": str(CROWN_REDUCTION)} if rel == "REDUCES" else {}


def phase_order(spark: SparkSession) -> DataFrame:
    """(base, card_name, place) for ``assign_phases``."""
    rows = [(b, name, i) for b, names in PHASE_ORDER.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "base string, card_name string, place int")
