from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X


def values(spark, cases, fn, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_tokenize_drops_words_that_are_not_letters(spark):
    cases = ["What is the attack of Foxee?", "Proto-Stomper x3 don't it's cats'", "Été (naïve) a.b c."]
    got = values(spark, cases, X.tokenize)
    assert got[0] == ["what", "is", "the", "attack", "of", "foxee"]
    assert got[1] == ["do", "it", "cats"]
    assert got[2] == ["été", "naïve", "c"]


def test_stop_words_removed(spark):
    got = values(spark, ["what is the attack of Foxee"], lambda c: X.tokenize(c, X.STOP_WORDS))
    assert got == [["attack", "foxee"]]


def test_display_words(spark):
    got = values(spark, ["What is the Attack?", "the of"], X.display_without_stop_words)
    assert got == ["attack", "—"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("5-9", (5, 9)), ("5", (5, 5)), (" 7 ", (7, 7)), ("", (None, None)), ("x3", (None, None))],
)
def test_stat_range(spark, text, expected):
    assert tuple(values(spark, [text], X.stat_range)[0]) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2 Teeth", {("Teeth", 2)}),
        ("x3 Frenzy", {("Frenzy", 3)}),
        ("Reaction , 1 Block", {("Reaction", 1), ("Block", 1)}),
        ("x5 Frenzy Resist Snow", {("Frenzy", 5), ("Resist Snow", 1)}),
        ("", set()),
        (None, set()),
    ],
)
def test_other_stats(spark, text, expected):
    assert {tuple(s) for s in values(spark, [text], X.other_stats)[0]} == expected


def test_names_and_phases(spark):
    assert values(spark, ["Truffle (medium)", "Infernoko"], X.base_name) == ["Truffle", "Infernoko"]
    cases = ["Infernoko_(FrenzyBoss2).png", "a_%28SummonBoss3%29.PNG", "Foo.png", "Foo.jpg", None]
    assert values(spark, cases, X.image_phase) == [2, 3, 1, None, None]
    assert values(spark, ["ExplodeX", "X", "Fury"], X.keyword_name) == ["Explode", "X", "Fury"]
    assert values(spark, ["None", " a, b,", None], X.name_list) == [[], ["a", "b"], []]


def test_file_and_url_names(spark):
    assert values(spark, ["Sun Bell", "It's", 'A/B:C*?"<>|\\'], X.page_file_name) == [
        "Sun Bell.html", "It's.html", "ABC.html",
    ]
    assert values(spark, ["Sun  Bell"], lambda c: X.page_url(c, "u/")) == ["u/Sun_Bell"]


def test_keyword_forms(spark):
    got = values(spark, ["Sacrifice", "ally", "Fury Up", "snow"], X.keyword_forms)
    assert "sacrificing" in got[0]
    assert "allies" in got[1]
    assert got[2] == got[3] == []


def test_numbers_and_ids(spark):
    assert values(spark, ["12", " -3 ", "x", ""], X.parse_int) == [12, -3, None, None]
    assert [tuple(v) for v in values(spark, ["4", "", "x"], X.typed_value)] == [
        (4, "4"), (None, None), (None, "x"),
    ]
    assert values(spark, [7, 1234], X.padded_id, "int") == ["007", "1234"]
    assert values(spark, ["hit@1"], X.metric_key) == ["hit_at_1"]


def test_url_match_is_two_way_substring(spark):
    df = spark.createDataFrame(
        [("/Egg", "/Eggplant"), ("https://w/Mimik#x", "https://w/Mimik"), ("", "a"), (None, "a"), ("b", "a")],
        "s string, r string",
    )
    got = [r[0] for r in df.select(X.urls_match(F.col("s"), F.col("r"))).collect()]
    assert got == [True, True, False, False, False]
    exact = [r[0] for r in df.select(X.urls_match(F.col("s"), F.col("r"), True)).collect()]
    assert exact == [False] * 5


def test_comments_and_meta(spark):
    page = "<div><!-- NewPP\nlimit report --><p>kept</p></div>"
    assert values(spark, [page], X.strip_comments) == ["<div><p>kept</p></div>"]
    meta = '<meta name="description" content="A card">'
    assert values(spark, [meta, page], X.meta_description) == ["A card", None]


def test_normalize(spark):
    raw = "a\n  b .|| c|||||\td "
    assert values(spark, [raw], lambda c: X.normalize_text(c, "|")) == ["a b.\n\nc\n\nd"]


def test_prompt_fill(spark):
    got = values(spark, ["Q {{query}} C {{context}}"], lambda c: X.fill_template(c, F.lit("q"), F.lit("x")))
    assert got == ["Q q C x"]


def test_accepted_key(spark):
    got = values(
        spark, ["enemies", "items", "junk"],
        lambda c: X.accepted_key(c, {"enemies": "non_boss_enemies"}, ["non_boss_enemies", "items"]),
    )
    assert got == ["non_boss_enemies", "items", None]
