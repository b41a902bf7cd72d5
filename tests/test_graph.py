from __future__ import annotations

import pytest

from quillgraph.operators import closure
from quillgraph.operators import entities as N
from quillgraph.operators import evaluation as E
from quillgraph.operators import graph as G
from quillgraph.operators import reports as R
from quillgraph.operators import rows as W
from quillgraph.operators.numbering import numbered, numbered_within

EDGE = "src_label string, src_key string, rel string, dst_label string, dst_key string, props map<string,string>"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_ancestors_of_the_type_hierarchy(spark):
    edges = spark.createDataFrame(N.TYPE_PARENTS, "child string, parent string")
    up = pairs(closure.ancestors(edges))
    assert {a for n, a in up if n == "enemy_clunkers"} == {"non_boss_enemies", "clunkers", "enemies"}
    assert ("pets", "companions") in up
    with_self = pairs(closure.ancestors(edges, include_self=True))
    assert ("enemies", "enemies") in with_self and len(with_self) == len(up) + 8


def test_terminals_over_branches_long_chains_and_cycles(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(37)]
    rows = chain + [("x", "y"), ("x", "z"), ("p", "q"), ("q", "p"), ("q", "end")]
    got = pairs(closure.terminals(spark.createDataFrame(rows, "src string, dst string")))
    assert {t for n, t in got if n == "c00"} == {"c37"}
    assert {t for n, t in got if n == "x"} == {"y", "z"}
    assert ("p", "end") in got and ("q", "end") in got
    assert len(got) == 37 + 2 + 2


def test_propagation_moves_values(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    values = spark.createDataFrame([("a", 5), ("z", 1)], "node string, value int")
    assert pairs(closure.propagate_to_terminals(values, chain)) == {("c", 5), ("z", 1)}


def test_propagation_over_cycles_branches_and_empty_values_moves_each_value_once(spark, scratch):
    rows = [("a", "b"), ("b", "c"), ("a", "d"), ("p", "q"), ("q", "p"), ("x", "y")]
    chain = spark.createDataFrame(rows, "src string, dst string")
    values = [("a", 5), ("b", 7), ("c", 9), ("p", 4), ("x", None), ("y", 3), ("z", 1)]
    got = closure.propagate_to_terminals(spark.createDataFrame(values, "node string, value int"), chain)
    assert pairs(got) == {("c", 7), ("d", 5), ("y", None), ("z", 1)}
    # One exchange each of the values, their ends and what is sent; the chain is not read again.
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 3


def test_property_merge_and_idempotence(spark):
    kind = "card_name string, phase int, seq long, props map<string,string>"
    old = spark.createDataFrame([("a", None, 0, {"x": "1", "y": "1"})], kind)
    new = spark.createDataFrame([("a", None, 1, {"y": "2"}), ("a", 1, 1, {"y": "3"}), ("b", None, 1, {})], kind)
    once = G.merge_properties(old, new, ["card_name", "phase"])
    got = {(r["card_name"], r["phase"]): r["props"] for r in once.collect()}
    assert got == {("a", None): {"x": "1", "y": "2"}, ("a", 1): {"y": "3"}, ("b", None): {}}
    twice = G.merge_properties(once, new, ["card_name", "phase"])
    assert {(r["card_name"], r["phase"]): r["props"] for r in twice.collect()} == got


def test_links_need_both_ends_and_collapse(spark):
    nodes = spark.createDataFrame([("A", "1"), ("B", "2")], "label string, key string")
    rows = [("A", "1", "R", "B", "2", {"value": "5"}), ("A", "1", "R", "B", "2", {"value": "6"}), ("A", "1", "R", "B", "9", {})]
    edges = spark.createDataFrame(rows, EDGE)
    assert G.link(edges, nodes).count() == 1
    valued = G.link_valued(edges, nodes)
    assert sorted(r["props"]["value"] for r in valued.collect()) == ["5", "6"]
    assert G.link_unless_any(valued, G.link(edges, nodes)).count() == 2
    assert G.link_valued(G.link_valued(edges, nodes), nodes).count() == 2


def test_first_text_wins(spark):
    docs = spark.createDataFrame([(1, "t", "f1"), (2, "t", "f2"), (3, "u", "f3")], "seq int, text string, source_file string")
    assert {r["source_file"] for r in G.dedup_documents(docs).collect()} == {"f1", "f3"}
    assert {r["source_file"] for r in G.dedup_documents(docs, docs.where("text = 'u'")).collect()} == {"f1"}


def test_successors_and_keywords(spark):
    cards = spark.createDataFrame(
        [("Inf", 1, 2, "i1"), ("Inf", 2, 2, "i2"), ("Other", None, None, "o")],
        "base_name string, phase int, total_phases int, card string",
    )
    assert pairs(G.successor_pairs(cards)) == {("i1", "i2")}
    texts = spark.createDataFrame([("c", "Whenever sacrificing Allies, gain Snow-like frost")], "src string, text string")
    words = spark.createDataFrame([("Sacrifice",), ("Ally",), ("Snow",), ("Frenzy",)], "dst string")
    assert pairs(G.keyword_links(texts, words)) == {("c", "Sacrifice"), ("c", "Ally"), ("c", "Snow")}


def test_prefix_links(spark):
    wanted = spark.createDataFrame([("f", "Naked Gnome"), ("f", "Inf")], "src string, name string")
    names = ["Naked Gnome (Enemy)", "Inf Phase 1", "Inferno", "Inf", "Naked Gnomes"]
    cards = spark.createDataFrame([(n,) for n in names], "card_name string")
    assert {d for _, d in pairs(G.prefix_links(wanted, cards))} == {"Naked Gnome (Enemy)", "Inf Phase 1", "Inf"}


def test_degrees_keep_isolated_vertices(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "vertex string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b")], "src string, dst string")
    got = {r["vertex"]: (r["fan_in"], r["fan_out"]) for r in G.degrees(v, e).collect()}
    assert got == {"a": (0, 1), "b": (2, 0), "c": (0, 1)}


def test_bell_effect_on_fresh_graph(spark):
    """Nodes are complete before links, so a first run already links."""
    nodes = spark.createDataFrame([("Bell", "Blingsack Bell"), ("Bling", "Bling")], "label string, key string")
    rules = spark.createDataFrame(
        [("Bell", "Blingsack Bell", "AFFECTS_BLING", "Bling", ["Bling"]), ("Bell", "Absent", "AFFECTS_BLING", "Bling", ["Bling"])],
        "src_label string, src_key string, rel string, dst_label string, targets array<string>",
    )
    assert G.rule_links(rules, nodes).count() == 1


def test_phases_with_overrides_and_variants(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "Frost", "Frost", "bosses", None), (1, 1, "Frost (W)", "Frost", "bosses", None),
            (1, 2, "Gnome (Enemy)", "Gnome", "bosses", None), (1, 3, "Gnome (Companion)", "Gnome", "bosses", None),
            (1, 4, "Solo", "Solo", "bosses", 2), (2, 0, "T", "T", "bosses", 3), (2, 1, "T (m)", "T", "bosses", None),
        ],
        "page int, pos int, card_name string, base string, card_type string, image_phase int",
    )
    order = spark.createDataFrame([("Frost", "Frost (W)", 0), ("Frost", "Frost", 1)], "base string, card_name string, place int")
    got = {r["card_name"]: (r["phase"], r["total_phases"], r["card_type"]) for r in N.assign_phases(rows, order, ["Gnome"]).collect()}
    assert got["Frost (W)"][:2] == (1, 2) and got["Frost"][:2] == (2, 2)
    assert got["Gnome (Enemy)"] == (None, None, "non_boss_enemies")
    assert got["Gnome (Companion)"][2] == "companions"
    assert got["Solo"][0] is None
    assert got["T (m)"][0] == 1 and got["T"][0] == 2


def test_leader_numbers_count_skipped_rows(spark):
    rows = spark.createDataFrame([("S", 1, 5), ("S", 2, 3), ("S", 3, 5), ("C", 1, 5)], "tribe string, row_no int, n_cells int")
    got = {r["card_name"] for r in N.number_leaders(rows).collect()}
    assert got == {"S Leader #1", "S Leader #3", "C Leader #1"}


def test_numbering_spans_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as v", "id % 3 = 0 as g").repartition(5)
    assert {(r["v"], r["n"]) for r in numbered(df, ["v"], "n").collect()} == {(i, i + 1) for i in range(1000)}
    inside = numbered_within(df, ["g"], ["v"], "n").collect()
    for flag in (True, False):
        ns = [r["n"] for r in sorted((r for r in inside if r["g"] == flag), key=lambda r: r["v"])]
        assert ns == list(range(1, len(ns) + 1))


def test_boss_defaults(spark):
    bosses = spark.createDataFrame([("Bam",), ("Bamboozle",), ("Krunker",)], "name string")
    small = spark.createDataFrame([("Mini",), ("Krunker",)], "name string")
    assert pairs(N.boss_defaults(bosses, small)) == {("Bam", 13), ("Mini", 13), ("Krunker", 13)}


def test_metrics_fixtures(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "query_id int, rank int, doc_id string")
    marks = spark.createDataFrame([(1, 0, True)], "query_id int, chunk_index int, is_relevant boolean")
    m = {r["query_id"]: r for r in E.per_query_metrics(queries, ranked, marks).collect()}
    assert m[1]["hit_at_1"] == 1 and m[1]["mrr"] == 1.0 and m[1]["precision_at_10"] == pytest.approx(0.1)
    assert m[1]["recall_at_1"] == 1.0 and m[1]["annotated"]
    assert m[2]["hit_at_1"] == 0 and m[2]["mrr"] == 0.0 and not m[2]["annotated"]
    total = E.macro_average(E.per_query_metrics(queries, ranked, marks)).first()
    assert total["unannotated_queries"] == 1 and total["avg_hit_at_1"] == 0.5


def test_annotation_upsert_keeps_other_fields(spark):
    old = spark.createDataFrame([(1, 0, True, "n")], "query_id int, chunk_index int, is_relevant boolean, note string")
    new = spark.createDataFrame([(1, 0, False, 1), (1, 1, True, 2)], "query_id int, chunk_index int, is_relevant boolean, seq int")
    assert pairs(E.upsert_annotations(old, new)) == {(1, 0, False, "n"), (1, 1, True, None)}


def test_id_filters(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, query string")
    assert {r["query_id"] for r in W.filter_ids(q, include=[1, 3]).collect()} == {1, 3}
    assert {r["query_id"] for r in W.filter_ids(q, exclude=[2]).collect()} == {1, 3}
    with pytest.raises(ValueError, match="no query"):
        W.filter_ids(q, include=[9])


def test_experiment_search_and_ids(spark):
    e = spark.createDataFrame(
        [(1, "bm25", "001", "2024-01-02"), (1, "bm25", "007", None), (2, None, "x", "2024-01-03")],
        "run int, retriever string, experiment_id string, created_at string",
    )
    assert [r["experiment_id"] for r in R.search_experiments(e, retriever="bm25").collect()] == ["001", "007"]
    assert [r["experiment_id"] for r in R.search_experiments(e, kind="generation").collect()] == ["x"]
    assert R.search_experiments(e, run=2).count() == 1
    ids = {(r["run"], r["retriever"]): r["next_id"] for r in R.next_experiment_id(e).collect()}
    assert ids == {(1, "bm25"): "008", (2, None): "001"}


def test_not_repeatable_kinds_stay_in_the_plan(spark):
    plan = spark.createDataFrame([(1, "bm25"), (1, "text2cypher")], "run int, retriever string")
    assert {r["retriever"] for r in R.pending_plan(plan, plan, ["run", "retriever"]).collect()} == {"text2cypher"}


def test_best_not_marked_when_all_tie(spark):
    rows = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("n", "a", 0.7), ("n", "b", 0.2)], "metric string, experiment string, value double")
    got = {(r["metric"], r["experiment"]): r["cell"] for r in R.best_marked(rows).collect()}
    assert got == {("m", "a"): "0.500", ("m", "b"): "0.500", ("n", "a"): "**0.700**", ("n", "b"): "0.200"}


def test_curated_rules_link_existing_nodes_only(spark):
    from quillgraph.operators.rules import curated_rules

    rules = curated_rules(spark)
    ends = rules.selectExpr("src_label as label", "src_key as key").union(
        rules.selectExpr("dst_label", "explode(targets)")
    ).distinct()
    edges = G.rule_links(rules, ends)
    assert edges.count() == rules.selectExpr("sum(size(targets))").first()[0]
    assert G.rule_links(rules, ends.where("key <> 'Health'")).where("dst_key = 'Health'").isEmpty()


def test_flag_links_of_several_flags(spark):
    sources = spark.createDataFrame([("a", "red"), ("b", "big"), ("c", "none"), ("d", None)], "src string, flag string")
    targets = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "dst int, red boolean, big boolean")
    got = G.flag_links(sources, targets, ["red", "big"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]


def test_property_types_join(spark):
    rows = [("A", {"a": "1", "b": "true", "c": "1", "d": "1", "e": "12345678901234567890"}), ("A", {"a": "2", "b": "false", "c": "2.5", "d": "true"}), ("A", {"a": "-3"}), ("B", {})]
    nodes = spark.createDataFrame(rows, "label string, props map<string,string>")
    got = {(r["label"], r["property"]): (r["n"], r["type"], r["mandatory"]) for r in G.schema_properties(nodes).collect()}
    assert got == {
        ("A", "a"): (3, "Long", True), ("A", "b"): (2, "Boolean", False), ("A", "c"): (2, "Double", False),
        ("A", "d"): (2, "String", False), ("A", "e"): (1, "Double", False),
    }


def test_setting_a_property_keeps_the_others(spark):
    shape = "src_label string, src_key string, rel string, dst_label string, dst_key string, props map<string,string>"
    ends = ("A", "x", "R", "B", "y")
    stored = spark.createDataFrame([(*ends, {"kept": "1", "n": "0"}), ("A", "z", "R", "B", "y", {})], shape)
    given = spark.createDataFrame([(*ends, {"n": "5"}, 1), (*ends, {"n": "7"}, 2), (*ends, {"n": "8"}, 2)], shape + ", seq int")
    got = {r["src_key"]: r["props"] for r in G.link_setting(stored, given).collect()}
    assert got == {"x": {"kept": "1", "n": "8"}, "z": {}}


def test_crown_rules_carry_the_amount(spark):
    from quillgraph.operators.rules import curated_rules

    reduced = curated_rules(spark).where("rel = 'REDUCES'").collect()
    assert reduced and all(r["props"] == {"amount": "1"} for r in reduced)
    nodes = spark.createDataFrame([("Crown", "Cursed Crown"), ("Stat", "Health")], "label string, key string")
    edges = G.rule_links(curated_rules(spark), nodes).where("rel = 'REDUCES'").collect()
    assert [(e["dst_key"], e["props"]) for e in edges] == [("Health", {"amount": "1"})]


def test_numbers_within_groups_of_any_size(spark):
    rows = [(None if k % 5 == 0 else "hot" if k % 2 else f"g{k}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = {(r["g"], r["k"]): r["no"] for r in numbered_within(df, ["g"], ["k"], "no").collect()}
    want, seen = {}, {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want[g, k] = seen[g]
    assert got == want
    assert sorted(r["no"] for r in numbered(df, ["k"], "no").collect()) == list(range(1, 401))


def test_stats_from_columns_text_and_mentions(spark):
    cards = spark.createDataFrame(
        [("a", 5, "2 Teeth, Ghost", "Gain TEETH and Snow"), ("b", None, None, "health and snow")],
        "src string, health int, other_stats string, ability string",
    )
    stats = spark.createDataFrame([("Health",), ("Teeth",), ("Snow",)], "dst string")
    got = G.card_stat_edges(cards, stats, {"health": "Health"})
    assert pairs(got) == {("a", "Health", 5.0), ("a", "Teeth", 2.0), ("a", "Snow", None), ("b", "Health", None), ("b", "Snow", None)}


def test_bought_lines_are_dealt_before_edges_are_grouped(spark):
    from quillgraph.plans.graph_queries import edge_set_property

    made = edge_set_property(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    # No grouping sorts a whole file split: every one reads an exchange, of lines or of edges.
    assert plan.count("REPARTITION_BY_NUM") == 2
    # A value that sets a property is held once per row.
    assert "max_by" not in plan
