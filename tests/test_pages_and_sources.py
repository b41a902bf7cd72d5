from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import html as H
from quillgraph.operators import generation as B
from quillgraph.operators import pages as P
from quillgraph.operators.vector_store import VectorStore
from quillgraph.operators.rows import drop_vectors, to_result_rows, with_context
from quillgraph.sources import io


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id int, html string")


def text_of(spark, html):
    return P.page_text(page(spark, html)).first()["text"]


def test_page_text_rules(spark):
    html = (
        "<html><head><title>t</title></head><body><h1>Big <span>One</span></h1><p>Hi <b>bold</b> , you<br>next</p>"
        "<ul><li>a</li><li>b</li></ul><img src='x'><div class='x toc'>gone</div><script>no()</script><!-- c -->"
        "<div id='catlinks'>gone</div><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> </td></tr></table></body></html>"
    )
    assert text_of(spark, html) == "# Big One\n\nHi bold, you\nnext\na\nb\n\nA | B\n\n1"


def test_infobox_is_moved_before_the_first_section(spark):
    box = "<table id='infobox'><tr><th>Tribe</th></tr><tr><td>Snow</td></tr><tr><th>H</th><th>A</th></tr><tr><td>2</td><td></td></tr><tr><td>free</td></tr></table>"
    text = text_of(spark, f"{box}<p>Intro</p><h2>S</h2><p>x</p>")
    assert text == "Intro\n\nTribe: Snow\nH: 2\nfree\n\n## S\n\nx"


def test_chunks_follow_headings_and_bad_pages_are_listed(spark):
    html = "<p>pre</p><h1>A</h1><p>one</p><h2>B</h2>two<h3>C</h3>three<h2>D</h2>four"
    rows = P.chunk_by_header(page(spark, html)).orderBy("chunk_no").collect()
    assert [(r["h1"], r["h2"], r["h3"], r["text"]) for r in rows] == [
        (None, None, None, "pre"), ("A", None, None, "one"), ("A", "B", None, "two"), ("A", "B", "C", "three"), ("A", "D", None, "four"),
    ]

    def picky(markup):
        if "bad" in markup:
            raise ValueError("broken")
        return [{"n": len(markup)}]

    two = spark.createDataFrame([(1, "bad"), (2, "fine")], "page_id int, html string")
    assert [tuple(r) for r in P.parse_pages(two, picky, "n int").collect()] == [(2, 4)]
    assert [tuple(r) for r in P.page_errors(two, picky).collect()] == [(1, "ValueError: broken")]


def test_only_closed_character_references_are_decoded(spark):
    html = "<h1>a &amp;&amp</h1><p title='?a=1&copy=2'>x &lt; &#233;&#xe9; &nosuch; &notit; &amp;lt; AT&T</p>"
    assert text_of(spark, html) == "# a &&amp\n\nx < éé &nosuch; &notit; &lt; AT&T"
    chunk = P.chunk_by_header(page(spark, html)).first()
    assert (chunk["h1"], chunk["text"]) == ("a &&amp", "x < éé &nosuch; &notit; &lt; AT&T")
    hrefs = P.parse_pages(page(spark, html), lambda m: [{"t": H.parse(m).find("p")[0].attrs["title"]}], "t string")
    assert hrefs.first()["t"] == "?a=1&copy=2"


def test_deep_pages_are_kept(spark):
    deep = spark.createDataFrame(
        [(1, "<p>a" * 5000), (2, "<div><b>" * 3000 + "x")], "page_id int, html string"
    )
    texts = {r["page_id"]: r["text"] for r in P.page_text(deep).collect()}
    assert texts[1].count("a") == 5000 and texts[2].strip() == "x"
    kept = {r["page_id"]: r["html"] for r in P.strip_boilerplate(deep).collect()}
    assert kept[1] == "<p>a" * 5000 + "</p>" * 5000 and kept[2].endswith("</div>")
    assert {r["page_id"] for r in P.chunk_by_header(deep, split=False).collect()} == {1, 2}


def test_red_links_and_spans(spark):
    html = (
        "<table class='wikitable'><tr><th>Z</th><th>N</th><th>F</th></tr>"
        "<tr><td rowspan='4'>Zone A</td><td rowspan='2'>1</td><td><img src='i'></td></tr>"
        "<tr><td><a href='/Egg_Fight'>Egg</a></td></tr><tr><td rowspan='2'>2</td><td><img src='i'></td></tr>"
        "<tr><td><a class='new' href='/No'>No</a><a href='/Two'>Two</a></td></tr></table>"
    )
    cells = P.extract_cells(page(spark, html), "wikitable")
    slots = {(r["zone"], r["fight_number"], tuple(r["names"])) for r in P.span_slots(page(spark, html), "wikitable").collect()}
    assert slots == {("Zone A", 1, ("Egg",)), ("Zone A", 2, ("No", "Two"))}
    urls = {r["tight"]: r["u"] for r in cells.select("tight", P.linked_url(F.col("links"), "https://w").alias("u")).collect()}
    assert urls["Egg"] == "https://w/Egg_Fight" and urls["NoTwo"] is None
    slugs = {r["name"]: r["slug"] for r in P.name_slugs(cells).collect()}
    assert slugs == {"Egg": "Egg_Fight", "No": "No", "Two": "Two"}


def test_header_lookup_needs_its_columns(spark):
    html = "<table class='wikitable sortable'><tr><th>Image</th><th>Card Name</th><th>Tribe-exclusive?</th></tr><tr><td></td><td>Foo</td><td>All</td></tr><tr><td>short</td></tr></table>"
    pages = page(spark, html)
    rows = P.extract_by_header(pages, "Card Name", "Tribe-exclusive?", "wikitable").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("Foo", "All")]
    records = P.extract_rows(pages, "wikitable")
    P.require_headers(records, ["Card Name"])
    with pytest.raises(ValueError, match="no table"):
        P.require_headers(records, ["Missing"])


def test_row_records_need_no_exchange(spark):
    table = "<table><tr><th>A</th></tr><tr><td>1</td><th>h</th><td>2</td></tr><tr></tr><tr><td>3</td></tr></table>"
    pages = page(spark, table + table.replace("1", "9"))
    records = P.extract_rows(pages)
    rows = P.data_rows(records, {0: "a", 1: "b"}, 1)
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(0, 1, "1", "2"), (0, 3, "3", None), (1, 1, "9", "2"), (1, 3, "3", None)]
    layout = spark.createDataFrame(
        [(0, 0, "x", 2), (1, 1, "x", 1), (1, 0, "y", 1)], "table_no int, data_no int, field string, min_cells int"
    )
    laid = P.apply_layout(records, layout, ["x", "y"])
    assert sorted(tuple(r)[1:] for r in laid.collect()) == [(0, 1, "1", None), (1, 1, "2", "9"), (1, 3, None, "3")]
    later = P.extract_by_header(page(spark, "<table><tr><th>N</th><th>V</th></tr><tr><td>a</td><td>1</td></tr><tr><td>a</td><td>2</td></tr></table>"), "N", "V")
    assert [tuple(r)[1:] for r in later.collect()] == [(0, "a", "2")]
    for made in (rows, later, P.span_slots(pages)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_sections_take_the_paragraph_before_the_next_heading(spark):
    html = "<h2>Zones</h2><h3>One</h3><p>first</p><p>second</p><h3>Two</h3><h3>Three</h3><p>third</p>"
    got = [tuple(r)[1:] for r in P.sections(P.page_blocks(page(spark, html)), "h3").orderBy("place").collect()]
    assert got == [(1, "One", "first"), (2, "Two", ""), (3, "Three", "third")]


def test_query_csv_with_newlines_and_commas(spark, scratch):
    Path(scratch, "q.csv").write_text(
        "query_id,query,ground_truth,doc_reference\n"
        '1, What is A? ,truth,"https://w/A, https://w/B ,"\n'
        '2,"two\nlines, comma \\n kept",,\n3,,,\n'
    )
    rows = io.read_queries(spark, f"{scratch}/q.csv").orderBy("query_id").collect()
    assert [r["query_id"] for r in rows] == [1, 2, 3]
    assert rows[0]["query"] == "What is A?" and rows[0]["doc_references"] == ["https://w/A", "https://w/B"]
    assert rows[1]["query"] == "two\nlines, comma \\n kept" and rows[1]["doc_references"] == []
    queries = io.read_queries(spark, f"{scratch}/q.csv")
    io.write_queries_json(queries, f"{scratch}/json", "q.csv")
    assert sorted(io.read_queries_json(spark, f"{scratch}/json").collect()) == sorted(queries.collect())
    meta = spark.read.json(f"{scratch}/json/metadata").first()
    assert meta["total_queries"] == 3 and meta["source"] == "q.csv"


def test_html_tree_and_sitemap(spark, scratch):
    Path(scratch, "a/b").mkdir(parents=True)
    Path(scratch, "a/b/x.html").write_text("<p>x</p>")
    Path(scratch, "a/skip.txt").write_text("no")
    rows = io.read_html_tree(spark, f"{scratch}/a").collect()
    assert [r["html"] for r in rows] == ["<p>x</p>"] and rows[0]["path"].endswith("a/b/x.html")
    Path(scratch, "s.xml").write_text(
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://w/A</loc><lastmod>2024</lastmod></url>'
        "<url><loc>https://w/B</loc></url><url><lastmod>2023</lastmod></url></urlset>"
    )
    got = {tuple(r) for r in io.read_sitemap(spark, f"{scratch}/s.xml").collect()}
    assert got == {("https://w/A", "2024"), ("https://w/B", "")}


def test_results_round_trip_and_discovery(spark, scratch):
    rows = spark.createDataFrame(
        [(1, 1, 5, 0.5, "1", "bm25", "001"), (1, 1, 6, 0.4, "1", "vector", "001")],
        "query_id int, rank int, doc_id int, score double, run string, retriever string, experiment_id string",
    )
    io.write_results(rows, f"{scratch}/res")
    assert io.read_results(spark, f"{scratch}/res", retriever="bm25").count() == 1
    again = rows.where("retriever = 'bm25'").unionByName(rows.where("retriever = 'bm25'").withColumn("rank", F.lit(2)))
    io.write_results(again, f"{scratch}/res")
    assert io.read_results(spark, f"{scratch}/res").select("retriever").distinct().count() == 2
    assert sorted(r["rank"] for r in io.read_results(spark, f"{scratch}/res", retriever="bm25").collect()) == [1, 2]
    assert io.read_results(spark, f"{scratch}/res", retriever="vector").count() == 1
    configs = rows.select("run", "retriever", "experiment_id")
    assert io.discover(configs, rows.where("retriever = 'vector'")).first()["retriever"] == "vector"


def test_embedding_is_resumable(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "bb", None), (3, "c", [9.0])], "doc_id int, text string, vector array<float>")
    fresh = B.embed(B.missing_vectors(docs, "vector"), lambda texts: [[len(t)] for t in texts], batch=1)
    stored = B.store_vectors(docs, fresh, "vector")
    assert {r["doc_id"]: r["vector"] for r in stored.collect()} == {1: [1.0], 2: [2.0], 3: [9.0]}
    assert B.missing_vectors(stored, "vector").isEmpty()


def test_every_text_is_encoded_once(spark, scratch):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    store = VectorStore(spark, scratch, "m")
    docs = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (None, "lost"), (5, "")], "doc_id int, text string")
    store.fill(docs.repartition(4), encode, batch=2)
    assert calls.value == 3
    asked = spark.createDataFrame([(7, "b"), (8, "new"), (9, "new")], "query_id int, query string")
    store.fill(asked, encode, "query_id", "query")
    store.fill(docs, encode)
    assert calls.value == 4
    assert {r["query_id"]: r["vector"] for r in store.vectors(asked, "query_id", "query").collect()} == {7: [1.0, 1.0], 8: [3.0, 1.0], 9: [3.0, 1.0]}
    assert {r["doc_id"] for r in store.vectors(docs).collect()} == {1, 2, 3, 5}
    assert VectorStore(spark, scratch, "other").vectors(docs).count() == 0


def test_generation_keeps_errors(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "boom")], "query_id int, query string")
    ctx = spark.createDataFrame([(1, "c1"), (3, "c3")], "query_id int, context string")

    def answer(system, user):
        if "boom" in user:
            raise RuntimeError("no")
        return user.splitlines()[-1]

    out = {r["query_id"]: (r["response"], r["status"]) for r in B.generate(B.prompts(q, ctx, F.lit("s")), answer).collect()}
    assert out[1] == ("Context: c1", "success")
    assert out[2][1] == "failed" and out[3] == ("ERROR: no", "failed")
    assert B.generate(B.prompts(q, None, F.lit("s")), lambda s, u: u).where("status = 'success'").count() == 3


def test_result_row_shapes(spark):
    raw = spark.createDataFrame(
        [("t", None, "https://w/B", 0.9, "x", [1.0])],
        "text string, source_url string, doc_source_url string, score double, extra string, hf_embedding array<double>",
    )
    assert "hf_embedding" not in drop_vectors(raw).columns
    bare = to_result_rows(spark.createDataFrame([(1, True, "late", [1, 2])], "query_id int, no_results boolean, error string, found array<int>")).first()
    assert tuple(bare)[:5] == (1, 0.0, "", "", None) and bare["fields"] == {"found": "[1,2]"}
    row = to_result_rows(with_context(raw, "hybrid_rrf", "text")).first()
    assert row["source_url"] == "https://w/B" and row["retrieved_text"] == "t"
    assert row["fields"] == {"text": "t", "extra": "x"} and row["search_type"] == "hybrid_rrf"


def test_choices_made_where_the_page_is_read_equal_those_over_cells(spark):
    html = (
        "<h3 id='h'>One</h3><div>x</div><p>a</p><p>b</p><h2>Two</h2><h3>Three</h3><h4>sub</h4><p>c</p>"
        "<table class='t'><tr><th><a href='/h'>Head</a></th><td><a href='/x'>x</a></td></tr>"
        "<tr><td>1</td><td><a href='//p' title='T'>P</a><a href='/q' class='new'>Q</a></td></tr>"
        "<tr><td><a href='/zero'>Z</a></td><td><a href='/q'>Q</a><a href='/p2'>P</a><a>no</a></td></tr>"
        "<tr><td><img src='i'></td><td><a href='/i'>I</a></td></tr></table>"
        "<table class='t'><tr><td>k</td><td><a href='/p3'>P</a></td></tr><tr><th>k</th><td>1</td><td><a href='/r'>R</a></td></tr></table>"
    )
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, html)], "page_id int, html string")
    cells = P.extract_cells(pages, "t")

    def same(mine, theirs):
        columns = theirs.columns
        assert theirs.count() > 0 and mine.columns == columns
        assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, theirs.collect()), key=repr)

    same(P.page_slugs(pages, "t"), P.name_slugs(cells))
    same(P.page_linked_names(pages, "t"), P.distinct_linked_names(cells))
    links = P.extract_links(pages, "t")
    same(links, P.cell_links(cells).select(*links.columns))
    names = spark.createDataFrame([("One", "First")], "text string, name string")
    for given in (None, names):
        same(P.page_sections(pages, "h3", given), P.sections(P.page_blocks(pages), "h3", given))


def test_row_records_carry_the_named_fields_only(spark):
    records = P.extract_rows(page(spark, "<table><tr><td>a</td></tr></table>"), cell_fields=["tight"], fields=["row_no"])
    assert [tuple(r) for r in records.collect()] == [(1, 0, [("a",)])]


def test_lean_cell_readers_and_small_batches_give_the_rows_of_the_full_reader(spark):
    import pyarrow as pa

    from types import SimpleNamespace

    from pyspark.sql import types as T

    markup = (
        '<table class="w"><tr><th>A <i>b</i></th><th>C</th></tr><tr><td><a href="/x" class="new old">X <b>y</b></a> z<script>s<a>q</a></script></td>'
        '<td> one  two </td></tr><tr><td><img src="i"></td><td><p><a title="t">T</a></p>rest</td></tr></table>'
    )
    root = H.parse(markup)
    for fields in (["is_header"], ["is_header", "tight"], ["text", "header"], ["is_header", "tight", "links"], ["image", "links"]):
        lean = [*H.table_rows(root, "w", H.cell_reader(fields))]
        full = [*H.table_rows(root, "w")]
        for a, b in zip(lean, full, strict=True):
            assert a["row_no"] == b["row_no"] and a["n_data"] == b["n_data"]
            assert [[c[f] for f in fields] for c in a["cells"]] == [[c[f] for f in fields] for c in b["cells"]]
    assert H.cell_reader(["is_header", "tight"]) is not H.cell_reader(["image"])

    seen = []
    frame = SimpleNamespace(schema=T.StructType([T.StructField("page_id", T.LongType())]))
    frame.where = frame.select = lambda *_: frame
    frame.mapInArrow = lambda rows, schema: seen.append(rows)
    P.parse_pages(frame, lambda m: H.table_rows(H.parse(m), "w"), "row_no int, cells array<struct<is_header:boolean,tight:string,links:array<struct<href:string,classes:array<string>>>>>")
    n = P.PAGES_HELD * 2 + 1
    made = [*seen[0](iter([pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": [markup] * n})]))]
    # A batch of many pages leaves in parts, and nothing is lost between them.
    assert [b.num_rows for b in made] == [P.PAGES_HELD * 3, P.PAGES_HELD * 3, 3]
    assert made[2].to_pylist()[1]["cells"][0] == {"is_header": False, "tight": "Xyz", "links": [{"href": "/x", "classes": ["new", "old"]}]}


def test_heading_tables_reads_a_page_once_and_moves_no_cell(spark):
    from quillgraph.plans.page_queries import heading_tables

    plan = heading_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and plan.count("Exchange") == 1


def test_heading_columns_equal_the_first_tables_over_cells(spark):
    row = "<tr><td>{0}1</td><th>h</th><td> <a href='/x'>{0} 2</a><i></i></td></tr>"
    table = "<table class='{1}'><tr><th>A</th><td>no</td></tr>" + row + "<tbody>" + row.replace("1", "3") + "<tr><td>{0}4</td></tr></tbody></table>"
    pages = [
        # The nearest heading counts, by its first id or its text; a nested and a second table are not the first.
        f"{table.format('p', 'w')}<h2 id='a'>Big <b>Order</b> x</h2><p>y</p>{table.format('q', 'v w')}{table.format('r', 'w')}",
        f"<h3><span class='n' id='a'>x</span></h3>{table.format('s', 'v')}<div>{table.format('t', 'w')}</div><h4 id='b'>Order</h4>{table.format('u', 'w')}",
        f"<h2 id='a'>Order</h2><table class='w'><tr><td>1</td><td>{table.format('n', 'w')}</td></tr></table>",
        # Tables of a first row alone, without cells and without rows.
        f"<h1 id='a'>Order</h1><table class='w'><tr><td>k</td></tr></table><table class='w'><tr></tr><tr></tr></table><table class='w'></table>{table.format('m', 'w')}",
        # A heading inside a cell, one without id after one with it, text in script, unclosed tags, capital names, references.
        f"<h2 id='a'>N</h2><TABLE CLASS='w'><tr><th>A<tr><td>z<h3>Order</h3>{table.format('o', 'w')}<script>'<td>s'</script>",
        "<h2 ID='a'>An &amp; Order</h2><table class=w><tr><th>A</th></tr><tr><td>x<script>no</script></td><td><style>no</style></td><td>&lt;<br>5 </td></tr>",
        "<h2 id=''><i id='a'>Order</i></h2><p>no table</p>", "", table.format("l", "w"),
    ]
    given = spark.createDataFrame([*enumerate(pages), (99, None)], "page_id int, html string")
    asked = {"id": ("a", "id", "w", 1), "any": ("a", "id", None, 0), "text": ("Order", "text", None, 1), "both": ("Order", "text", "w", 0), "none": ("x", "id", None, 0)}
    mine = P.page_heading_columns(given, asked)
    assert mine.columns == ["page_id", "name", "row_no", "text"]
    cells = P.extract_cells(given).where("row_no > 0")
    theirs = [
        (r["page_id"], name, r["row_no"], r["text"])
        for name, (match, by, css_class, data_no) in asked.items()
        for r in P.table_after_heading(cells, match, by, css_class).where(f"data_no = {data_no}").collect()
    ]
    assert {r[0] for r in theirs} == {0, 1, 2, 3, 4, 5} and {r[1] for r in theirs} == {*asked} - {"none"}
    assert sorted(map(tuple, mine.collect())) == sorted(theirs)


def test_elements_in_document_order_and_attributes_read_on_demand():
    markup = "<div a=1><p id='x'>one<b>two</p>three<br/><ul><li>4<li class='k l' id=y>5</ul></b></div><script a='<i>'><u></script><p/><i>6</i></q>"
    tree = H.parse(markup)

    def below(node):
        return [e for c in node.children if not isinstance(c, str) for e in (c, *below(c))]

    assert [*tree.walk()] == below(tree) and [e.tag for e in tree.walk()] == "div p b br ul li li script p i".split()
    assert [e.attrs for e in tree.walk()][:2] == [{"a": "1"}, {"id": "x"}] and tree.find("li")[1].classes() == ["k", "l"]
    assert tree.find("br")[0].attrs is tree.find("br")[0].attrs and tree.attrs == {}
    less = H.parse(markup, ["ul", "x"])
    assert [*less.walk()] == below(less) and [e.tag for e in less.walk()] == "div br script p i".split()
    assert H.parse("<td><a><b> x  y </b></a></td>").text() == "x y" and H.parse("<td><style>x</style></td>").text() == ""


def test_elements_of_text_alone_read_as_any_other():
    def shape(node):
        return [c if isinstance(c, str) else (c.tag, c.attrs, shape(c)) for c in node.children]

    assert shape(H.parse("a<b>x</b>c<td></td><p id='i'>1 &lt; 2</p>&amp;")) == ["a", ("b", {}, ["x"]), "c", ("td", {}, []), ("p", {"id": "i"}, ["1 < 2"]), "&"]
    # Void and self-closed elements hold nothing; what follows lies beside them, and an end tag closes what is open.
    assert shape(H.parse("<br>x</br><p>y<p/>z</p>w")) == [("br", {}, []), "x", ("p", {}, ["y", ("p", {}, []), "z"]), "w"]
    assert shape(H.parse("<TD>x</td>y<b>1</B>2<i>3</i >4<a/b>5</a/b>6")) == [
        ("td", {}, ["x"]), "y", ("b", {}, ["1"]), "2", ("i", {}, ["3"]), "4", ("a", {"b": ""}, ["5"]), "6",
    ]
    assert shape(H.parse("<b>x</b><script>1 &lt;<i>2</i></script><style/>q</style><u>3</u>")) == [
        ("b", {}, ["x"]), ("script", {}, ["1 &lt;<i>2</i>"]), ("style", {}, ["q"]), ("u", {}, ["3"]),
    ]
    assert shape(H.parse("<p>1<b>x</b>2</p><b class='d'>gone</b>3", ["d"])) == [("p", {}, ["1", ("b", {}, ["x"]), "2"]), "3"]
