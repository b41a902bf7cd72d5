"""Pages table to text, chunks and typed table rows.

Python reads one page at a time inside ``mapInArrow`` (no shuffle) and emits flat rows;
windows, pivots and joins over those rows are DataFrame work. Windows here run per page
or per table of a page, so their size is bounded by one page.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.functions import html as H
from quillgraph.functions.text import normalize_text
from quillgraph.operators.skew import hot_join

_LINKS = "array<struct<href:string,title:string,classes:array<string>,text:string>>"
_CELLS = (
    "table_no int, table_id string, table_class array<string>, heading_id string, "
    "heading_text string, row_no int, n_data int, row_head string, row_image boolean, col_no int, "
    "data_no int, header string, is_header boolean, text string, "
    f"tight string, rowspan int, image string, gray boolean, italic string, links {_LINKS}"
)
_ROW = (
    "table_no", "table_id", "table_class", "heading_id", "heading_text", "row_no", "n_data", "row_head", "row_image"
)
_BLOCKS = "seq int, kind string, heading_id string, text string"


#: Pages whose rows a task holds before they leave as a batch.
PAGES_HELD = 512


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Arrow values; lists of records field by field, which is several times cheaper than record by record."""
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) and all(v.__class__ is list for v in values):
        flat = [*chain.from_iterable(values)]
        ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
        return pa.ListArray.from_arrays(ends, _array(flat, kind.value_type), type=kind)
    if pa.types.is_struct(kind) and all(v.__class__ is dict for v in values):
        return pa.StructArray.from_arrays([_array([v.get(f.name) for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, type=kind)


def parse_pages(
    pages: DataFrame, fn: Callable[[str], Iterable[dict]], columns: str, key: str = "page_id"
) -> DataFrame:
    """Rows a page function yields, with the page key.

    ``pages(<key>, html)``; ``columns`` is the DDL of the function's row. A page on which the
    function fails has no rows here; :func:`page_errors` is the table of those pages.
    """
    schema = T.StructType([pages.schema[key], *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    names = schema.fieldNames()[1:]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = logging.getLogger(__name__)
        # Rows of few pages are held as Python objects at once.
        for batch in (b.slice(at, PAGES_HELD) for b in batches for at in range(0, b.num_rows, PAGES_HELD)):
            keys: list = []
            found: list[dict] = []
            for page, markup in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    made = list(fn(markup))
                except Exception:
                    log.exception("page %s failed", page)
                    continue
                found += made
                keys += [page] * len(made)
            columns = [keys, *([row.get(n) for row in found] for n in names)]
            arrays = [_array(c, t) for c, t in zip(columns, arrow.types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return pages.where(F.col("html").isNotNull()).select(key, "html").mapInArrow(rows, schema)


def page_errors(
    pages: DataFrame, fn: Callable[[str], Iterable[dict]], key: str = "page_id"
) -> DataFrame:
    """(page, error): the pages without rows in :func:`parse_pages`, because the function failed."""

    def tried(markup: str) -> Iterator[dict]:
        try:
            for _ in fn(markup):
                pass
        except Exception as problem:
            yield {"error": f"{type(problem).__name__}: {problem}"}

    return parse_pages(pages, tried, "error string", key)


def strip_boilerplate(
    pages: DataFrame, selectors: Sequence[str] = tuple(H.BOILERPLATE), key: str = "page_id"
) -> DataFrame:
    """Markup without elements whose class, id or tag name is listed."""
    chosen = list(selectors)
    return parse_pages(
        pages, lambda m: [{"html": H.tree_html(H.parse(m, chosen))}], "html string", key
    )


def page_text(
    pages: DataFrame, selectors: Sequence[str] = tuple(H.BOILERPLATE), key: str = "page_id"
) -> DataFrame:
    """Readable text of a page: headings marked, tables textualized, whitespace normalized."""
    chosen = list(selectors)
    marked = parse_pages(
        pages, lambda m: [{"text": H.marked_text(H.parse(m, chosen))}], "text string", key
    )
    return marked.withColumn("text", normalize_text(F.col("text"), H.MARK))


def chunk_by_header(
    pages: DataFrame,
    levels: Sequence[str] = ("h1", "h2", "h3"),
    split: bool = True,
    selectors: Sequence[str] = tuple(H.BOILERPLATE),
    key: str = "page_id",
) -> DataFrame:
    """(page, chunk_no, <levels>, text), or the whole page as its only chunk."""
    if not split:
        whole = page_text(pages, selectors, key)
        empty = [F.lit(None).cast("string").alias(level) for level in levels]
        return whole.select(key, F.lit(1).alias("chunk_no"), *empty, "text")
    chosen, wanted = list(selectors), tuple(levels)
    names = ["chunk_no", *wanted, "text"]
    columns = ", ".join(["chunk_no int", *[f"{level} string" for level in wanted], "text string"])
    return parse_pages(
        pages,
        lambda m: [
            dict(zip(names, row, strict=True))
            for row in H.header_chunks(H.parse(m, chosen), wanted)
        ],
        columns,
        key,
    )


def table_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, table_no, is_infobox, text) of every table."""

    def rows(markup: str) -> Iterator[dict]:
        for number, (_, boxed, lines) in enumerate(H.tables(H.parse(markup))):
            yield {"table_no": number, "is_infobox": boxed, "text": "\n".join(lines)}

    return parse_pages(pages, rows, "table_no int, is_infobox boolean, text string", key)


def extract_cells(
    pages: DataFrame,
    css_class: str | None = None,
    key: str = "page_id",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Cells of all tables; with a class, only its tables, numbered from 0 per page.

    Each cell carries what its row and column say about it (row size, row head, column
    header), so later steps filter and pivot instead of joining cells with themselves.
    ``fields`` limits the columns that leave the Python task.
    """
    all_fields = T.StructType.fromDDL(_CELLS).fields
    kept = [f for f in all_fields if fields is None or f.name in fields]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return parse_pages(pages, lambda m: H.cell_rows(H.parse(m), css_class), columns, key)


def extract_rows(
    pages: DataFrame,
    css_class: str | None = None,
    key: str = "page_id",
    cell_fields: Sequence[str] = ("is_header", "text", "tight"),
    fields: Sequence[str] = _ROW,
) -> DataFrame:
    """One record per table row, its cells side by side in ``cells``, as the page function meets them.

    ``fields`` and ``cell_fields`` limit what leaves the Python task. Row operators select from the record, so nothing is shuffled after the pages are read.
    """
    columns = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(_CELLS).fields}
    cell = ",".join(f"{name}:{columns[name]}" for name in cell_fields)
    kept = ", ".join(f"{name} {columns[name]}" for name in _ROW if name in fields)
    read = H.cell_reader([*cell_fields, *("text" for _ in {"row_head"} & {*fields}), *("image" for _ in {"row_image"} & {*fields})])
    return parse_pages(pages, lambda m: H.table_rows(H.parse(m), css_class, read), f"{kept}, cells array<struct<{cell}>>", key)


def extract_links(pages: DataFrame, css_class: str | None = None, key: str = "page_id") -> DataFrame:
    """One row per link of a cell, as :func:`cell_links` of the cells gives."""
    columns = f"table_no int, row_no int, col_no int, data_no int, link_no int, link {_LINKS[6:-1]}"
    return parse_pages(pages, lambda m: H.link_rows(H.parse(m), css_class), columns, key)


def data_cells() -> Column:
    """The data cells of a row record, in order."""
    return F.filter("cells", lambda c: ~c["is_header"])


def page_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Headings and paragraphs of every page in document order."""
    return parse_pages(pages, lambda m: H.block_rows(H.parse(m)), _BLOCKS, key)


# ---------------------------------------------------------------- rows out of cells


def data_rows(
    rows: DataFrame, fields: dict[int, str], min_cells: int = 1, key: str = "page_id"
) -> DataFrame:
    """Row records as columns: data cells by position under the given field names.

    The first row of a table is its header; rows with fewer data cells are skipped.
    """
    columns = [F.get(data_cells(), n)["tight"].alias(f) for n, f in fields.items()]
    long_enough = (F.col("row_no") > 0) & (F.col("n_data") >= min_cells)
    return rows.where(long_enough).select(key, "table_no", "row_no", *columns)


def categorize(rows: DataFrame, categories: DataFrame, key: str = "page_id") -> DataFrame:
    """Tables to categories by ordinal: ``categories(table_no, category)``; others are dropped.

    Most rows may lie in the first table of their page, so they are dealt by page too.
    """
    return hot_join(rows, categories, ["table_no"], key)


def apply_layout(
    rows: DataFrame, layout: DataFrame, fields: Sequence[str], key: str = "page_id"
) -> DataFrame:
    """Rows of tables whose columns mean different things per table.

    ``layout(table_no, data_no, field, min_cells)`` names each column; short rows are skipped.
    """
    place = F.struct("field", F.struct("data_no", "min_cells"))
    layouts = layout.groupBy("table_no").agg(F.map_from_entries(F.collect_list(place)).alias("places"))
    named = hot_join(rows.where("row_no > 0"), layouts, ["table_no"], key)

    def present(at: Column) -> Column:
        return (F.col("n_data") >= at["min_cells"]) & (F.col("n_data") > at["data_no"])

    columns = [
        F.when(present(F.col("places")[f]), F.get(data_cells(), F.col("places")[f]["data_no"])["tight"]).alias(f)
        for f in fields
    ]
    return named.where(F.exists(F.map_values("places"), present)).select(key, "table_no", "row_no", *columns)


def extract_by_header(
    pages: DataFrame, name_header: str, value_header: str, css_class: str | None = None, key: str = "page_id"
) -> DataFrame:
    """(page, table_no, name, value) from the columns with these headers; last row per name wins."""
    return parse_pages(
        pages,
        lambda m: H.header_pairs(H.parse(m), css_class, name_header, value_header),
        "table_no int, name string, value string",
        key,
    )


def require_headers(rows: DataFrame, headers: Sequence[str]) -> None:
    """Raise when no table carries all the headers."""
    heads = F.transform(F.filter("cells", lambda c: c["is_header"]), lambda c: F.trim(c["text"]))
    wanted = F.array(*[F.lit(h) for h in headers])
    if rows.where("row_no = 0").where(F.size(F.array_except(wanted, heads)) == 0).isEmpty():
        raise ValueError(f"no table with the columns {list(headers)}")


def cell_links(cells: DataFrame) -> DataFrame:
    """One row per link of a cell."""
    return cells.select(
        *[c for c in cells.columns if c != "links"], F.posexplode("links").alias("link_no", "link")
    )


def linked_url(links: Column, base_url: str) -> Column:
    """Absolute address of a cell's first link; null for none or for a missing page."""
    first = F.get(links, 0)
    live = (first["href"] != "") & ~F.array_contains(first["classes"], "new")
    return F.when(live, F.concat(F.lit(base_url), first["href"]))


def navbox_members(cells: DataFrame, table_id: str = "navbox", key: str = "page_id") -> DataFrame:
    """(page, category, member, member_no) of a category table."""
    box = cells.where((F.col("table_id") == table_id) & (F.col("row_no") > 0))
    category = F.regexp_replace(F.lower(F.trim("row_head")), " ", "_")
    return cell_links(box.where("data_no = 0 and row_head is not null")).select(
        key, category.alias("category"), F.trim(F.col("link.text")).alias("member"), "link_no"
    )


def table_after_heading(
    cells: DataFrame, match: str, by: str = "id", css_class: str | None = None, key: str = "page_id"
) -> DataFrame:
    """Cells of the first table after a heading, by heading id or by text it contains."""
    under = F.col("heading_id") == match if by == "id" else F.col("heading_text").contains(match)
    rows = cells.where(under)
    if css_class:
        rows = rows.where(F.array_contains("table_class", css_class))
    first = F.min("table_no").over(Window.partitionBy(key))
    return rows.withColumn("_first", first).where("table_no = _first").drop("_first")


def distinct_linked_names(
    cells: DataFrame, data_no: int = 1, key: str = "page_id"
) -> DataFrame:
    """Distinct first-link names of a column, in first-seen order: (page, name, place)."""
    at = F.struct("table_no", "row_no")
    names = cells.where((F.col("data_no") == data_no) & (F.size("links") > 0)).select(
        key, F.get("links", 0)["text"].alias("name"), at.alias("at")
    )
    seen = names.where("name <> ''").groupBy(key, "name").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at", "name"))
    return seen.select(key, "name", place.alias("place"))


def linked_titles(links: DataFrame, excluded: str = "/Keywords") -> DataFrame:
    """Link rows without excluded addresses, named by title attribute before text."""
    name = F.coalesce(F.nullif(F.col("link.title"), F.lit("")), F.col("link.text"))
    return (
        links.where(~F.col("link.href").contains(excluded))
        .withColumn("name", name)
        .where("name <> ''")
    )


def span_slots(pages: DataFrame, css_class: str | None = None, key: str = "page_id") -> DataFrame:
    """(page, table_no, row_no, zone, fight_number, names) of tables with spanning cells.

    Zone and number are carried down inside the page function; see :func:`H.slot_rows`.
    """
    columns = "table_no int, row_no int, zone string, fight_number int, names array<string>"
    return parse_pages(pages, lambda m: H.slot_rows(H.parse(m), css_class), columns, key)


def name_slugs(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, name, slug) from links; the last link of a name wins, leading slashes go."""
    links = cell_links(cells.where("row_no > 0 and data_no is not null and not row_image"))
    at = F.struct("table_no", "row_no", "col_no", "link_no")
    return (
        links.where("link.text <> '' and link.href <> ''")
        .groupBy(key, F.col("link.text").alias("name"))
        .agg(F.regexp_replace(F.max_by("link.href", at), "^/+", "").alias("slug"))
    )


def page_slugs(pages: DataFrame, css_class: str | None = None, key: str = "page_id") -> DataFrame:
    """:func:`name_slugs` of a page's tables, chosen where the page is read."""
    return parse_pages(pages, lambda m: H.slug_pairs(H.parse(m), css_class), "name string, slug string", key)


def page_linked_names(
    pages: DataFrame, css_class: str | None = None, data_no: int = 1, key: str = "page_id"
) -> DataFrame:
    """:func:`distinct_linked_names` of a page's tables, chosen where the page is read."""
    return parse_pages(pages, lambda m: H.linked_names(H.parse(m), css_class, data_no), "name string, place int", key)


def page_heading_columns(
    pages: DataFrame, columns: dict[str, tuple[str, str, str | None, int]], key: str = "page_id"
) -> DataFrame:
    """Data columns of the tables that :func:`table_after_heading` gives, all chosen where the page is read.

    ``columns`` names (match, by, css_class, data_no); (page, name, row_no, text) without first rows, and tables of
    a first row alone are passed over.
    """
    asked = [(name, *column) for name, column in columns.items()]
    return parse_pages(pages, lambda m: H.heading_columns(H.parse(m), asked), "name string, row_no int, text string", key)


def page_sections(pages: DataFrame, level: str, names: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """:func:`sections` of a page's blocks, made where the page is read."""
    found = parse_pages(pages, lambda m: H.section_rows(H.parse(m), level), "place int, text string, description string", key)
    name = F.col("text")
    if names is not None:
        found, name = hot_join(found, names, ["text"], key, "left"), F.coalesce("name", "text")
    return found.select(key, "place", name.alias("name"), F.coalesce("description", F.lit("")).alias("description"))


def sections(
    blocks: DataFrame, level: str, names: DataFrame | None = None, key: str = "page_id"
) -> DataFrame:
    """Headings of a level in order with the first paragraph before the next heading.

    ``names(text, name)`` renames headings; (page, place, name, description).
    """
    is_heading = F.col("kind").isin("h1", "h2", "h3", "h4")
    number = F.sum(is_heading.cast("int")).over(Window.partitionBy(key).orderBy("seq"))
    grouped = (
        blocks.withColumn("section", number)
        .groupBy(key, "section")
        .agg(
            F.max(F.when(is_heading, F.col("kind"))).alias("level"),
            F.max(F.when(is_heading, F.col("text"))).alias("text"),
            F.min_by(
                F.when(~is_heading, F.col("text")), F.when(~is_heading, F.col("seq"))
            ).alias("description"),
        )
        .where(F.col("level") == level)
    )
    if names is not None:
        grouped = grouped.join(names, "text", "left")
        name = F.coalesce("name", "text")
    else:
        name = F.col("text")
    place = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    return grouped.select(
        key,
        place.alias("place"),
        name.alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def infobox_rows(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per infobox: name, stats map, other stats, ability or flavor text, image.

    Stats pair the headers of the third row with the values of the fourth.
    """
    cell = F.struct(
        "row_no", "col_no", "data_no", "is_header", "text", "tight", "gray", "italic", "image"
    )
    boxes = (
        cells.where("table_id = 'infobox'")
        .groupBy(key, "table_no")
        .agg(F.array_sort(F.collect_list(cell)).alias("c"))
    )

    def heads(row: int) -> Column:
        return F.filter("c", lambda x: (x["row_no"] == row) & x["is_header"])

    def below(label: str) -> Column:
        """First data cell under the row headed by the label."""
        named = F.filter("c", lambda x: x["is_header"] & (x["tight"] == label))
        row = F.get(named, 0)["row_no"] + 1
        return F.get(F.filter("c", lambda x: (x["row_no"] == row) & (x["data_no"] == 0)), 0)

    def text(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    labels = F.transform(heads(2), lambda x: F.lower(F.trim(x["text"])))
    values = F.transform(
        F.filter("c", lambda x: (x["row_no"] == 3) & x["data_no"].isNotNull()),
        lambda x: text(F.trim(x["text"])),
    )
    n = F.least(F.size(labels), F.size(values))
    stats = F.map_from_arrays(F.slice(labels, F.lit(1), n), F.slice(values, F.lit(1), n))
    described = below("Card Description")
    is_flavor = described["gray"] & described["italic"].isNotNull()
    images = F.filter("c", lambda x: x["image"].isNotNull())
    return boxes.select(
        key,
        "table_no",
        F.get(heads(0), 0)["tight"].alias("card_name"),
        F.map_filter(stats, lambda _, v: v.isNotNull()).alias("stats"),
        text(below("Other Stats")["text"]).alias("other_stats"),
        F.when(~is_flavor, text(described["text"])).alias("abilities"),
        F.when(is_flavor, text(described["italic"])).alias("flavor"),
        F.get(images, 0)["image"].alias("image"),
    ).where("card_name is not null and card_name <> ''")
