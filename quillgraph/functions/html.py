"""Small tolerant HTML tree used inside page tasks: one page in, plain rows out.

Everything that relates rows to each other (columns, row spans, ordinals, layouts, joins)
is done afterwards on DataFrames; this module only reads one page's markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import escape, unescape
from html.entities import html5

# Class, id or tag names whose elements are boilerplate.
BOILERPLATE = [
    "navbox", "printfooter", "catlinks", "mw-navigation", "mw-head", "mw-panel", "footer",
    "mw-editsection", "toc", "script", "siteSub", "jump-to-nav", "mw-jump-link",
    "mw-collapsible", "head",
]

# Fixed value: stands for a wanted line break while pretty-print newlines become spaces.
MARK = "\u2029"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags whose text runs on within a line, and the mark of each heading tag.
_INLINE = ["a", "span", "b", "i", "strong", "em", "small", "code"]
_HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### "}
_SILENT = {"script", "style", "template"}


def _spaced(strings: Iterable[str]) -> str:
    return " ".join(" ".join(strings).split())


class Element:
    """Element with attributes, read when first asked for, and children (elements or strings).

    :func:`parse` sets the fields itself: a page makes many elements, and a call for each would cost a tenth of its time.
    """

    __slots__ = ("tag", "children", "_attrs")

    @property
    def attrs(self) -> dict[str, str]:
        held = self._attrs
        if held.__class__ is str:
            held = self._attrs = _attributes(held) if held else {}
        return held

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """Descendant elements in document order."""
        stack = [c for c in self.children[::-1] if c.__class__ is not str]
        while stack:
            node = stack.pop()
            yield node
            below = node.children
            if len(below) > 1 or below and below[0].__class__ is not str:
                stack += [c for c in below[::-1] if c.__class__ is not str]

    def find(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags]

    def kids(self, *tags: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and c.tag in tags]

    def strings(self) -> Iterator[str]:
        """Stripped non-empty strings below, script and style left out."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is str:
                if said := node.strip():
                    yield said
            elif node.tag not in _SILENT:
                stack += node.children[::-1]

    def text(self) -> str:
        node = self
        while len(node.children) == 1 and node.tag not in _SILENT:
            node = node.children[0]
            if node.__class__ is str:
                return " ".join(node.split())
        return _spaced(self.strings())

    def tight(self) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        return "".join(self.strings())


class Page(Element):
    """Root of a tree that keeps its elements in document order, unless some were dropped."""

    __slots__ = ("order",)

    def walk(self) -> Iterator[Element]:
        return super().walk() if self.order is None else iter(self.order)


def _markup(leaf: str) -> re.Pattern:
    """End tags, start tags with their attributes and ``leaf``, comments and declarations."""
    return re.compile(
        r"""<(?:/([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)"""
        rf"""|([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)(?:>{leaf}|\Z)"""
        r"""|!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z))""",
        re.DOTALL,
    )


# An element of text alone is met as one piece: what it says follows its attributes.
_MARKUP, _RAW_MARKUP = _markup(r"(?:([^<]*+)</\2>)?"), _markup("")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}
_RAW_START = re.compile(r"<(?:script|style)", re.IGNORECASE)


def _decoded(text: str) -> str:
    """Text with its closed character references decoded; an unclosed or unknown one stays as written."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), _decoded(value) if "&" in value else value)
    return found


def parse(html: str, dropped: Iterable[str] = ()) -> Element:
    """Tree of a page without the elements whose class, id or tag name is dropped.

    End tags close the nearest open element of their name and everything inside it; end tags
    without one are ignored; comments and declarations vanish; script and style are raw text.
    """
    unwanted = frozenset(dropped)
    order: list[Element] = []
    root = Page()
    root.tag, root._attrs, root.children, root.order = "", "", [], None if unwanted else order
    path, last, children = [root], root, root.children
    pieces = _raw_pieces(html) if _RAW_START.search(html) else _MARKUP.split(html)
    if pieces[0]:
        _add_text(root, pieces[0])
    for closing, opening, attributes, said, text in zip(
        pieces[1::5], pieces[2::5], pieces[3::5], pieces[4::5], pieces[5::5], strict=True
    ):
        if opening:
            tag, is_void, is_raw = _tag(opening)
            below: list[Element | str] = []
            element = Element()
            element.tag, element._attrs, element.children = tag, attributes, below
            order.append(element)
            if not unwanted or not {tag, element.attrs.get("id", ""), *element.classes()} & unwanted:
                children.append(element)
            if is_raw or not is_void and (not attributes or attributes[-1] != "/"):
                if said is None:
                    path.append(element)
                    last, children = element, below
                elif said:
                    below.append(_decoded(said) if "&" in said else said)
            elif said is not None:
                if said:
                    children.append(_decoded(said) if "&" in said else said)
                _close(path, tag)
                last = path[-1]
                children = last.children
        elif closing:
            if last.tag == closing:
                path.pop()
            else:
                _close(path, closing.lower())
            last = path[-1]
            children = last.children
        if text:
            if "&" not in text:
                children.append(text)
            else:
                _add_text(last, text)
    return root


@lru_cache(4096)
def _tag(written: str) -> tuple[str, bool, bool]:
    """Name of a tag, whether it holds nothing and whether it holds raw text."""
    name = written.lower()
    return name, name in _VOID, name in _RAW_END


def _raw_pieces(html: str) -> list[str | None]:
    """What ``_MARKUP.split`` gives with no element in one piece, but script and style hold one text up to their end tag."""
    pieces: list[str | None] = []
    at = 0
    while found := _RAW_MARKUP.search(html, at):
        pieces += (html[at : found.start()], *found.groups(), None)
        at = found.end()
        tag = (found[2] or "").lower()
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            pieces += (html[at : end.start() if end else len(html)], tag, None, None, None)
            at = end.end() if end else len(html)
    return [*pieces, html[at:]]


def _add_text(element: Element, text: str) -> None:
    element.children.append(_decoded(text) if "&" in text and element.tag not in _RAW_END else text)


def _close(path: list[Element], tag: str) -> None:
    for depth in range(len(path) - 1, 0, -1):
        if path[depth].tag == tag:
            del path[depth:]
            return


def tree_html(element: Element) -> str:
    """Markup of a tree again (comments are gone), for trees of any depth."""
    out: list[str] = []
    todo: list[Element | str] = [element]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
        if node.tag in _VOID:
            out.append(f"<{node.tag}{attrs}/>")
            continue
        if node.tag:
            out.append(f"<{node.tag}{attrs}>")
            todo.append(f"</{node.tag}>")
        raw = node.tag in _SILENT
        todo += [
            escape(c, quote=False) if isinstance(c, str) and not raw else c
            for c in reversed(node.children)
        ]
    return "".join(out)


# ------------------------------------------------------------------ tables as text


def infobox_lines(table: Element) -> list[str]:
    """``Label: value`` lines of a two-row key/value table, ``A: x | B: y`` for header rows."""
    body = table.kids("tr") or [r for b in table.find("tbody")[:1] for r in b.kids("tr")]
    lines: list[str] = []
    taken = False
    for row, following in zip(body, [*body[1:], None], strict=True):
        if taken:
            taken = False
            continue
        labels, values = row.kids("th"), row.kids("td")
        line = row.text()
        if labels and not values and following is not None:
            below = [v.text() for v in following.kids("td")]
            if len(labels) > 1:
                pairs = zip((h.text() for h in labels), below, strict=False)
                line = " | ".join(f"{h}: {v}" for h, v in pairs if h and v)
                taken = True
            elif labels[0].text() and below:
                line = ": ".join(t for t in (labels[0].text(), below[0]) if t)
                taken = True
        if line:
            lines.append(line)
    return lines


def data_table_lines(table: Element) -> list[str]:
    """One line per row that says anything; an empty line sets a leading header row apart."""
    rows = [row.find("th", "td") for row in table.find("tr")]
    said = [" | ".join(filter(None, map(Element.text, cells))) for cells in rows]
    if rows and any(cell.tag == "th" for cell in rows[0]):
        return [*filter(None, said[:1]), "", *filter(None, said[1:])]
    return [*filter(None, said)]


def tables(root: Element) -> Iterator[tuple[Element, bool, list[str]]]:
    """Every table in document order, whether it is the infobox, and its lines."""
    for table in root.find("table"):
        boxed = table.attrs.get("id") == "infobox"
        yield table, boxed, infobox_lines(table) if boxed else data_table_lines(table)


# ------------------------------------------------------------------ page text


def marked_text(root: Element) -> str:
    """Page text with a mark for every line break; whitespace is normalized by the caller."""
    said = {table: (boxed, MARK + MARK.join(lines) + MARK * 2) for table, boxed, lines in tables(root)}
    boxes = [text for boxed, text in said.values() if boxed]
    # Infoboxes move to the first section heading, if there is one.
    first_h2 = next((e for e in root.walk() if e.tag == "h2"), None) if boxes else None

    def lead(node: Element) -> str:
        return "".join(boxes) if node is first_h2 else ""

    def shown(table: Element) -> str:
        boxed, text = said[table]
        return "" if boxed and first_h2 is not None else text

    def joined(node: Element) -> str:
        out: list[str] = []
        todo = [*reversed(node.children)]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                out.append(child.strip())
            elif child.tag == "table":
                out.append(shown(child).strip())
            elif child.tag not in _SILENT and child.tag != "img":
                out.append(lead(child).strip())
                todo += reversed(child.children)
        return " ".join(filter(None, out))

    out: list[str] = []
    todo = [*reversed(root.children)]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "table":
            out.append(shown(child))
        elif child.tag in _INLINE:
            out.append(f" {joined(child)} ")
        elif child.tag in _HEADINGS:
            out.append(lead(child) + MARK * 2 + _HEADINGS[child.tag] + joined(child) + MARK * 2)
        elif child.tag not in _SILENT and child.tag != "img":
            if child.tag in ("p", "li", "br"):
                todo.append(MARK)
            todo += reversed(child.children)
    return "".join(out)


def header_chunks(root: Element, levels: tuple[str, ...]) -> Iterator[tuple]:
    """(chunk_no, heading per level..., text): text between headings with its heading path."""
    path: dict[str, str] = {}
    parts: list[str] = []
    number = 0

    def finish() -> Iterator[tuple]:
        nonlocal number
        text = re.sub(r"\s+", " ", " ".join(parts)).strip()
        parts.clear()
        if text:
            number += 1
            yield (number, *[path.get(level) for level in levels], text)

    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                parts.append(node.strip())
        elif node.tag in levels:
            yield from finish()
            for deeper in levels[levels.index(node.tag) :]:
                path.pop(deeper, None)
            path[node.tag] = node.text()
        elif node.tag not in _SILENT:
            stack.extend(reversed(node.children))
    yield from finish()


# ------------------------------------------------------------------ rows of a page


def table_rows(
    root: Element, css_class: str | None = None, read: Callable[[Element], dict] | None = None
) -> Iterator[dict]:
    """One record per table row with its table, its preceding heading and its cells.

    With a class, only its tables are read and numbered. ``read``: what is read of a cell, all by default.
    """
    read = read or _cell
    heading_id, heading_text, table_no = None, None, -1
    for node in root.walk():
        if node.tag in _HEADINGS:
            heading_id, heading_text = _heading_id(node), node.text()
        elif node.tag == "table" and (css_class is None or css_class in node.classes()):
            table_no += 1
            shared = {
                "table_no": table_no,
                "table_id": node.attrs.get("id"),
                "table_class": node.classes(),
                "heading_id": heading_id,
                "heading_text": heading_text,
            }
            headers: list[str] = []
            for row_no, row in enumerate(_own_rows(node)):
                cells = [read(c) for c in row.children if c.__class__ is not str and c.tag in ("th", "td")]
                data_no, row_head, row_image = -1, None, False
                if row_no == 0:
                    headers = [c["text"] if c["is_header"] else "" for c in cells]
                for col_no, cell in enumerate(cells):
                    cell["col_no"] = col_no
                    cell["header"] = headers[col_no] if col_no < len(headers) else None
                    if cell["is_header"]:
                        cell["data_no"] = None
                        row_head = cell["text"] if row_head is None else row_head
                    else:
                        data_no += 1
                        cell["data_no"] = data_no
                    row_image = row_image or cell["image"] is not None
                yield {
                    **shared, "row_no": row_no, "n_data": data_no + 1, "row_head": row_head, "row_image": row_image, "cells": cells
                }


def cell_rows(root: Element, css_class: str | None = None) -> Iterator[dict]:
    """The cells of :func:`table_rows`, one at a time."""
    for row in table_rows(root, css_class):
        cells = row.pop("cells")
        yield from (row | cell for cell in cells)


def header_pairs(root: Element, css_class: str | None, name_header: str, value_header: str) -> Iterator[dict]:
    """Per table, the values under one header by the names under another; the last row of a name wins."""
    found: dict[tuple[int, str], str] = {}
    for row in table_rows(root, css_class, _text_cell):
        if row["row_no"]:
            by_header: dict[str, str] = {}
            for cell in row["cells"]:
                by_header.setdefault((cell["header"] or "").strip(" "), cell["tight"])
            name, value = by_header.get(name_header), by_header.get(value_header)
            if name is not None and value is not None:
                found[row["table_no"], name] = value
    for (table_no, name), value in found.items():
        yield {"table_no": table_no, "name": name, "value": value}


def heading_columns(root: Element, columns: Iterable[tuple[str, str, str, str | None, int]]) -> Iterator[dict]:
    """Per (name, match, by, css_class, data_no): the texts of a data column of the first table after a heading.

    The heading nearest before a table counts, by its id or by text it contains. Tables without a cell below their
    first row are passed over.
    """
    asked = [*columns]
    heading: Element | None = None
    for node in root.walk():
        if node.tag in _HEADINGS:
            heading = node
        elif node.tag == "table" and heading is not None:
            under = [c for c in asked if _is_under(heading, c[1], c[2]) and (not c[3] or c[3] in node.classes())]
            rows = [[c for c in r.children if c.__class__ is not str and c.tag in ("th", "td")] for r in _own_rows(node)[1:]] if under else []
            if any(rows):
                for name, _, _, _, data_no in under:
                    for row_no, row in enumerate(rows, 1):
                        data = [c for c in row if c.tag == "td"]
                        if 0 <= data_no < len(data):
                            yield {"name": name, "row_no": row_no, "text": data[data_no].text()}
                asked = [c for c in asked if c not in under]
                if not asked:
                    return


def _heading_id(heading: Element) -> str | None:
    return next((e.attrs["id"] for e in (heading, *heading.walk()) if e.attrs.get("id")), None)


def _is_under(heading: Element, match: str, by: str) -> bool:
    return _heading_id(heading) == match if by == "id" else match in heading.text()


def link_rows(root: Element, css_class: str | None = None) -> Iterator[dict]:
    """The links of the cells of :func:`table_rows`, one at a time."""
    for row in table_rows(root, css_class, _link_cell):
        for cell in row["cells"]:
            for link_no, link in enumerate(cell["links"]):
                yield {
                    "table_no": row["table_no"], "row_no": row["row_no"], "col_no": cell["col_no"],
                    "data_no": cell["data_no"], "link_no": link_no, "link": link,
                }


def slug_pairs(root: Element, css_class: str | None = None) -> Iterator[dict]:
    """Names and addresses without leading slashes of links in data cells; the last link of a name wins."""
    found: dict[str, str] = {}
    for row in table_rows(root, css_class, _link_cell):
        if row["row_no"] and not row["row_image"]:
            for cell in row["cells"]:
                if not cell["is_header"]:
                    for link in cell["links"]:
                        if link["text"] and link["href"]:
                            found[link["text"]] = link["href"].lstrip("/")
    for name, slug in found.items():
        yield {"name": name, "slug": slug}


def linked_names(root: Element, css_class: str | None, data_no: int) -> Iterator[dict]:
    """Distinct first-link names of a column in first-seen order."""
    said = (c["links"][0]["text"] for r in table_rows(root, css_class, _link_cell) for c in r["cells"] if c["links"] and c["data_no"] == data_no)
    for place, name in enumerate(dict.fromkeys(filter(None, said)), 1):
        yield {"name": name, "place": place}


def section_rows(root: Element, level: str) -> Iterator[dict]:
    """Headings of a level in order, with the first paragraph before the next heading of any level."""
    found: list[dict] = []
    section: dict | None = None
    for node in root.walk():
        if node.tag in _HEADINGS:
            section = None
            if node.tag == level:
                section = {"place": len(found) + 1, "text": node.text(), "description": None}
                found.append(section)
        elif node.tag == "p" and section is not None and section["description"] is None:
            section["description"] = node.text()
    yield from found


def slot_rows(root: Element, css_class: str | None = None) -> Iterator[dict]:
    """Rows of tables with spanning cells, with the zone and number that hold for them.

    A spanning first cell without image names the zone when it spans more than two rows; the
    next spanning numeric cell numbers the slot; both hold for later rows. Rows whose remaining
    cells show an image or name nothing are skipped.
    """
    zone = number = table_no = None
    for row in table_rows(root, css_class):
        if row["table_no"] != table_no:
            zone, number, table_no = None, None, row["table_no"]
        cells = [c for c in row["cells"] if not c["is_header"]]
        if not row["row_no"] or not cells:
            continue
        if (cells[0]["rowspan"] or 0) > 2 and cells[0]["image"] is None:
            zone = cells.pop(0)["tight"]
        said = _integer(cells[0]["tight"]) if cells and cells[0]["rowspan"] is not None else None
        if said is not None:
            number = said
            cells.pop(0)
        names = [link["text"] for cell in cells for link in cell["links"] if link["text"]]
        pictured = any(cell["image"] is not None for cell in cells)
        if names and not pictured and zone is not None and number is not None:
            yield {"table_no": table_no, "row_no": row["row_no"], "zone": zone, "fight_number": number, "names": names}


def _integer(text: str) -> int | None:
    """A signed integer of 32 bits."""
    value = int(text) if _INTEGER.fullmatch(text.strip(" ")) else 1 << 31
    return value if -(1 << 31) <= value < 1 << 31 else None


def _own_rows(table: Element) -> list[Element]:
    rows: list[Element] = []
    for child in table.children:
        if child.__class__ is not str:
            if child.tag == "tr":
                rows.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                rows += child.kids("tr")
    return rows


def _cell(cell: Element) -> dict:
    """Fields of one cell, read in a single walk over its elements."""
    made = {
        "is_header": cell.tag == "th", "text": "", "tight": "", "rowspan": None,
        "image": None, "gray": False, "italic": None, "links": [],
    }
    if cell.attrs:
        span = cell.attrs.get("rowspan", "")
        made["rowspan"] = int(span) if span.isdigit() else None
    if len(cell.children) == 1 and cell.children[0].__class__ is str:
        made["tight"] = said = cell.children[0].strip()
        made["text"] = " ".join(said.split())
        return made
    strings: list[str] = []
    todo = cell.children[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if said := node.strip():
                strings.append(said)
            continue
        _note(made, node)
        if node.tag in _SILENT:
            for e in node.walk():
                _note(made, e)
        else:
            todo += node.children[::-1]
    if strings:
        made["tight"] = "".join(strings)
        made["text"] = _spaced(strings)
    return made


def cell_reader(fields: Iterable[str]) -> Callable[[Element], dict]:
    """The cheapest reader of a cell that gives these fields for :func:`table_rows`."""
    wanted = set(fields) - {"is_header", "col_no", "data_no"}
    if not wanted:
        return _bare_cell
    if wanted <= {"text", "tight", "header"}:
        return _text_cell
    return _text_and_links if wanted <= {"text", "tight", "header", "links"} else _cell


def _bare_cell(cell: Element) -> dict:
    """Whether a cell is a header, nothing of what it holds."""
    return {"is_header": cell.tag == "th", "text": "", "image": None}


def _text_cell(cell: Element) -> dict:
    """The text of a cell alone."""
    children = cell.children
    if len(children) == 1 and children[0].__class__ is str:
        tight = children[0].strip()
        return {"is_header": cell.tag == "th", "text": " ".join(tight.split()), "tight": tight, "image": None}
    strings = [*cell.strings()]
    return {"is_header": cell.tag == "th", "text": _spaced(strings), "tight": "".join(strings), "image": None}


def _text_and_links(cell: Element) -> dict:
    made = _text_cell(cell)
    made["links"] = [_link(e) for e in cell.walk() if e.tag == "a"]
    return made


def _link_cell(cell: Element) -> dict:
    """The links of a cell and whether it shows an image, without its text."""
    made = {"is_header": cell.tag == "th", "text": "", "image": None, "gray": True, "italic": "", "links": []}
    if len(cell.children) != 1 or cell.children[0].__class__ is not str:
        for e in cell.walk():
            _note(made, e)
    return made


def _link(e: Element) -> dict:
    return {"href": e.attrs.get("href", ""), "title": e.attrs.get("title", ""), "classes": e.classes(), "text": e.tight()}


def _note(made: dict, e: Element) -> None:
    """What an element inside a cell says about the cell."""
    if e.tag == "a":
        made["links"].append(_link(e))
    elif e.tag == "img" and made["image"] is None:
        made["image"] = e.attrs.get("src") or e.attrs.get("alt") or ""
    elif e.tag == "i" and made["italic"] is None:
        made["italic"] = e.text()
    elif e.tag == "span" and not made["gray"]:
        style = e.attrs.get("style", "")
        made["gray"] = "color:gray" in style or "color:grey" in style


def block_rows(root: Element) -> Iterator[dict]:
    """Headings and paragraphs in document order."""
    for seq, node in enumerate(e for e in root.walk() if e.tag in _HEADINGS or e.tag == "p"):
        named = [e.attrs["id"] for e in (node, *node.walk()) if e.attrs.get("id")]
        yield {
            "seq": seq,
            "kind": node.tag,
            "heading_id": named[0] if named and node.tag != "p" else None,
            "text": node.text(),
        }
