"""Main text of pages through wrappers inferred per host.

A page becomes a stream of structural tags and text slots. Repeated neighbours fold into
repeated groups. The distinct folded streams of a host are aligned one after the other into one
union-free expression: what only some pages have becomes an optional group, differing texts are
slots. Slots of the expression are judged once per host by the elements around them, and every
page takes over the verdicts of the slots that its stream is aligned with.

All pages are read: streams are counted per host with partial aggregation, so a host with a
third of all pages costs no more than its distinct streams, which are merged in salted groups
first. Nothing of a page but its folded stream takes part in the inference.

Defined cases: a null or empty html has no text (empty string, length 0); a null url belongs to
the host ``""``; markup without an article element gives all text outside of page furniture;
unclosed and stray tags are repaired as browsers do for paragraphs, list items and cells; nesting
may be of any depth; repeated rows are repeated in the result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import stored

#: Elements whose content is no text. One that ends in itself has none; without an end tag only
#: scripts and styles run to the end of the page, of all others just the opening tag goes.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<code>script|style)\b[^>]*+(?:(?<=/)>|>.*?(?:</(?P=code)\s*>|\Z))"
    r"|<(?P<raw>noscript|template|textarea|title|iframe|svg|select|object)\b[^>]*+(?:(?<=/)>|>(?:.*?</(?P=raw)\s*>)?)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that only dress the text of a block, and elements without content.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var".split()
)
BREAKS, EMPTY = {"br", "wbr"}, set("area base col embed hr img input link meta param source track".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, {"html"}),
}
INSIDE_P = {"button", "canvas", "output"}
FURNITURE = set("nav footer aside form head button dialog menu fieldset".split())
#: Words of class, id and role attributes that name page furniture.
MARKED = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead "
    "comment comments commentlist respond replies reply disqus cookie cookies consent notice notices "
    "alert popup modal newsletter subscribe signup login share sharing social related recommended "
    "search pagination pager toolbar hidden complementary contentinfo navigation".split()
)
#: Words that may stand beside them in one name ("ad-slot", "site-footer"); any other word makes the
#: name speak of something else ("has-sidebar", "search-results", "related-work").
BESIDE = set(
    "area article bar block bottom box button buttons container form group header icons inner item items left link "
    "links list main module outer page panel post posts primary right secondary section site slot text top unit "
    "wrap wrapper".split()
)
CORE = {"article", "main"}


def _label(name: str, rest: str) -> str:
    if name in ("html", "body", "main"):
        return name
    words: set[str] = set()
    for found in NAMED.findall(rest):
        for named in " ".join(found).lower().split():
            parts = {w for w in re.split(r"[^a-z]+", named) if w}
            if parts <= MARKED | BESIDE:
                words |= parts & MARKED
    return ".".join([name, *sorted(words)])


def furniture(label: str, inside_core: bool) -> bool:
    name, _, marks = label.partition(".")
    return bool(marks) or name in FURNITURE or (name == "header" and not inside_core)


class PageReader:
    """Token stream of one page: folded items, the slots in them, and the text blocks by slot."""

    def __init__(self) -> None:
        self.items: list = []
        self.marks: list = []
        self.open: list[tuple[str, str, int]] = []
        self.counts: Counter = Counter()
        self.children: list[list[int]] = [[]]
        self.same: list[int] = []
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []

    def read(self, page: str) -> PageReader:
        at = 0
        for token in TOKEN.finditer(page):
            self.text.append(entities.unescape(page[at : token.start()]))
            at = token.end()
            name = (token["name"] or "").lower()
            if not name or name in EMPTY:
                if token["raw"] or token["code"] or name == "hr":
                    self._end_block()
                continue
            if name in BREAKS:
                self.text.append(" ")
                continue
            label = _label(name, token["rest"] or "") if not token["close"] else name
            if name in INLINE and (label == name if not token["close"] else not self.counts[name]):
                continue
            self._end_block()
            if token["close"]:
                if self.counts[name]:
                    while self._close() != name:
                        pass
            else:
                self._imply(name)
                self.children[-1].append(len(self.items))
                self.open.append((name, label, len(self.items)))
                self.counts[name] += 1
                self.children.append([])
                self._put("<" + label, None)
                if (token["rest"] or "").endswith("/") and name in INLINE:
                    self._close()
        self.text.append(entities.unescape(page[at:]))
        self._end_block()
        while self.open:
            self._close()
        return self

    def _put(self, item, mark) -> None:
        self.items.append(item)
        self.marks.append(mark)

    def _end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            slot = len(self.same)
            self.same.append(slot)
            self._put("#", slot)
            self.blocks.append((slot, text))

    def _imply(self, name: str) -> None:
        if self.open and self.open[-1][0] == "p" and name not in INSIDE_P | INLINE:
            self._close()
        closing, fence = CLOSES.get(name, ((), ()))
        if any(self.counts[c] for c in closing):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in fence:
                    break
                if self.open[k][0] in closing:
                    while len(self.open) > k:
                        self._close()

    def _close(self) -> str:
        name, label, start = self.open.pop()
        self.counts[name] -= 1
        self.children.pop()
        self._put("</" + name, None)
        self._fold()
        return name

    def _slots(self, marks) -> list[int]:
        flat = []
        for m in marks:
            if isinstance(m, tuple):
                flat += m
            elif m is not None:
                flat.append(m)
        return flat

    def _fold(self) -> None:
        """Fold the last one to three siblings into the equal group before them."""
        starts = self.children[-1]
        for width in (1, 2, 3):
            if len(starts) <= width:
                return
            begin, before = starts[-width], starts[-width - 1]
            last = tuple(self.items[begin:])
            group = self.items[before]
            if before == begin - 1 and isinstance(group, tuple) and group[1] == last:
                first = list(self.marks[before])
            elif len(starts) >= 2 * width and tuple(self.items[starts[-2 * width] : begin]) == last:
                before = starts[-2 * width]
                first = self._slots(self.marks[before:begin])
            else:
                continue
            for kept, gone in zip(first, self._slots(self.marks[begin:]), strict=True):
                self.same[gone] = kept
            del self.items[before:], self.marks[before:]
            del starts[starts.index(before) :]
            starts.append(before)
            self._put(("+", last), tuple(first))
            return

    def result(self) -> tuple[list, list[int], list[str]]:
        """Folded items; per text block its slot, numbered in the order of the items; the blocks."""
        number = {slot: k for k, slot in enumerate(self._slots(self.marks))}

        def kept(slot: int) -> int:
            while self.same[slot] != slot:
                slot = self.same[slot]
            return slot

        return self.items, [number[kept(s)] for s, _ in self.blocks], [t for _, t in self.blocks]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def _kinds(items: list) -> list[tuple]:
    """What positions are aligned by: the item and all labels around it."""
    around, path, out = [], 0, []
    for item in items:
        if isinstance(item, str) and item.startswith("</"):
            path = around.pop() if around else 0
        label = item if isinstance(item, str) else "+" + next(iter(_plain(item[1])), "")
        out.append((path, label))
        if isinstance(item, str) and item.startswith("<") and not item.startswith("</"):
            around.append(path)
            path = hash((path, item))
    return out


def _plain(items) -> Iterator[str]:
    for item in items:
        if isinstance(item, str):
            yield item
        else:
            yield from _plain(item[1])


def _grouped(items: list, bodies: set) -> list:
    """Single occurrences of the bodies of repeated groups, written as such groups."""
    by_first: dict = {}
    for body in sorted(bodies, key=lambda b: -len(b)):
        by_first.setdefault(body[0] if body else None, []).append(body)
    out, k = [], 0
    while k < len(items):
        for body in by_first.get(items[k], ()) if isinstance(items[k], str) else ():
            if tuple(items[k : k + len(body)]) == body:
                if not (out and out[-1] == ("+", body)):
                    out.append(("+", body))
                k += len(body)
                break
        else:
            out.append(items[k])
            k += 1
    return out


def align(left: list, right: list) -> Iterator[tuple[int | None, int | None]]:
    """Pairs of positions; one side is None where the other has no partner."""
    matcher = SequenceMatcher(None, _kinds(left), _kinds(right), autojunk=False)
    a = b = 0
    for x, y, size in matcher.get_matching_blocks():
        yield from ((k, None) for k in range(a, x))
        yield from ((None, k) for k in range(b, y))
        yield from zip(range(x, x + size), range(y, y + size), strict=True)
        a, b = x + size, y + size


def merge(wrapper: list, items: list) -> list:
    """The wrapper, widened so that it also describes ``items``.

    A wrapper is a list of (item, optional). Positions without a partner become optional;
    repeated groups that start alike are merged within.
    """
    if not wrapper:
        return [(x, False) for x in items]
    if [x for x, _ in wrapper] == items:
        return wrapper
    bodies = {x[1] for x in [*(w for w, _ in wrapper), *items] if isinstance(x, tuple)}
    flags = [optional for _, optional in wrapper]
    left = [x for x, _ in wrapper]
    grouped = _grouped(left, bodies)
    if len(grouped) != len(left):
        flags = _carried(left, flags, grouped)
        left = grouped
    right = _grouped(items, bodies)
    out = []
    for a, b in align(left, right):
        if b is None:
            out.append((left[a], True))
        elif a is None:
            out.append((right[b], True))
        elif left[a] == right[b] or isinstance(left[a], str):
            out.append((left[a], flags[a]))
        else:
            inner = merge([(x, False) for x in left[a][1]], list(right[b][1]))
            out.append((("+", tuple(x for x, _ in inner)), flags[a]))
    return out


def _carried(left: list, flags: list[bool], grouped: list) -> list[bool]:
    """Optional marks of the items after some of them were written as groups."""
    out, k = [], 0
    for item in grouped:
        if k < len(left) and left[k] == item:
            out.append(flags[k])
            k += 1
            continue
        size = len(item[1])
        out.append(all(flags[k : k + size]))
        k += size
        while k + size <= len(left) and tuple(left[k : k + size]) == item[1]:
            k += size
    return out


def slot_paths(items) -> list[tuple[str, ...]]:
    """Labels around every slot, in the order of the items."""
    stack, found = [], []
    for item in _plain(items):
        if item == "#":
            found.append(tuple(stack))
        elif item.startswith("</"):
            name = item[2:]
            if any(s.partition(".")[0] == name for s in stack):
                while stack.pop().partition(".")[0] != name:
                    pass
        else:
            stack.append(item[1:])
    return found


def verdicts(items) -> list[bool]:
    """Whether each slot holds main text.

    A slot inside of page furniture never does. Where any other slot lies in an article or main
    element, only such slots do.
    """
    clean, core = [], []
    for path in slot_paths(items):
        inside, good = False, True
        for label in path:
            good = good and not furniture(label, inside)
            inside = inside or label.partition(".")[0] in CORE
        clean.append(good)
        core.append(good and inside)
    return core if any(core) else clean


def judged(wrapper: list, items: list) -> list[bool]:
    """Verdicts of a page's slots: those of the wrapper's slots that they are aligned with."""
    left = [x for x, _ in wrapper]
    verdict = iter(verdicts(left))
    by_item = [[next(verdict) for y in _plain([x]) if y == "#"] for x in left]
    own = iter(verdicts(items))
    out = []
    partner = {b: a for a, b in align(left, items) if a is not None and b is not None}
    for k, item in enumerate(items):
        mine = [next(own) for y in _plain([item]) if y == "#"]
        theirs = by_item[partner[k]] if k in partner else []
        out += theirs if len(theirs) == len(mine) else mine
    return out if any(out) else verdicts(items)


def _frozen(value):
    return ("+", tuple(_frozen(x) for x in value[1])) if isinstance(value, list) else value


def items_of(text: str) -> list:
    return [_frozen(x) for x in json.loads(text)]


def page_key(host: str, shape: str) -> str:
    return hashlib.md5(f"{host}\n{shape}".encode()).hexdigest()


def page_shapes(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key of the folded stream, the stream, and the text blocks by slot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                page, url, source = (c[k].as_py() for c in batch.columns)
                host = host_of(url)
                items, slots, blocks = PageReader().read(source or "").result()
                shape = json.dumps(items, separators=(",", ":"))
                rows.append((page, url, host, page_key(host, shape), shape, slots, blocks))
            kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["page_id", "url", "host", "key", "shape", "slots", "blocks"],
            )

    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return chosen.mapInArrow(
        read,
        "page_id long, url string, host string, key string, shape string, slots array<int>, "
        "blocks array<string>",
    )


def infer_wrappers(shapes: DataFrame, salts: int = 16) -> DataFrame:
    """host and wrapper (JSON list of [item, optional]) from the distinct streams of each host."""

    def fold(streams: Iterator[list]) -> str:
        wrapper: list = []
        for items in streams:
            wrapper = merge(wrapper, items)
        return json.dumps(wrapper, separators=(",", ":"))

    def first(group):
        group = group.sort_values(["n", "shape"], ascending=[False, True])
        group["wrapper"] = fold(items_of(s) for s in group["shape"])
        return group[["host", "wrapper"]].head(1)

    def second(group):
        wrappers = [
            [(_frozen(x), o) for x, o in json.loads(w)] for w in sorted(group["wrapper"], key=lambda w: (len(w), w))
        ]
        whole = wrappers[0]
        for other in wrappers[1:]:
            items = [x for x, _ in other]
            optional = {k for k, (_, o) in zip(_kinds(items), other, strict=True) if o}
            whole = merge(whole, items)
            kinds = _kinds([x for x, _ in whole])
            whole = [(x, o or k in optional) for (x, o), k in zip(whole, kinds, strict=True)]
        group["wrapper"] = json.dumps(whole, separators=(",", ":"))
        return group[["host", "wrapper"]].head(1)

    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(salts)))
    parts = salted.groupBy("host", "salt").applyInPandas(first, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(second, "host string, wrapper string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    read = page_shapes(pages)
    shapes = stored(read.groupBy("host", "key", "shape").agg(F.count("*").alias("n")), "shapes")
    wrappers = stored(infer_wrappers(shapes), "wrappers")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            flags = []
            for shape, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text not in known:
                    known.clear()
                    known[text] = [(_frozen(x), o) for x, o in json.loads(text)]
                flags.append(judged(known[text], items_of(shape)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(flags, pa.list_(pa.bool_()))], names=["key", "flags"]
            )

    decided = stored(
        shapes.join(wrappers, "host").select("key", "shape", "wrapper").mapInArrow(
            judge, "key string, flags array<boolean>"
        ),
        "verdicts",
    )
    main = F.filter(
        F.arrays_zip("slots", "blocks"), lambda b: F.get(F.col("flags"), b["slots"])
    )
    text = F.array_join(F.transform(main, lambda b: b["blocks"]), "\n")
    joined = read.join(decided, "key", "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
    return joined.withColumn("n_chars", F.char_length("text").cast("long"))
