"""String functions as native column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public English stop-word list the lexical retrievers remove.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Characters a file name may not hold, and the file extension.
FORBIDDEN_IN_FILE_NAMES = r'[\\/:*?"<>|]'
PAGE_EXTENSION = ".html"

# Endings tried after the changed root of a one-word keyword.
INFLECTIONS = ["", "ing", "ed", "es", "s", "ied", "ies", "er", "ers", "ly"]

# Fixed value: stat names made of several words.
MULTI_WORD_STATS = ["Resist Snow"]

_TOKEN_BREAK = r'[\s\p{Z},:;!?()"\[\]{}]+'
_LETTERS_ONLY = r"^\p{L}+$"
_TRIMMED_WORD = r"^[^\p{L}\p{N}]*+(\p{L}+?)(?:'s|'re|'ve|'ll|'d|'m|n't)?[^\p{L}\p{N}]*+$"
_INDEX_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
#: A text of word characters only.
WHOLE_WORD = r"^[\p{L}\p{M}\p{N}_]+$"


def tokenize(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased, purely alphabetic tokens; words holding a digit or hyphen are dropped whole."""
    removed = ["", *stop_words]

    def clean(word: Column) -> Column:
        # most words need no trimming, so the slower pattern runs on the rest only
        return F.when(word.rlike(_LETTERS_ONLY), word).otherwise(
            F.regexp_extract(word, _TRIMMED_WORD, 1)
        )

    words = F.transform(F.split(F.lower(text), _TOKEN_BREAK), clean)
    return F.filter(words, lambda w: ~w.isin(removed))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text analyzer: words and numbers, stop words kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(_INDEX_TOKEN), F.lit(0))


def display_without_stop_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Whitespace words stripped of ``?.,!`` minus stop words; a dash when nothing is left."""
    words = F.transform(
        F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", "")
    )
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(list(stop_words)))
    joined = F.array_join(kept, " ")
    return F.when(joined == "", F.lit("—")).otherwise(joined)


def collapse_spaces(text: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column, block_marker: str | None = None) -> Column:
    """Newlines to spaces, markers to newlines, tidy spaces, at most one blank line in a row."""
    out = F.regexp_replace(text, r"\n", " ")
    if block_marker:
        out = F.replace(out, F.lit(block_marker), F.lit("\n"))
    out = F.regexp_replace(out, r"[\s\p{Z}&&[^\n]]+", " ")
    out = F.regexp_replace(out, r" ([.,;:!?])", "$1")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def meta_description(html: Column) -> Column:
    """Content of the description meta tag, null when the page has none."""
    found = F.regexp_extract(html, r'<meta name="description" content="([^"]*)"', 1)
    present = html.contains('<meta name="description" content="')
    return F.when(present, found)


def strip_tags(html: Column) -> Column:
    """Text of a fragment without nested structure: tags become spaces, spaces collapse."""
    return collapse_spaces(F.regexp_replace(html, r"<[^>]*>", " "))


def page_file_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, FORBIDDEN_IN_FILE_NAMES, ""), F.lit(PAGE_EXTENSION))


def page_url(name: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url), F.regexp_replace(name, r"\s+", "_"))


def stat_range(text: Column) -> Column:
    """``"5-9"`` -> (5, 9), ``"5"`` -> (5, 5), anything else -> nulls."""
    value = F.trim(text)
    low = F.when(value.rlike(r"^\d+(-\d+)?$"), F.regexp_extract(value, r"^(\d+)", 1))
    high = F.when(value.rlike(r"^\d+(-\d+)?$"), F.regexp_extract(value, r"(\d+)$", 1))
    return F.struct(low.try_cast("int").alias("low"), high.try_cast("int").alias("high"))


def typed_value(text: Column) -> Column:
    """Struct of the number (if all digits) and the raw text (null when blank)."""
    value = F.trim(text)
    number = F.when(value.rlike(r"^\d+$"), value).try_cast("int")
    return F.struct(number.alias("number"), F.nullif(value, F.lit("")).alias("raw"))


def parse_int(text: Column) -> Column:
    """Integer of a trimmed, optionally signed text; null when it is none."""
    value = F.trim(text)
    return F.when(value.rlike(r"^[+-]?\d+$"), value).try_cast("int")


def base_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def image_phase(image_ref: Column) -> Column:
    """Phase number carried by an image name; 1 for other images, null without one."""
    ref = F.try_url_decode(F.regexp_replace(image_ref, r"\+", "%2B"))
    ref = F.coalesce(ref, image_ref)
    digits = F.regexp_extract(ref, r"(?i)\([^)]*?(\d+)\)\.png", 1)
    return F.when(digits != "", digits.try_cast("int")).when(F.lower(ref).contains(".png"), F.lit(1))


def variant_type(name: Column, default: Column) -> Column:
    return (
        F.when(name.endswith("(Enemy)"), F.lit("non_boss_enemies"))
        .when(name.endswith("(Companion)"), F.lit("companions"))
        .otherwise(default)
    )


def other_stats(text: Column) -> Column:
    """Array of (name, value) held in a free-text stat list such as ``"x3 Frenzy, 2 Teeth"``."""

    def one_part(part: Column) -> Column:
        named = F.filter(F.array(*[F.lit(m) for m in MULTI_WORD_STATS]), lambda m: part.contains(m))
        rest = part
        for multi in MULTI_WORD_STATS:
            rest = F.trim(F.replace(rest, F.lit(multi), F.lit("")))
        label = F.trim(F.regexp_extract(rest, r"^x?(\d+)?\s*(.+)$", 2))
        number = F.regexp_extract(rest, r"^x?(\d+)?\s*(.+)$", 1)
        value = F.coalesce(F.nullif(number, F.lit("")).try_cast("int"), F.lit(1))
        single = F.filter(
            F.array(F.struct(label.alias("name"), value.alias("value"))), lambda s: s["name"] != ""
        )
        multi = F.transform(named, lambda m: F.struct(m.alias("name"), F.lit(1).alias("value")))
        return F.concat(multi, single)

    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(
        F.flatten(F.transform(parts, one_part)),
        F.array().cast("array<struct<name:string,value:int>>"),
    )


def keyword_name(name: Column) -> Column:
    """Drop the numeric placeholder ``X`` at the end of a keyword."""
    return F.when(F.length(name) > 1, F.regexp_replace(name, "X$", "")).otherwise(name)


def name_list(text: Column) -> Column:
    """Comma list to array; blank or ``none`` gives an empty array."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.array().cast("array<string>")
    return F.when(F.lower(F.trim(text)) == "none", empty).otherwise(F.coalesce(parts, empty))


def accepted_key(key: Column, renames: dict[str, str], accepted: Sequence[str]) -> Column:
    """Renamed key when it belongs to the accepted values, else null."""
    mapped = key
    if renames:
        pairs = [F.lit(x) for pair in renames.items() for x in pair]
        mapped = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    return F.when(mapped.isin(list(accepted)), mapped)


def keyword_forms(keyword: Column) -> Column:
    """Inflected forms of a one-word keyword ending in ``e`` or ``y`` (empty array for others)."""
    lowered = F.lower(keyword)
    root = (
        F.when(lowered.contains(" "), None)
        .when(lowered.endswith("e"), F.regexp_replace(lowered, "e$", ""))
        .when(lowered.endswith("y"), F.regexp_replace(lowered, "y$", "i"))
    )
    forms = F.transform(F.array(*[F.lit(s) for s in INFLECTIONS]), lambda s: F.concat(root, s))
    return F.when(root.isNotNull(), forms).otherwise(F.array().cast("array<string>"))


def urls_match(source_url: Column, reference: Column, exact: bool = False) -> Column:
    """Either address holds the other; an empty source never matches."""
    if exact:
        hit = source_url == reference
    else:
        hit = source_url.contains(reference) | reference.contains(source_url)
    return F.coalesce((source_url != "") & hit, F.lit(False))


def fill_template(template: Column, query: Column, context: Column | None = None) -> Column:
    filled = F.replace(template, F.lit("{{query}}"), F.coalesce(query, F.lit("")))
    if context is None:
        return filled
    return F.replace(filled, F.lit("{{context}}"), F.coalesce(context, F.lit("")))


def metric_key(name: Column) -> Column:
    return F.replace(name, F.lit("@"), F.lit("_at_"))


def padded_id(number: Column, width: int = 3) -> Column:
    """Zero-padded to at least ``width`` digits; longer numbers are kept whole."""
    return F.format_string(f"%0{width}d", number.cast("long"))
