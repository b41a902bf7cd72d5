"""Shaping of raw result rows: renames, leftovers as a map, readable context text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import page_file_name

# Columns consumed by a result row and columns never shown as context.
CONSUMED = [
    "score", "search_type", "rag_context", "generated_cypher", "result_index", "source_url",
    "doc_source_url", "no_results", "error",
]
# Columns that place a row in its ranking; they stay columns.
PLACE = ["query_id", "rank", "doc_id"]
NOT_CONTEXT = ["score", "search_type", "generated_cypher", "result_index", "rag_context"]
LEADER_FILE = "Leaders.html"


def filter_ids(
    df: DataFrame,
    include: DataFrame | Sequence[int] | None = None,
    exclude: DataFrame | Sequence[int] | None = None,
    key: str = "query_id",
) -> DataFrame:
    """Keep included ids, then drop excluded ones; nothing left is an error."""
    if include is not None:
        df = (
            df.join(include.select(key), key, "left_semi")
            if isinstance(include, DataFrame)
            else df.where(F.col(key).isin(list(include)))
        )
    if exclude is not None:
        df = (
            df.join(exclude.select(key), key, "left_anti")
            if isinstance(exclude, DataFrame)
            else df.where(~F.col(key).isin(list(exclude)))
        )
    if df.isEmpty():
        raise ValueError("the id filters leave no query")
    return df


def not_blank(df: DataFrame, column: str = "query") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def derive_document_columns(docs: DataFrame, urls: DataFrame) -> DataFrame:
    """Title, relative source path and address of ``docs(path, text)``.

    ``urls(file_name, url)``; a file without address gets the empty string.
    """
    path = F.col("path")
    start = F.instr(path, "data")
    relative = F.when(
        start > 0, F.replace(path.substr(start, F.length(path)), F.lit("\\"), F.lit("/"))
    ).otherwise(path)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return (
        docs.withColumn("file_name", name)
        .withColumn("title", F.when(name == "", F.lit("unknown")).otherwise(stem))
        .withColumn("source_file", relative)
        .join(urls.select("file_name", F.col("url").alias("source_url")), "file_name", "left")
        .withColumn("source_url", F.coalesce("source_url", F.lit("")))
        .drop("path", "file_name")
    )


def is_vector_name(name: str) -> bool:
    return name == "embedding" or name.endswith("_embedding")


def drop_vectors(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_vector_name(c)])


def title_case(name: str) -> str:
    return name.replace("_", " ").title()


def format_context(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``Key: value`` lines in column order; nulls, blanks, metadata and vectors are left out."""
    shown = [
        c
        for c in (columns or df.columns)
        if c not in NOT_CONTEXT and not is_vector_name(c)
    ]
    lines = []
    for name in shown:
        value = F.col(name).cast("string")
        lines.append(
            F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{title_case(name)}: "), value))
        )
    return F.concat_ws("\n", *lines)


def with_context(
    df: DataFrame, search_type: str, field: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Context per row: the one it has, else the configured field, else formatted columns."""
    choices = [F.nullif(F.col("rag_context"), F.lit(""))] if "rag_context" in df.columns else []
    if field and field in df.columns:
        choices.append(F.nullif(F.col(field), F.lit("")))
    choices.append(format_context(df, columns))
    return df.withColumn("rag_context", F.coalesce(*choices)).withColumn(
        "search_type", F.lit(search_type)
    )


def _spelled(df: DataFrame, name: str) -> Column:
    """A value as text; lists, structs and maps as JSON."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(name) if nested else F.col(name).cast("string")


def to_result_rows(df: DataFrame) -> DataFrame:
    """(score, search_type, retrieved_text, source_url, fields): leftovers go into the map.

    A missing or null score is 0, a missing search type or text the empty string.
    """
    df = drop_vectors(df)
    have = set(df.columns)

    def given(name: str, kind: str, default: object) -> Column:
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default))

    urls = [F.nullif(F.col(c), F.lit("")) for c in ("source_url", "doc_source_url") if c in have]
    rest = [c for c in df.columns if c not in (*CONSUMED, *PLACE)]
    pairs = [x for c in rest for x in (F.lit(c), _spelled(df, c))]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        *[c for c in PLACE if c in have],
        given("score", "double", 0.0).alias("score"),
        given("search_type", "string", "").alias("search_type"),
        given("rag_context", "string", "").alias("retrieved_text"),
        (F.coalesce(*urls) if urls else F.lit(None).cast("string")).alias("source_url"),
        F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"),
    )


def flatten_joined(
    df: DataFrame, primary: str, others: Sequence[str]
) -> DataFrame:
    """Struct columns to flat ones: the primary's fields unprefixed, others ``<name>_<field>``."""
    columns = [F.col(f"{primary}.*")]
    for name in others:
        for field in df.schema[name].dataType.fieldNames():
            columns.append(F.col(f"{name}.{field}").alias(f"{name}_{field}"))
    return drop_vectors(df.select(*columns))


def split_fixed(df: DataFrame, fixed: Sequence[str], into: str = "entity_fields") -> DataFrame:
    """Fixed columns plus a map of the remaining non-null values."""
    rest = [c for c in df.columns if c not in fixed]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(
        *fixed, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias(into)
    )


def join_fixed(df: DataFrame, lists: Sequence[str], from_map: str = "entity_fields") -> DataFrame:
    """Inverse of :func:`split_fixed` as one map per row; empty lists are omitted."""
    entries = [
        F.struct(F.lit(c).alias("key"), F.array_join(c, ", ").alias("value")) for c in lists
    ]
    filled = F.filter(F.array(*entries), lambda e: e["value"] != "")
    return df.withColumn(
        "flat", F.map_concat(F.map_from_entries(filled), F.col(from_map))
    ).drop(*lists, from_map)


def card_properties(df: DataFrame, columns: Sequence[str]) -> Column:
    """Non-null properties of a card plus its page file name (one fixed file for leaders)."""
    file_name = F.when(F.col("card_type") == "leaders", F.lit(LEADER_FILE)).otherwise(
        page_file_name(F.col("card_name"))
    )
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    full = F.create_map(*pairs, F.lit("filename"), file_name)
    return F.map_filter(full, lambda _, v: v.isNotNull())
