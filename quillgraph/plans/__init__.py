"""Registered queries."""

from __future__ import annotations

from importlib import import_module

from quillgraph.plans.registry import QUERIES, SQL, Query

_MODULES = [
    "retrieval_queries",
    "evaluation_queries",
    "graph_queries",
    "text_queries",
    "page_queries",
]


def _load() -> None:
    for name in _MODULES:
        import_module(f"quillgraph.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
