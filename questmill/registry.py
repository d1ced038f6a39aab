"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL."""

    def put(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return put


def load() -> None:
    """Import every module of plans, which registers its queries."""
    from .plans import audits, cascades, explorer, exams, joins, layout, library, numeric, ordered, phrases, rules, streams, texts  # noqa: F401


load()
