"""Registry of runnable queries and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.sqlviews import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Statements that take DuckDB too long at the contract's draws; compared at a few draws (scripts/verify.py --draws 6).
DRAWN_ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a query with the shared views it mentions, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    body = sql.strip()
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None, *, drawn: bool = False):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with an optional DuckDB statement; ``drawn``: one for few draws only."""

    def wrap(fn):
        from tidemark.plans.fixtures import Inputs

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            (DRAWN_ORACLES if drawn else ORACLES)[name] = with_views(sql)
        return fn

    return wrap


__all__ = ["DRAWN_ORACLES", "ORACLES", "QUERIES", "query", "with_views"]
