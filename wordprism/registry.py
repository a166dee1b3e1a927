"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, its oracle."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def cte(name: str, body: str) -> None:
    """A named part that oracles may use; parts may use earlier parts."""
    CTES[name] = body


def full_sql(body: str) -> str:
    """Put the parts that ``body`` mentions in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} as materialized ({CTES[name]})" for name in CTES if name in needed]
    recursive = "recursive " if re.search(r"^\s*recursive\b", body) else ""
    body = re.sub(r"^\s*recursive\b", "", body)
    own = re.match(r"\s*with\s+(.*)", body, re.S)
    if own:
        return f"with {recursive}" + ",\n".join([*parts, own.group(1)])
    return (f"with {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
