"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Register a view the SQL twins may name."""
    VIEWS[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def expand(sql: str) -> str:
    """Put the views a statement names in front of it, in dependency order."""
    names = _needed(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, fn, expand(sql) if sql else None)
        return fn

    return register
