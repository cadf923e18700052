"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipmart.workload.tables import TABLE_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """Prefix *sql* with the table definitions it uses (``fx_<name>``)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_(\w+)", text):
            if name not in needed:
                visit(TABLE_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"fx_{n} as ({TABLE_SQL[n]})" for n in needed)
    body = sql.strip()
    match = re.match(r"with\s+(recursive\s+)?", body, flags=re.IGNORECASE)
    if match:
        return f"with {match.group(1) or ''}{ctes}, {body[match.end():]}"
    return f"with {ctes} {body}"


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, when given, its SQL twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[key] = with_tables(sql)
        return fn

    return add
