"""Query registry and the SQL text shared by the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Prefix a statement with the named sub-queries it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in CTES and word != own and word not in order:
                visit(CTES[word], word)
                order.append(word)

    visit(sql, None)
    if not order:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + sql.strip()


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return add
