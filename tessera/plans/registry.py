"""Queries by name: the DataFrame, the oracle's SQL, the operators that a query shows."""

from __future__ import annotations

from collections.abc import Callable

from .bind import DUCK, Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(ids: str, sql: str | None = None):
    """Register a function of Tables under its name.  {batches} and {results} in SQL stand for the bound roles."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        OPERATORS[name] = tuple(ids.split())
        if sql:
            for role, text in DUCK.items():
                sql_text = SQL.get(name, sql)
                SQL[name] = sql_text.replace("{" + role + "}", f"({text})")
        return f

    return add
