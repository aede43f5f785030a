"""Registry of named queries and of the SQL that checks each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import ROLES, Tables, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register ``f(tables)`` under its name; ``covers`` names the operators it shows.

    Role tables that the SQL mentions are put in front of it as common table expressions.
    """

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = with_roles(sql)
        return f

    return register


def with_roles(sql: str) -> str:
    used = [r for r in ROLES if re.search(rf"\b{r}\b", sql)]
    ctes = ", ".join(f"{r} AS ({duck_sql(r)})" for r in used)
    if not ctes:
        return sql
    body = sql.strip()
    if found := re.match(r"WITH\s+", body):
        return f"WITH {ctes}, {body[found.end() :]}"
    return f"WITH {ctes} {body}"
