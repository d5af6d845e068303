"""Registry of queries and of the DuckDB texts they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varuvakt.functions.text import LOWER, UPPER, WHITESPACE
from varuvakt.plans.fixtures import NOW_MS, VIEWS, Fixture, render
from varuvakt.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[Fixture], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the fixture views, with its check text if there is one.

    In the text, views become CTEs, ``{now}`` the fixed clock, ``TRIM(x)`` a
    Unicode white space trim and ``FOLD(x)`` ASCII lower case.
    """

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(Fixture(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    sql = sql.replace("{now}", str(NOW_MS))
    sql = _call(sql, "TRIM", lambda x: f"trim({x}, {blanks})")
    sql = _call(sql, "FOLD", lambda x: f"translate({x}, '{UPPER}', '{LOWER}')")
    sql = _call(sql, "CSV", csv_cell)
    sql = _call(sql, "BUCKET", lambda x: f"substr(md5({x}), 1, 3)")
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({render(v, 'duckdb').strip()})" for v in used]
    body = sql.strip()
    if not ctes:
        return body
    head, rest = ("WITH RECURSIVE ", body[len("WITH RECURSIVE ") :]) if body.startswith("WITH RECURSIVE ") else ("WITH ", body)
    if rest.startswith("WITH "):
        rest = rest[len("WITH ") :]
        return head + ",\n".join(ctes) + ",\n" + rest
    if head == "WITH RECURSIVE ":
        return head + ",\n".join(ctes) + ",\n" + rest
    return head + ",\n".join(ctes) + "\n" + rest


def csv_cell(x: str) -> str:
    text = f"coalesce(cast({x} AS varchar), '')"
    special = f"(contains({text}, '\"') OR contains({text}, ',') OR contains({text}, chr(13)) OR contains({text}, chr(10)))"
    return f"(CASE WHEN {special} THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END)"


def _call(sql: str, name: str, build: Callable[[str], str]) -> str:
    """Expand ``NAME(argument)`` with balanced parentheses."""
    while (match := re.search(rf"\b{name}\(", sql)) is not None:
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: match.start()] + build(sql[match.end() : end - 1]).replace(f"{name}(", f"{name.lower()}(") + sql[end:]
    return sql
