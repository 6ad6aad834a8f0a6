"""The catalogue of queries: a Spark function and, where SQL can say the same, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import PRODUCTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, products: bool = True, name: str | None = None):
    """Registers a function under its name; with `products` the SQL may use that view."""

    def put(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            body = sql.strip()
            if products:
                body = f"WITH {PRODUCTS_SQL}{', ' + body[4:].lstrip() if body.upper().startswith('WITH') else ' ' + body}"
            ORACLES[key] = body
        return function

    return put


def register(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str | None, products: bool = True) -> None:
    query(sql, products, name)(function)
