"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def exact_rounding(sql: str) -> str:
    """Write each ``round_even(x, n)`` out as correct rounding of the binary value."""
    head, mark, tail = sql.partition("round_even(")
    if not mark:
        return sql
    depth, comma, end = 1, 0, 0
    for end, char in enumerate(tail):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 1:
            comma = end
        if depth == 0:
            break
    value, digits = exact_rounding(tail[:comma]), int(tail[comma + 1:end])
    shown = f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"
    return head + shown + exact_rounding(tail[end + 1:])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, the SQL that must give the same rows."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return function

    return add
