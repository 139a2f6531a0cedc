"""Query catalogue: name -> Spark plan builder, and name -> DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The
oracle SQL is written independently in plain SQL over the same driver
tables, so the two can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's returns BIGINT."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def query(name: str, ids: str, sql: str | None = None):
    """Register a query; ``ids`` lists the survey operator IDs it covers."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLE[name] = _bigint_count_if(sql)
        return fn
    return deco


def load_all() -> None:
    from . import q_payroll, q_postings, q_calls, q_history, q_pages, q_built_pages, q_io, q_rules, q_sketches, q_stored  # noqa: F401
