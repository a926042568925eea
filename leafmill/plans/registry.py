"""Registered queries: a plan over named inputs, and the DuckDB statement that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import BASE, DERIVED, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def needed(names) -> list[str]:
    """Derived inputs that names stand on, in order of definition."""
    todo, seen = list(names), set()
    while todo:
        n = todo.pop()
        if n in DERIVED and n not in seen:
            seen.add(n)
            todo += [d for d in DERIVED if d != n and f"FROM {d}" in DERIVED[n] or d != n and f"JOIN {d}" in DERIVED[n]]
    return [n for n in DERIVED if n in seen]


def query(name: str, *inputs: str, sql: str | None = None):
    """Register a plan; sql may use the inputs by name (and the base tables)."""

    def add(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(*[frame(spark, sf_dir, i) for i in inputs])

        run.__doc__, run.__name__ = plan.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            # DuckDB spells the digest function otherwise
            ctes = [f"{n} AS ({re.sub(r'sha2[(](.*), 256[)]', r'sha256(\1)', DERIVED[n])})" for n in needed(inputs)]
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                body, head = body[len("WITH RECURSIVE "):], "WITH RECURSIVE "
            elif body.upper().startswith("WITH "):
                body, head = body[len("WITH "):], "WITH "
            else:
                head = "WITH " if ctes else ""
                ORACLE[name] = head + ", ".join(ctes) + (" " if ctes else "") + body
                return plan
            ORACLE[name] = head + ", ".join([*ctes, body])
        return plan

    return add


__all__ = ["BASE", "ORACLE", "QUERIES", "query"]
