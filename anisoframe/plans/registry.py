"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapter import SPLATS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Head of SQL texts that read the adapter's rows as ``s``.
S = f"WITH s AS ({SPLATS_SQL})"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def fx(e: str, digits: int = 6) -> str:
    """SQL of ``fixed``: a double as a whole number of its last digit."""
    return f"CAST(floor(({e})*1e{digits}+0.5) AS BIGINT)"
