"""Registered queries of the spatial engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, levels, rows, scenes, space, trees  # noqa: F401 - each module registers its queries
from .adapter import splats
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are valid and within a sphere, with the bounds of their segment."""
    from ..operators.filters import retain
    from ..operators.spatial import full_bounds

    kept = retain(splats(spark, sf_dir), rows.SPHERE)
    return kept.join(full_bounds(kept, "segment"), "segment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
