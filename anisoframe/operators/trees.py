"""Rules on trees and regions: quotas, byte accounts and page admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lit
from .lod import texture_bytes
from .running import running_totals

#: Rows of one page of a paged tree.
PAGE_ROWS = 65_536


def representative_quotas(blocks: DataFrame, target: int, size: str = "n") -> DataFrame:
    """``blocks`` with a quota: its share of ``target`` by rows, at least one and at most its rows.

    Shares are rounded half up; one number, the total, comes to the driver.
    """
    total = blocks.agg(F.sum(size)).first()[0]
    share = F.floor(F.col(size) * lit(target) / F.lit(total or 1) + lit(0.5)).cast("long")
    quota = F.least(F.greatest(share, F.lit(1).cast("long")), F.col(size).cast("long"))
    return blocks.withColumn("quota", quota)


def page_bytes(sh_degree: int, indexed: bool = False) -> Column:
    """Bytes of textures that one full page takes."""
    return texture_bytes(F.lit(PAGE_ROWS).cast("long"), sh_degree, indexed)


def admitted(pages: DataFrame, budget: int, order: list[str], cost: str = "bytes") -> DataFrame:
    """``pages`` that fit the byte budget in ascending ``order``, with the running total; all after the first misfit wait.

    Running totals are of range parts, so that no task holds the whole order.
    """
    return running_totals(pages, order, {"used": F.col(cost)}).where(F.col("used") <= budget)
