"""Queries that write files of the test tables' rows and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import fixed, lit
from ..operators import codebooks
from ..operators.running import checkpoint_folder
from ..sources import rad
from .adapter import splats
from .registry import S, fx, query

_E = 2.718281828459045
#: SQL of an opacity kept as an alpha in half precision: a whole number of 1024ths between one and two.
_ALPHA = f"(round_even(least(2, 1 + 0.25::DOUBLE * (sqrt(1 + {_E}::DOUBLE * ln(greatest(opacity, 1))) - 1)) * 1024, 0) / 1024)"
_OPACITY = f"CASE WHEN opacity > 1 THEN exp((pow(4 * {_ALPHA} - 3, 2) - 1) / {_E}::DOUBLE) ELSE opacity END"


def _size(s: str) -> str:
    """SQL of the code of a half-axis between -12 and 9 in 254 steps."""
    return f"CAST(1 + floor((ln({s}) + 12) / 21 * 254 + 0.5::DOUBLE) AS BIGINT)"


@query(S + f""" SELECT row_number() OVER (ORDER BY id) - 1 AS id, (row_number() OVER (ORDER BY id) - 1) // 4096 AS chunk, x, y, z, {fx(_OPACITY, 4)} AS opacity,
{', '.join(f"CAST(floor({c} * 255 + 0.5::DOUBLE) AS BIGINT) AS {c}" for c in 'rgb')}, {', '.join(f"{_size(s)} AS {s}" for s in ('sx', 'sy', 'sz'))} FROM s""")
def rad_roundtrip(spark, sf_dir):
    """Rows written as a paged file, whose chunks are read back: places as they are, colours and half-axes as their codes."""
    uri = f"{checkpoint_folder(spark)}/rad-{uuid.uuid4().hex}/scene.rad"
    rad.write_rad(splats(spark, sf_dir), uri, ["id"], chunk=4096)
    rows = rad.read_rad(spark, uri, ["id", "chunk", "x", "y", "z", "opacity", "r", "g", "b", "sx", "sy", "sz"])
    code = lambda v: F.floor(v + lit(0.5)).cast("long")
    sizes = [code(F.ln(F.col(s)) * lit(254 / 21) + lit(12 * 254 / 21 + 1)).alias(s) for s in ("sx", "sy", "sz")]
    return rows.select("id", "chunk", "x", "y", "z", fixed(F.col("opacity"), 4).alias("opacity"), *(code(F.col(c) * lit(255)).alias(c) for c in "rgb"), *sizes)


_HALF = "CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2, floor(log2(abs(v))) - 10), 0) * pow(2, floor(log2(abs(v))) - 10) END"
_RANKS = {"low": 0.01, "middle": 0.5, "high": 0.99}


@query(S + f""", u AS (SELECT CAST(CAST(unnest([x * sx / 7, y * sy / 7, z * sz / 7]) AS FLOAT) AS DOUBLE) AS v FROM s), h AS (SELECT {_HALF} AS v FROM u),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place, count(*) OVER () AS n FROM h)
SELECT {', '.join(f"max(CASE WHEN place = least(n - 1, floor(CAST(CAST(n AS FLOAT) * CAST({p} AS FLOAT) AS DOUBLE) + 0.5::DOUBLE)) THEN v END) AS {k}" for k, p in _RANKS.items())} FROM o""")
def half_percentiles(spark, sf_dir):
    values = [F.col(a) * F.col(f"s{a}") / lit(7) for a in "xyz"]
    return codebooks.half_percentiles(splats(spark, sf_dir), values, _RANKS)
