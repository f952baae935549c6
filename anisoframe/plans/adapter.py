"""Gaussians made from the test tables, exactly the same in any engine: all values are small dyadic fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _cases(key: str, values: list[float]) -> str:
    head = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CAST(CASE {key} {head} ELSE {values[-1]} END AS DOUBLE)"


def _place(key: str, factor: int) -> str:
    return f"CAST(({key}*{factor}) % 1000 AS DOUBLE)/CAST(8 AS DOUBLE) - CAST(62.5 AS DOUBLE)"


_SCALES = [1.0, 0.5, 0.25, 2.0]
#: Columns over ``orders``; the text is plain SQL.
SPLATS = {
    "id": "o_orderkey", "x": _place("o_orderkey", 7919), "y": _place("o_custkey", 104729), "z": _place("o_orderkey", 15485863),
    "opacity": "CAST((o_orderkey % 25) + 1 AS DOUBLE)/CAST(16 AS DOUBLE)", "r": "CAST(o_custkey % 256 AS DOUBLE)/CAST(256 AS DOUBLE)",
    "g": "CAST((o_orderkey*31) % 256 AS DOUBLE)/CAST(256 AS DOUBLE)", "b": "CAST((o_orderkey*17) % 256 AS DOUBLE)/CAST(256 AS DOUBLE)",
    "sx": _cases("o_orderkey % 4", _SCALES), "sy": _cases("o_custkey % 4", _SCALES), "sz": _cases("(o_orderkey + o_custkey) % 4", _SCALES),
    "qx": _cases("o_orderkey % 3", [0.0, 1.0, 0.5]), "qy": _cases("o_orderkey % 3", [0.0, 0.0, 0.5]), "qz": _cases("o_orderkey % 3", [0.0, 0.0, 0.5]),
    "qw": _cases("o_orderkey % 3", [1.0, 0.0, 0.5]), "segment": "CAST(o_orderkey % 7 AS INT)", "label": "o_orderstatus",
}
SPLATS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in SPLATS.items()) + " FROM orders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in SPLATS.items()))
