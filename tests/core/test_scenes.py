"""Cases of the operators on scenes of several levels."""

import numpy as np
from pyspark.sql import functions as F

from anisoframe.operators import lod, scenes


def test_mean_harmonics(spark):
    rows = spark.createDataFrame([(1, 2.0, [1.0, 4.0]), (1, 1.0, [4.0]), (2, 0.0, [2.0]), (2, 0.0, None), (3, 1.0, None)], "k int, w double, sh array<double>")
    got = {r.k: r.sh for r in lod.mean_harmonics(rows, "k", weight=F.col("w")).collect()}
    assert np.allclose(got[1], [2, 8 / 3]) and got[2] == [1.0] and got[3] is None


def test_leaf_order_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1.0, 1.0, 1.0), (2, "a", 0, 1.0, 1.0, 1.0), (3, "a", 0, float("nan"), 0.0, 0.0), (4, "b", 0, float("inf"), 0.0, 0.0)], "id int, region string, level int, x double, y double, z double")
    assert {r.id: r.place for r in scenes.leaf_order(rows).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_integer_widths(spark):
    rows = spark.createDataFrame([(1, 255), (2, 256), (3, 1 << 16), (4, 1 << 32), (5, -1)], "c int, v long")
    assert {r.c: r.bits for r in scenes.integer_widths(rows, "v", "c").collect()} == {1: 8, 2: 16, 3: 32, 4: None, 5: None}
