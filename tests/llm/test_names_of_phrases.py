"""Names that every task can give, and what tasks hold of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from anisoframe.llm import collocations as C


def test_names_are_those_of_spark(spark):
    rows = [("en", "a"), ("und", "ß" * 40), ("de", ""), ("漢", "x y")]
    want = [r.h for r in spark.createDataFrame(rows, "lang string, word string").select(F.xxhash64("lang", "word").alias("h")).collect()]
    lang, word = (pa.array(c) for c in zip(*rows))
    assert C.names_of(pa.StructArray.from_arrays([lang, word], names=["lang", "word"])).tolist() == want
    pairs = [(0, 0), (-1, 1), (1 << 62, -(1 << 63)), (want[0], want[1])]
    want = [r.h for r in spark.createDataFrame(pairs, "left long, right long").select(F.xxhash64("left", "right").alias("h")).collect()]
    left, right = (pa.array(c, pa.int64()) for c in zip(*pairs))
    assert C.names_of(pa.StructArray.from_arrays([left, right], names=["left", "right"])).tolist() == want


def test_what_tasks_get_is_bounded(spark, monkeypatch):
    """However many names there are, and none of them is missed."""
    monkeypatch.setattr(C, "SHARED", 4096)
    names = spark.range(40_000).select(F.xxhash64("id").alias("id"))
    members = C.frequent_set(names)
    ids = np.array([r.id for r in names.collect()])
    assert members.nbytes <= C.SHARED and C.held_bits(members, ids).all()
    few = C.frequent_set(names.limit(20))
    others = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 10_000)
    assert few.nbytes <= C.SHARED and C.held_bits(few, others).sum() < 500
