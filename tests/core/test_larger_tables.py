"""Queries whose budgets are fixed, over tables with more roots or blocks than these."""

import numpy as np
from pyspark.sql import functions as F
from test_merging import frame, made

from anisoframe.operators import merging
from anisoframe.operators import representatives as R
from anisoframe.plans import queries


def test_cut_below_one_root(spark, tmp_path):
    """More than 60 nodes of the first depth, and keys so large that nodes numbered a million apart would meet."""
    keys = [k << 12 for k in range(100)] + [(k << 12) + 64 * k for k in range(1, 40)] + [300_000_000 + (k << 8) for k in range(90)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    n = len({k >> 6 for k in keys})
    assert [tuple(r) for r in queries.queries()["relaxed_cut"](spark, str(tmp_path)).collect()] == [(n, n, True)]
    spark.createDataFrame([], "o_orderkey long").write.parquet(f"{tmp_path}/none/orders.parquet")
    assert [tuple(r) for r in queries.queries()["relaxed_cut"](spark, f"{tmp_path}/none").collect()] == [(0, 0, True)]


def test_quotas_of_more_blocks_than_the_target(spark):
    """Blocks of quota one stay whole, in pieces that a task can take, so that quotas add up to the target."""
    rows = frame(spark, made(np.random.default_rng(6), 900, crowd=0.3, copies=200))
    held, nodes = R.quota_blocks(rows, 7, limit=50)
    nodes, pieces = nodes.collect(), {r.piece: r.n for r in held.groupBy("piece").agg(F.count("*").alias("n")).collect()}
    blocks = {r.block: r.quota for r in nodes}
    assert sum(blocks.values()) == 7 and {r.piece: r.n for r in nodes} == pieces and max(pieces.values()) <= 50 and sum(pieces.values()) == 900
    assert all(r.piece.startswith(r.block) and (r.piece == r.block or r.quota == 1) for r in nodes)
    assert not any(a != b and a.startswith(b) for a in blocks for b in blocks)


def test_as_many_representatives_as_the_target(spark):
    rows = frame(spark, made(np.random.default_rng(6), 900, crowd=0.3, copies=200))
    for target in (1, 7):
        got = {r.id: r for r in R.representatives(rows, target, limit=50).collect()}
        reps = {r.rep for r in got.values()}
        assert len(got) == 900 and len(reps) == target and all(got[r].rep == r for r in reps)


def test_one_row_stands_for_many_pieces(spark):
    """Pieces are those of a path; the medoid of all is found where one of them outweighs the rest."""
    v = made(np.random.default_rng(8), 60)
    rows = frame(spark, v).withColumn("block", F.lit("k")).withColumn("piece", F.when(F.col("id") < 40, F.concat(F.lit("k0"), F.lpad(F.bin("id"), 6, "0"))).otherwise("k1"))
    other = rows.withColumns({"block": F.lit("z"), "piece": F.concat(F.lit("z"), F.substring("piece", 2, 2)), "id": F.col("id") + 100})
    got = {r.block: r.rep for r in R.stand_ins(rows.unionByName(other), limit=8).collect()}
    assert set(got) == {"k", "z"} and got["k"] < 100 <= got["z"]
    t, (w, size) = merging.terms(v), R.weights(v, np.full(60, 0.5))
    heavy = R.medoid(np.arange(40, 60), t, w, size)
    lone = rows.where(f"id >= 40 OR id = {int(w[:40].argmin())}")
    assert [r.rep for r in R.stand_ins(lone, limit=8).collect()] == [heavy]
