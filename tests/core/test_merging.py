"""Best partners against brute force, merges against moments, levels, and rows that are odd."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisoframe.functions import geometry as G
from anisoframe.operators import lod, merging, scenes


def made(rng, n, crowd=0.0, copies=0):
    """Rows of which a share lies in one cell of length one, and the last ones are copies of the first."""
    v = np.zeros((n, 13))
    v[:, :3] = rng.uniform(-4, 4, (n, 3))
    hot = rng.random(n) < crowd
    v[hot, :3] = rng.uniform(0.1, 0.9, (hot.sum(), 3))
    v[:, 3:6] = rng.integers(0, 5, (n, 3)) / 4
    v[:, 6:9] = np.exp(rng.uniform(-4, 0, (n, 3)))
    q = rng.normal(size=(n, 4))
    v[:, 9:] = q / np.linalg.norm(q, axis=1, keepdims=True)
    if copies:
        v[-copies:] = v[rng.integers(0, max(1, copies // 9), copies)]
    return v


def frame(spark, v, ids=None, opacity=0.5, **more):
    ids = range(len(v)) if ids is None else ids
    rows = [(int(i), *map(float, r), opacity) for i, r in zip(ids, v)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in merging.FIELDS) + ", opacity double").repartition(3)
    return df.withColumns({k: F.lit(x) for k, x in more.items()})


def brute(v, side, ids):
    """Of each row (best score, partners that have it) among the 27 cells."""
    t, cell = merging.terms(v), np.floor(v[:, :3] / side)
    out = {}
    for i in range(len(v)):
        near = np.flatnonzero((np.abs(cell - cell[i]) <= 1).all(axis=1) & (np.arange(len(v)) != i))
        if len(near):
            s = merging.similarity(np.repeat(t[i : i + 1], len(near), 0), t[near])
            out[ids[i]] = s.max(), {ids[k] for k in near[s >= s.max() - 1e-12]}, {ids[k]: x for k, x in zip(near, s)}
    return out


@pytest.mark.parametrize("n, crowd, copies, block, group", [(900, 0.4, 0, 8, 3), (900, 0.4, 300, 16, 64), (500, 0.0, 0, 256, 64), (400, 1.0, 100, 4, 2)])
def test_partners_equal_brute_force(spark, monkeypatch, n, crowd, copies, block, group):
    for name, value in (("BLOCK", block), ("GROUP", group), ("AT_ONCE", 5000)):
        monkeypatch.setattr(merging, name, value)
    rng = np.random.default_rng(n + block)
    v, ids = made(rng, n, crowd, copies), rng.permutation(10 * n)[:n].tolist()
    want = brute(v, 1.0, ids)
    got = {r.id: r for r in merging.best_partners(frame(spark, v, ids, l0=1, block="x", query=2), 1.0).collect()}
    assert set(got) == set(want)
    for i, (score, partners, _) in want.items():
        assert abs(got[i].score - score) < 1e-9 and got[i].partner in partners, i
    pairs = merging.mutual_pairs(merging.best_partners(frame(spark, v, ids), 1.0)).collect()
    assert all(p.a < p.b and got[p.a].partner == p.b and got[p.b].partner == p.a for p in pairs)
    assert len({x for p in pairs for x in (p.a, p.b)}) == 2 * len(pairs) > n / 4


def test_similarity_is_that_of_columns(spark):
    v = made(np.random.default_rng(1), 300)
    t = merging.terms(v)
    rows = lod.with_covariance(frame(spark, v)).select("id", *merging.FIELDS[:6], *lod.COVARIANCE)
    other = rows.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"o_{c}") for c in rows.columns[1:]))
    sides = (([F.col(p + c) for c in "xyz"], [F.col(p + c) for c in lod.COVARIANCE], [F.col(p + c) for c in "rgb"]) for p in ("", "o_"))
    own, theirs = sides
    got = {r.id: r.s for r in rows.join(other, "id").select("id", G.log_similarity(*own, *theirs).alias("s")).collect()}
    want = merging.similarity(t[:-1], t[1:])
    assert all(np.isclose(got[i], want[i], rtol=1e-6, atol=1e-9) for i in range(299))
    # No pair is more similar than the bounds of two boxes allow.
    boxes = [merging._bounds(t[k : k + 20], np.zeros(1, int))[0] for k in (0, 100)]
    most = merging._most(boxes[0][None], boxes[1][None])[0]
    assert most >= max(merging.similarity(np.repeat(t[i : i + 1], 20, 0), t[100:120]).max() for i in range(20))


def test_thin_and_flat_rows(spark):
    v = made(np.random.default_rng(3), 40)
    v[:10, 6] = 0
    v[5:15, 7] = 0
    v[20:, :3] *= 1e-3
    want = brute(v, 2.0, list(range(40)))
    got = {r.id: r.score for r in merging.best_partners(frame(spark, v), 2.0).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i][0]) <= 1e-6 * max(1, abs(want[i][0])) for i in want)


def test_merged_rows_have_the_moments(spark):
    v = made(np.random.default_rng(4), 60, copies=20)
    rows = frame(spark, v).withColumn("sh", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).when(F.col("id") % 3 == 1, F.array(F.lit(4.0))))
    links, merged = merging.merge_step(rows, 2.0)
    links = {r.id: r.parent for r in links.collect()}
    after = {r.id: r for r in merged.collect()}
    assert set(links) == set(range(60)) and set(after) == set(links.values()) and len(after) < 45
    t, w = merging.terms(v), merging.surface(v[:, 6:9]) * 0.5
    for p, r in after.items():
        own = [i for i, q in links.items() if q == p]
        total = w[own].sum()
        mean = (w[own, None] * v[own, :3]).sum(axis=0) / total
        d = v[own, :3] - mean
        cov = sum(w[i] * (np.array([[t[i, 6], t[i, 7], t[i, 8]], [t[i, 7], t[i, 9], t[i, 10]], [t[i, 8], t[i, 10], t[i, 11]]]) + np.outer(x, x)) for i, x in zip(own, d)) / total
        made_row = np.array([[getattr(r, c) for c in merging.FIELDS]])
        got = merging.terms(made_row)[0]
        assert np.allclose([r.x, r.y, r.z], mean) and np.isclose(r.weight, total) and len(own) <= 2
        assert np.allclose(got[6:12], cov[[0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]], rtol=1e-6, atol=1e-9)
        sh = [np.array({0: [1.0, 2.0], 1: [4.0, 0.0], 2: [0.0, 0.0]}[i % 3]) for i in own]
        want = sum(w[i] * s for i, s in zip(own, sh)) / total
        assert len(own) == 1 or np.allclose((r.sh + [0.0, 0.0])[:2], want)


NAN, INF = float("nan"), float("inf")


def test_rows_that_are_not_finite_and_equal_ones(spark):
    v = made(np.random.default_rng(6), 30)
    v[3, 0], v[4, 1], v[5, 2], v[6, 6], v[7, 9:] = NAN, INF, -INF, NAN, 0
    v[10:20] = v[10]
    rows = frame(spark, v)
    rows = rows.withColumn("z", F.when(F.col("id") != 8, F.col("z")))
    assert {r.id for r in merging.best_partners(rows, 50.0).collect()} == set(range(30)) - {3, 4, 5, 6, 8}
    assert lod.merge_groups(rows.withColumn("k", F.col("id") % 2), "k").count() == 2
    levels = scenes.built_levels(rows, root=3, factor=9).collect()
    assert [sum(r.level == k for r in levels) for k in range(4)] == [30, 4, 1, 0]
    ids = {(r.level, r.id) for r in levels}
    assert all((r.level + 1, r.parent) in ids if r.level < 2 else r.parent is None for r in levels)
    total = [sum(r.weight for r in levels if r.level == k) for k in range(3)]
    assert np.allclose(total, total[0])


def test_all_rows_equal_or_apart(spark):
    v = np.repeat(made(np.random.default_rng(7), 1), 33, axis=0)
    assert [r["count"] for r in scenes.built_levels(frame(spark, v), root=9, factor=2).groupBy("level").count().orderBy("level").collect()] == [33, 17, 9]
    v = made(np.random.default_rng(8), 6)
    v[:, 0] = 10.0 ** np.arange(0, 12, 2)
    assert [r["count"] for r in scenes.built_levels(frame(spark, v), root=2, factor=3).groupBy("level").count().orderBy("level").collect()] == [6, 2]
    assert scenes.built_levels(frame(spark, v).limit(0)).count() == 0 and scenes.built_levels(frame(spark, v), root=6).count() == 6


def test_a_round_is_quick(spark):
    rows = frame(spark, made(np.random.default_rng(9), 15_000)).checkpoint()
    merging.merge_round(rows).count()
    began = time.time()
    n = merging.merge_round(rows).count()
    assert n < 12_000 and time.time() - began < 60
