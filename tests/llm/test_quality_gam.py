"""The additive model: held-out accuracy, scores as plain look-ups, trees against brute force, odd rows."""

import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from anisoframe.llm import quality_gam as Q
from anisoframe.llm import queries

SF = "/root/testdata/sf0.01"


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_quality_gam(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(bad) >= 5 and auc > 0.98 and np.mean([got[i].predicted == q for i, q in labels.items() if got[i].held_out]) > 0.95


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "score": F.lit(1), "s": F.lit(2), "id": F.lit(3), "h": F.lit(4)})
    a, b = ({r.doc_id: r.score for r in Q.scores(d, l).collect()} for d, l in ((docs, labels), (other, turned)))
    assert a == b


def test_score_is_a_sum_of_look_ups():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(600, 4))
    rows[:, 3] = np.round(rows[:, 3])
    good = (rows[:, 0] > 0) ^ (rows[:, 1] > 0)  # no single statistic tells them apart
    m = Q.learn(rows, good)
    want = []
    for r in rows:
        total = m.base + sum(float(v[int((c <= x).sum())]) for c, v, x in zip(m.cuts, m.tables, r))
        for i, j, v in m.pairs:
            total += float(v[int((m.pair_cuts[i] <= r[i]).sum()), int((m.pair_cuts[j] <= r[j]).sum())])
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(m.score(rows), want) and (1, 0) in [p[:2] for p in m.pairs]
    test = rng.normal(size=(2000, 4))
    assert (((test[:, 0] > 0) ^ (test[:, 1] > 0)) == (m.score(test) > 0.5)).mean() > 0.93
    again = Q.learn(rows, good)
    assert np.array_equal(m.score(rows), again.score(rows))


def test_trees_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = rng.integers(3, 20, 7).astype(float)
        g, h = rng.normal(size=7) * n, rng.uniform(0.1, 0.3, 7) * n
        cost = lambda parts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + Q.CALM) for a, b in parts)
        fits = [k for k in range(1, 7) if n[:k].sum() >= Q.LEAST and n[k:].sum() >= Q.LEAST]
        best = max(fits, key=lambda k: cost([(0, k), (k, 7)]))
        want = np.concatenate([np.full(b - a, -g[a:b].sum() / (h[a:b].sum() + Q.CALM)) for a, b in ((0, best), (best, 7))])
        gains = cost([(0, best), (best, 7)]) > cost([(0, 7)])
        got = Q._tree(g, h, n, leaves=2)
        assert np.allclose(got, want) or not gains
        g, h, n = (rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5)), rng.integers(4, 9, (4, 5)).astype(float))
        gain, values = Q._quarters(g, h, n)
        cuts = [(x, y) for x in range(1, 4) for y in range(1, 5)]

        def quarters(x, y):
            return [(slice(0, x), slice(0, y)), (slice(0, x), slice(y, None)), (slice(x, None), slice(0, y)), (slice(x, None), slice(y, None))]

        each = {c: sum(g[q].sum() ** 2 / (h[q].sum() + Q.CALM) for q in quarters(*c) if n[q].sum() >= Q.LEAST) for c in cuts}
        top = max(each, key=each.get)
        assert np.isclose(gain, each[top] - g.sum() ** 2 / (h.sum() + Q.CALM))
        assert all(np.allclose(values[q], -g[q].sum() / (h[q].sum() + Q.CALM)) for q in quarters(*top) if n[q].sum() >= Q.LEAST)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "x", "x " * 200_000, "\x00 � 漢字", "a" * 300_000, "!!! ??? ***", "same line\n" * 50, "same line\n" * 50]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (4, None), (77, 1), (5, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    got = Q.scores(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = [r.score for r in got if r.doc_id in (8, 9)]
    empty = [r.score for r, t in zip(got, [*texts, "again"]) if not (t or "").strip()]
    assert same[0] == same[1] and len(set(empty)) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    for rows, prior in (([], 0.5), ([(4, 1), (6, 1)], None), ([(None, None)], 0.5)):
        out = Q.scores(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len({r.score for r in out}) == 1 and (prior is None or out[0].score == prior)
    assert Q.scores(docs.limit(0), labels).collect() == []


def test_combinations_of_statistics_are_finite():
    words = ["a", "B!", "***", "12", "é|", "\n", "Long" * 9]
    for k in (1, 2, 3):
        for c in combinations(words, k):
            assert np.isfinite(Q.statistics(" ".join(c).encode())).all()
