"""The forest learns from all labelled rows, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from anisoframe.llm import quality


def test_all_labelled_rows_teach(spark):
    """Bad ones whose ids' hashes are the largest of more than eight thousand are found like any."""
    good = " ".join(f"plain{k} words{k} stand{k} here{k}" for k in range(15))
    bad = " ".join(f"BUY{k}! NOW{k}! #{k}# ***{k}" for k in range(15))
    n = 8400
    order = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    spam = set(order[-300:])
    docs = spark.createDataFrame([(i, bad if i in spam else good) for i in range(n)], "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.col("text").startswith("plain").cast("int").alias("quality"))
    kept = {r.doc_id for r in quality.judged(docs, labels).where("kept").collect()}
    assert kept == set(range(n)) - spam
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept


def test_threshold_of_all_scores(spark):
    """The threshold is where plain search over all labelled rows' scores finds it, within a step."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        spoilt = rng.random() < 0.2
        words = [f"w{k}" + ("!" if rng.random() < (0.5 if spoilt else 0.05) else "") for k in range(int(rng.integers(60, 200)))]
        rows.append((i, " ".join(w.upper() if spoilt and rng.random() < 0.3 else w for w in words), int(not spoilt)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    every = quality.counted(docs)
    judge = quality.fit(every, docs)
    scores = judge.scores(np.array([r["counts"] for r in every.orderBy("id").collect()]))
    is_good = np.array([r[2] for r in rows], bool)

    def gain(limit):
        caught, wrong = ((scores[g] >= limit).mean() for g in (~is_good, is_good))
        return caught - wrong if wrong <= quality.FALSE_REJECTS else -1

    best = max(map(gain, [*scores, np.inf]))
    assert best > 0.5 and abs(gain(judge.threshold) - best) < 0.02
    assert {r.doc_id for r in quality.judged(docs, docs).where("NOT kept").collect()} == set(np.flatnonzero(scores >= judge.threshold).tolist())
