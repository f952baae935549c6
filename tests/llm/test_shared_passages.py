"""Texts that share a passage and little else make no pairs, however many they are and wherever they lie."""

import itertools

from anisoframe.llm import shingle_join


def test_passages_make_no_pairs(spark, monkeypatch):
    likely, seen = shingle_join._likely, []
    monkeypatch.setattr(shingle_join, "_likely", lambda pairs, *a: seen.append(pairs.count()) or likely(pairs, *a))
    passage = " ".join(f"licence{k}" for k in range(100))
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(60)) + " " + passage) for i in range(60)]
    rows += [(100 + i, text + " more") for i, text in rows[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    kept = shingle_join.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60)) and sum(seen) < len(rows)


def test_texts_of_passages_alone_make_few_pairs(spark, monkeypatch):
    """Texts put together from passages that many others have: their prefixes are of common shingles."""
    likely, seen = shingle_join._likely, []
    monkeypatch.setattr(shingle_join, "_likely", lambda pairs, *a: seen.append(pairs.count()) or likely(pairs, *a))
    passages = [" ".join(f"p{i}x{k}" for k in range(25)) for i in range(12)]
    rows = list(enumerate(map(" ".join, itertools.combinations(passages, 3))))
    kept = shingle_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert kept.count() == len(rows) and sum(seen) < 4 * len(rows)  # those of the rounds; none are left behind them
