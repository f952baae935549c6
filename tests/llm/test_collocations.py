"""Phrases against brute force, SQL and whole numbers of any size."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from anisoframe.llm import collocations as C
from anisoframe.llm import queries

SF = "/root/testdata/sf0.001"


def brute(rows, max_words=3, min_count=10, limit=2000, subsumed=50):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            words[lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(a, inside.get((lang, p[i : i + k]), 0))
    out = {}
    for (lang, p), a in found.items():
        if 100 * inside.get((lang, p), -1) >= subsumed * a:
            continue
        score, k = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for lang, all_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:limit]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()])
    got = queries.op11_collocations(spark, SF)
    assert len(want) > 100 and rows_of(got) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    answer = con.execute(queries.oracle_sql()["op11_collocations"])
    assert sorted(answer.fetchall()) == want and [c[0] for c in answer.description] == got.columns


@pytest.mark.parametrize("max_words, limit, subsumed, shared", [(2, 5, 50, 0), (4, 30, 50, 1 << 20), (4, 30, 50, 0), (5, 1000, 100, 1600)])
def test_brute_force(spark, max_words, limit, subsumed, shared, monkeypatch):
    """Names that all tasks get, names that are joined, and one after the other."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "HELD", 40)
    monkeypatch.setattr(C, "SHARED", shared)
    rng = random.Random(max_words)
    words = ["Aa", "aa", "b", "ß", "漢字", "é", "c'est", "É", " x", "-", "100"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r\n", " ! "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None]), text))
    rows += [("en", None), ("fr", ""), (None, " \n. "), ("en", "same words here " * 40)] + [("de", "x y z w")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ("h", "n", "id", "k", "block", "codes", "grams", "left", "__word", "__uses", "f", "rank")})
    assert rows_of(C.collocations(docs, max_words, 10, limit, subsumed)) == brute(rows, max_words, 10, limit, subsumed)


def test_without_phrases(spark):
    for rows in ([], [("en", None)], [("en", "")], [(None, "one two three")], [("en", "a. " * 50)]):
        out = C.collocations(spark.createDataFrame(rows, "lang string, text string"))
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []


def test_a_very_long_text(spark):
    text = "one two three four " * 60_000
    got = rows_of(C.collocations(spark.createDataFrame([("en", text)], "lang string, text string")))
    assert got == brute([("en", text)])


def test_scores_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = rng.randrange(1, 10 ** rng.randrange(1, 16))
        rows.append((a, a + rng.randrange(0, 10 ** rng.randrange(1, 16)), a + rng.randrange(0, 10 ** rng.randrange(1, 16))))
    rows += [(10**15, 10**15, 10**15), (3, 3, 3), (10, 1000, 1000), (999_999_999_999, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.scored(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_blocks_of_any_cut():
    words, of, last = C.words_of([b"", b"A b.c\t d", b".", b"e"])
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e"] and of.tolist() == [1, 1, 1, 1, 3] and last.tolist() == [False, True, False, True, True]
    made = C.pair_block(1, np.array([0, 1, 0, 1, -1, 2, 0]), np.array([5, 6, -1]))
    assert made.column(2)[0].as_py() == [{"left": 5, "right": 6, "n": 2}, {"left": 6, "right": 5, "n": 1}] and made.column(1)[0].as_py() == [0, 1, 0]
