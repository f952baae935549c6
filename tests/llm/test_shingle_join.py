"""Near duplicates by shared shingles against brute force."""

import random

import pytest

import corpus_pipeline
from anisoframe.llm import shingle_join

SF = "/root/testdata/sf0.001"


def grams(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min((i is not None, i or 0) for (i, _), y in zip(rows, label) if y == x) for x in set(label))


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n", "one", "One", "a b c", "a  B c", "a b c d e"]
    licence = [f"licence{k}" for k in range(60)]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))] + licence * rng.randrange(2)
        for edits in (0, 0, 1, 2, 2, 3, 3, 4, 5, 6):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            out.append(" ".join(words[: len(words) - rng.randrange(20)]))
    return out


@pytest.mark.parametrize("stars", [3, 1, 0])
def test_all_similar_texts_are_found(spark, stars, monkeypatch):
    monkeypatch.setattr(shingle_join.similar_roots, "__defaults__", (*shingle_join.similar_roots.__defaults__[:-1], stars))
    rows = list(enumerate(texts(stars))) + [(None, "no id here at all"), (5, "repeated row"), (5, "repeated row")]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, mark int, best_id string")
    kept = shingle_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == plain_kept(rows)
    assert shingle_join.keep_one(df.where("false")).count() == 0


def test_stage_removes_copies_of_four_fifths(spark):
    """Of about 10 differing bits in 64, so that fingerprints at 4 bits keep both."""
    base = [f"word{i}" for i in range(204)]
    edited = [w if i not in (40, 80, 120, 160) else "x" + w for i, w in enumerate(base)]
    less = [w if i not in (30, 60, 90, 120, 150) else "x" + w for i, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(less))], "doc_id long, text string")
    assert 5 * len(grams(" ".join(base)) & grams(" ".join(edited))) >= 4 * len(grams(" ".join(base)) | grams(" ".join(edited)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [1, 3]


def test_sketches_rule_out_no_similar_pair():
    rng = random.Random(4)
    sets = [shingle_join.shingles(" ".join(f"w{rng.randrange(3000)}" for _ in range(n)).encode()) for n in (1, 3, 5, 60, 90, 700, 900, 5000)]
    for a in list(sets):
        for share in (0.95, 0.9, 0.8, 0.5):
            sets.append(a[: max(1, int(share * len(a)))])
    ruled_out = 0
    for a in sets:
        for b in sets:
            may = shingle_join.may_be_similar(shingle_join.sketch(a), shingle_join.sketch(b))
            assert may or not shingle_join.similar(a, b)
            ruled_out += not may
    assert ruled_out > len(sets) ** 2 / 2
