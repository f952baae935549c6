"""Near duplicates and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from anisoframe.llm import simhash, suffix_dedup

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "ÄÖ", "été", "x1", "Zed,", "and", "river"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def plain_fingerprint(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def texts(seed):
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(8)]
    out = [None, "", " \n", "one", "One", "a b c"] + base + [base[0]] * 3
    for b in base[:4]:
        w = b.split(" ")
        for _ in range(6):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out.append(base[0] + " " + base[1])
    out.append("word " * 2000)
    out.append("xy" * 300)
    out.append("é" * 250 + base[2][:300])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame([(i, t, "fp", 1) for i, t in rows], "doc_id long, text string, component_id string, root int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t or "") for _, t in rows]
    label = plain_components(fps)
    for i, t in rows:
        assert got[i].fp % 2**64 == fps[i]
        assert got[i].component_id == min(j for j in range(len(rows)) if label[j] == label[i])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})


def test_dense_shards(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, shard=32).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    plain = plain_components(values)
    assert len({(find(v), p) for v, p in zip(values, plain)}) == len(set(plain)) == len({find(v) for v in values})


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "q w e r t"), (None, "q w e r t")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == [(1, "a b c d e"), (None, "q w e r t")]
    empty = df.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and suffix_dedup.measure(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def plain_removed(datas, length=200):
    where = {}
    for i, d in enumerate(datas):
        for o in range(len(d) - length + 1):
            where.setdefault(d[o : o + length], []).append((i, o))
    gone = [np.zeros(len(d), bool) for d in datas]
    for places in where.values():
        if len(places) > 1:
            for i, o in places:
                gone[i][o : o + length] = True
    return gone


def test_corpus_order():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab\x00c") for _ in range(40)) for _ in range(5)]
    texts = [b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(30)] + [b"aaaa" * 30, b"", b"a"]
    data, order = suffix_dedup.corpus_order(texts)
    ends = np.cumsum([len(t) for t in texts if t])
    tail = lambda i: data[i : ends[np.searchsorted(ends, i, side="right")]].tobytes()
    assert sorted(order.tolist()) == list(range(len(data)))
    # Places whose suffix is shorter than the parsing window may stand anywhere.
    tails = [t for t in map(tail, order.tolist()) if len(t) >= 8]
    assert tails == sorted(tails)


@pytest.mark.parametrize("kinds", [8192, 2])
def test_repeated_strings(spark, kinds, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    rng = random.Random(7)
    rows = [(i, t) for i, t in enumerate(texts(4))]
    shared = prose(rng, 60)
    for i in range(12):
        rows.append((100 + i, prose(rng, rng.randrange(5, 40)) + " " + shared[rng.randrange(20) : -1 - rng.randrange(60)] + " " + prose(rng, 30)))
    a = prose(rng, 40)[:199]
    rows += [(200, a), (201, a), (202, a + "!!"), (203, a + "!?"), (300, shared + "\n" + shared), (None, shared), (None, shared), (7, rows[9][1]), (301, "-" * 5000), (302, "ab\n" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    datas = [(t or "").encode() for _, t in rows]
    gone = plain_removed(datas)
    spans = suffix_dedup.repeat_spans(df, kinds=kinds)
    want = sorted(
        (str(i), len(d), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~g])).hexdigest())
        for (i, _), d, g in zip(rows, datas, gone)
    )
    monkeypatch.setattr(suffix_dedup, "repeat_spans", lambda *a, packed=None, **k: spans)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.measure(df).collect())
    assert got == want


def test_long_text_pieces():
    rng = random.Random(8)
    text = "".join(chr(97 + rng.randrange(26)) for _ in range(300_000)).encode()
    _, whole = suffix_dedup.triggers([text])
    _, part = suffix_dedup.triggers([text[100_000:200_000]])
    inner = whole[(whole >= 100_200) & (whole < 199_800)] - 100_000
    assert set(inner) <= set(part)
