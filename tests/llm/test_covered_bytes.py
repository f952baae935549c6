"""Only what strings of a trigger cover is put in order, and their repeats are those of brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from anisoframe.llm import suffix_dedup as sd


def phrases(seed):
    """(trigger, phrase, place of the trigger) of near copies, and how often each occurs."""
    rng, found = random.Random(seed), Counter()
    for _ in range(6):
        base = bytes(rng.choice(b"abcdefgh ") for _ in range(900)) + b"xy" * 200
        for edits in (1, 1, 2, 3):
            text = bytearray(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = 33 + rng.randrange(9)
            for at in sd.triggers([bytes(text)])[1].tolist():
                left = max(0, at - (sd.LENGTH - sd.TRIGGER))
                found[bytes(text[at : at + sd.TRIGGER]), bytes(text[left : at + sd.LENGTH]), at - left] += 1
    return sorted(found.items())


def test_only_covered_bytes_are_ordered(monkeypatch):
    rows = phrases(3)
    ordered, order = [], sd.corpus_order
    monkeypatch.setattr(sd, "corpus_order", lambda texts, **k: ordered.append(sum(map(len, texts))) or order(texts, **k))
    table = pa.table({
        "id": range(len(rows)), "mark": [0] * len(rows), "left": [1000 * i for i in range(len(rows))],
        "at": [at for (_, _, at), _ in rows], "n": [n for _, n in rows], "bytes": [data for (_, data, _), _ in rows],
    })
    found = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in sd._order_batch(table).to_pylist()}
    assert sum(ordered) < 0.9 * sum(len(data) for (_, data, _), _ in rows)

    strings, starts = Counter(), []
    for (_, data, at), n in rows:
        starts.append(sd._with_trigger(data, at).tolist())
        for s in starts[-1]:
            strings[data[s : s + sd.LENGTH]] += n
    expected = {}
    for i, ((_, data, _), n) in enumerate(rows):
        again = np.array([s for s in starts[i] if n == 1 and strings[data[s : s + sd.LENGTH]] > 1])
        if len(again):
            runs = np.split(again, np.flatnonzero(np.diff(again) > sd.LENGTH) + 1)
            expected[i] = [(1000 * i + int(r[0]), 1000 * i + int(r[-1]) + sd.LENGTH) for r in runs]
    assert found == expected and expected
