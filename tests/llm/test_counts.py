"""Counts of packed keys against plain ones, without a row for each; and what a worker remembers goes with the next step."""

from collections import Counter

import numpy as np

from anisoframe.llm import bpe, common, shingle_join


def test_counts_of_packed_keys(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK", 500)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, 60)) for _ in range(80)] + [None, "", "one"]
    plain = Counter(k for t in texts for k in shingle_join.shingles((t or "").encode(), 3).view(np.int64).tolist())
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for least in (1, 2, 9):
        found = shingle_join._counts(df, lambda rows: [shingle_join.shingles(t, 3) for t in common.as_bytes(rows)], least)
        assert {r.key: r.n for r in found.collect()} == {k: n for k, n in plain.items() if n >= least}
    assert shingle_join._counts(df.where("false"), lambda rows: [], 1).count() == 0


def test_keys_travel_packed():
    import pyarrow as pa

    values = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 20_000, np.uint64)) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30))], names=["at"])
    rows = sum(b.num_rows for b in shingle_join._dealt(lambda at: [values[k] for k in at.to_pylist()])(iter([batch])))
    assert rows < 30 * 20_000 / 50


def test_another_step_forgets(monkeypatch):
    monkeypatch.setitem(bpe._LOADED, "path", object())
    common.turn("bpe")
    assert "path" in bpe._LOADED
    common.turn("count")
    assert not bpe._LOADED and not bpe._NAMES
