"""Merges at places that need more than 20 bits."""

import numpy as np

from anisoframe.llm import bpe


def test_merges_beyond_a_mebibyte():
    # Symbols 1 2 -> 4 (rank 0), 4 3 -> 5 (rank 1), 0 3 -> 6 (rank 2); a long word of 0 with merges on both sides of 2**20.
    table = bpe.PairTable(np.array([[1, 2], [4, 3], [0, 3]], np.int64), np.array([4, 5, 6], np.int64), 7)
    edge = 1 << 20
    low, high = bpe.MergeTrees._leaf(np.array([0, 1]), np.array([edge + 60, 0]))
    assert low < high
    word = np.zeros(edge + 100, np.int64)
    for at in (7, edge - 2, edge + 10, edge + 60):
        word[at : at + 3] = (1, 2, 3)
    word[edge + 40] = 3
    merged = bpe.MergeTrees(word[None, :].copy(), table).run()[0]
    want = word.copy()
    for at in (7, edge - 2, edge + 10, edge + 60):
        want[at : at + 3] = (5, -1, -1)
    want[edge + 39 : edge + 41] = (6, -1)
    assert np.array_equal(merged, want)
