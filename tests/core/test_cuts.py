"""Cuts with relaxation and promoted ranges against plain recursion."""

import math
import random

import pytest

from anisoframe.operators import cuts


def grown(rng, n, roots=2):
    """(node, parent, size) of a random tree in which some nodes are larger than their parents."""
    rows = [(k, None, rng.uniform(1, 4000)) for k in range(roots)]
    for k in range(roots, n):
        parent = rng.randrange(max(0, k - 30), k)
        rows.append((k, parent, rows[parent][2] * rng.choice([0.1, 0.5, 0.9, 1.5])))
    return rows


@pytest.mark.parametrize("seed, budget, threshold", [(1, 40, 1.0), (2, 200, 1.0), (3, 1000, 0.5), (4, 2, 1.0), (5, 25, 3000.0)])
def test_cut(spark, seed, budget, threshold):
    rows = grown(random.Random(seed), 300)
    cut = {r.node for r in cuts.relaxed_cut(spark.createDataFrame(rows, "node long, parent long, size double"), budget, threshold).collect()}
    up = {k: p for k, p, _ in rows}
    size = {k: s for k, _, s in rows}
    inner = set(up.values()) - {None}
    key = {}
    for k, p, s in rows:
        key[k] = s if p is None else min(s, key[p])
    assert 2 <= len(cut) <= int(budget * 1.1)
    refined = set()
    for leaf in set(up) - inner:
        path = [leaf]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        hits = [k for k in path if k in cut]
        assert len(hits) == 1
        refined |= set(path[path.index(hits[0]) + 1 :])
    assert all(key[k] > threshold for k in refined)
    kids = {k: sum(p == k for p in up.values()) for k in inner}
    if len(cut) < budget:  # then nothing is left to refine, or the next one in order does not fit
        left = sorted((-key[k], k) for k in inner - refined if key[k] > threshold)
        assert not left or any(len(cut) + kids[k] - 1 > int(budget * 1.1) for _, k in left)
    order = math.inf if not refined else min(key[k] for k in refined)
    assert all(key[k] <= order * 2 ** (1 / 64) for k in inner - refined)


def test_cut_of_little(spark):
    empty = spark.createDataFrame([], "node long, parent long, size double")
    assert cuts.relaxed_cut(empty, 5).collect() == []
    one = spark.createDataFrame([(7, None, 9.0)], "node long, parent long, size double")
    assert [r.node for r in cuts.relaxed_cut(one, 1).collect()] == [7]
    with pytest.raises(ValueError):
        cuts.relaxed_cut(spark.createDataFrame([(7, None, 9.0), (8, None, 9.0)], "node long, parent long, size double"), 1)


def test_promotion(spark):
    tree = [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2), (4, 1, 2), (5, 2, 2), (6, 2, 2)]
    ranges = [(3, 0, 0, 0, 50), (4, 0, 0, 50, 60), (5, 0, 0, 110, 5), (6, 0, 1, 0, 7), (3, 1, 2, 0, 10), (4, 1, 2, 10, 10), (5, 1, 2, 20, 1), (6, 1, 2, 21, 1), (3, 2, 3, 0, 1), (6, 2, 3, 2, 1)]
    t = spark.createDataFrame(tree, "node long, parent long, depth int")
    r = spark.createDataFrame(ranges, "node long, level int, file long, start long, count long")
    got = {(x.node, x.level): (x.file, x.start, x["count"]) for x in cuts.promoted(t, r).collect()}
    assert got[1, 0] == (0, 0, 110) and got[2, 0] == (-1, 0, 12) and got[0, 0] == (-1, 0, 122) and got[0, 1] == (2, 0, 22) and got[1, 2] == (3, 0, 1) and got[0, 2] == (-1, 0, 2)
    shown = {(x.node, x.level): (x.file, x["count"], x.up_node, x.up_level) for x in cuts.shown_ranges(t, r, 3, most=110).collect()}
    # Level 2 is in pieces at the root, so it is shown below; the node 1 shows all its levels, the leaves of 2 what is left.
    assert shown[1, 2] == (3, 1, None, None) and shown[1, 1] == (2, 20, 1, 2) and shown[1, 0] == (0, 110, 1, 1)
    assert shown[2, 2][1] == 1 and shown[2, 1] == (2, 2, 2, 2) and shown[5, 0] == (0, 5, 2, 1) and shown[6, 0] == (1, 7, 2, 1)
    assert set(shown) == {(1, 2), (1, 1), (1, 0), (2, 2), (2, 1), (5, 0), (6, 0)}
    assert cuts.promoted(t.limit(0), r).collect() == []
