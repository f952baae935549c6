"""Manifests in the shape of real files, and what is refused."""

import copy

import pytest

from anisoframe.sources import manifests


def _box(a, b):
    return {"min": [a] * 3, "max": [b] * 3}


INDEX = {
    "version": "0.0.3", "totalLevels": 2,
    "root": {
        "boundingBox": _box(0, 9), "splatFiles": ["a.sog", "b.SPZ", "sky.ply"], "data": {"env": {"name": 2}},
        "child": {
            "0": {"boundingBox": _box(0, 4), "data": {"3dgs": {"name": 0, "start": 5, "count": 7}}, "child": {"7": {"boundingBox": _box(3, 6), "data": {"3dgs": {"name": 1, "start": 0, "count": 2}}}}},
            "1": {"boundingBox": _box(5, 9), "data": {"3dgs": {"name": 0, "start": 0, "count": 5}}},
            "2": {"boundingBox": _box(5, 9), "data": {"3dgs": {"name": 0, "start": 0, "count": 0}}},
        },
    },
}
LOD = {
    "version": 1, "lodLevels": 2, "filenames": ["f", "c"], "count": 9, "counts": [7, 2], "environment": "sky",
    "tree": {"bound": _box(0, 1), "children": [
        {"bound": _box(0, 2), "lods": {"0": {"file": 0, "offset": 0, "count": 3}, "1": {"file": 1, "offset": 0, "count": 2}}},
        {"bound": _box(0, 1), "lods": {"0": {"file": 0, "offset": 3, "count": 4}, "1": {"file": 0, "offset": 0, "count": 0}}},
    ]},
}


def changed(value, path, new):
    value = copy.deepcopy(value)
    at = value
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = new
    return value


def test_index():
    rows = manifests.index_rows(INDEX)
    assert [r[:6] for r in rows] == [(0, None, 1, "a.sog", 5, 7), (1, 0, 0, "b.SPZ", 0, 2), (2, None, 1, "a.sog", 0, 5), (3, None, 1, None, None, None)]
    assert rows[0][6:] == (0, 0, 0, 6, 6, 6)  # takes in its child
    assert manifests.environment_file(INDEX) == "sky.ply"


@pytest.mark.parametrize(("path", "new"), [
    (("version",), "1.0.0"), (("totalLevels",), 1), (("totalLevels",), 0), (("root", "splatFiles"), ["a.sog", "a.sog", "sky.ply"]),
    (("root", "splatFiles", 0), "a.txt"), (("root", "data", "env", "name"), 3), (("root", "child", "1", "data", "3dgs", "name"), 2),
    (("root", "child", "1", "data", "3dgs", "count"), 6), (("root", "child", "1", "boundingBox"), _box(2, 1)), (("root", "child", "1", "data", "3dgs", "start"), -1),
])
def test_index_refused(path, new):
    with pytest.raises(ValueError):
        manifests.index_rows(changed(INDEX, path, new))


def test_lod():
    rows = manifests.lod_rows(LOD)
    assert [r[:6] for r in rows] == [(0, None, None, None, None, None), (1, 0, 0, "f", 0, 3), (1, 0, 1, "c", 0, 2), (2, 0, 0, "f", 3, 4)]
    assert rows[0][9:] == (2, 2, 2)


@pytest.mark.parametrize(("path", "new"), [
    (("version",), 2), (("lodLevels",), 1), (("lodLevels",), 0), (("count",), 8), (("counts",), [7, 2, 0]), (("environment",), "f"), (("tree", "children"), []),
    (("tree", "lods"), {}), (("tree", "children", 1, "lods", "0", "offset"), 4), (("tree", "children", 0, "lods", "1", "file"), 0), (("tree", "children", 0, "bound"), _box(float("nan"), 1)),
])
def test_lod_refused(path, new):
    with pytest.raises(ValueError):
        manifests.lod_rows(changed(LOD, path, new))
