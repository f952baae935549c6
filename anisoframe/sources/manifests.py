"""Scene manifests: trees of file ranges in JSON, flattened to rows. A manifest is metadata, far smaller than its scene."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import accumulate
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHAPE = "node long, parent long, level int, file string, start long, count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def _count(value, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or not 0 <= value < 1 << 53:
        raise ValueError(f"{what}: {value!r} is no count")
    return int(value)


def _bounds(box: dict) -> list[float]:
    sides = [list(map(float, box[side])) for side in ("min", "max")]
    if any(len(s) != 3 or not all(map(isfinite, s)) for s in sides) or any(a > b for a, b in zip(*sides)):
        raise ValueError(f"{box!r} is no box")
    return sides[0] + sides[1]


def _flat(tops: list[dict], below: Callable[[dict], list[dict]], box: str) -> list[list]:
    """[node, parent, depth, bounds] of all nodes of a forest, each behind its parent; bounds take in those below."""
    out, waiting = [], [(t, None, 1) for t in reversed(tops)]
    while waiting:
        node, parent, depth = waiting.pop()
        waiting += [(c, len(out), depth + 1) for c in reversed(below(node))]
        out.append([node, parent, depth, _bounds(node[box])])
    for _, parent, _, b in reversed(out):
        if parent is not None:
            up = out[parent][3]
            up[:] = [*map(min, up[:3], b[:3]), *map(max, up[3:], b[3:])]
    return out


def _by_file(rows: list[tuple]) -> dict[str, list[tuple[int, int, int]]]:
    """file: (start, count, level) of its ranges, in order."""
    found: dict[str, list] = {}
    for _, _, level, file, start, count, *_ in rows:
        if file is not None:
            found.setdefault(file, []).append((start, count, level))
    return {f: sorted(r) for f, r in found.items()}


def lod_rows(manifest: dict) -> list[tuple]:
    """Rows (node, parent, level, file, start, count, bounds) of a binary tree whose leaves list a range for each level.

    Version 1, or none; the latter may lack ``lodLevels``. Inner nodes have two children and no ranges. Empty ranges are
    left out. The ranges of a file are of one level and follow each other without gaps or overlaps. Totals that the
    manifest states (``count``, ``counts``) must hold, and its environment is no file of the tree.
    """
    version, levels = manifest.get("version"), manifest.get("lodLevels")
    if version not in (None, 1) or version == 1 and levels is None:
        raise ValueError(f"version {version!r} with {levels!r} levels")
    if levels is not None and not _count(levels, "lodLevels"):
        raise ValueError("no levels")
    files, rows = manifest["filenames"], []

    def below(node: dict) -> list[dict]:
        children = node.get("children")
        if children is None:
            return []
        if "lods" in node or len(children) != 2:
            raise ValueError("an inner node has two children and no ranges")
        return children

    for me, (node, parent, _, box) in enumerate(_flat([manifest["tree"]], below, "bound")):
        ranges = []
        for name, r in (node["lods"] if "children" not in node else {}).items():
            if not name.isascii() or not name.isdigit() or str(int(name)) != name or levels is not None and int(name) >= levels:
                raise ValueError(f"level {name!r}")
            if _count(r["count"], "count"):
                file = _count(r["file"], "file")
                if file >= len(files):
                    raise ValueError(f"file {file}")
                ranges.append((int(name), files[file], _count(r["offset"], "offset"), int(r["count"])))
        rows += [(me, parent, *r, *box) for r in ranges or [(None, None, None, None)]]
    for name, ranges in _by_file(rows).items():
        starts = [0, *accumulate(n for _, n, _ in ranges)]
        if [s for s, _, _ in ranges] != starts[:-1] or len({k for _, _, k in ranges}) > 1:
            raise ValueError(f"{name}: ranges must cover one level without gaps or overlaps")
    totals = Counter()
    for r in rows:
        totals[r[2]] += r[5] or 0
    if manifest.get("count", totals.total()) != totals.total():
        raise ValueError("count")
    if "counts" in manifest and manifest["counts"] != [totals[k] for k in range(levels if levels is not None else len(manifest["counts"]))]:
        raise ValueError("counts")
    if manifest.get("environment") in _by_file(rows):
        raise ValueError("the environment is a file of the tree")
    return rows


def index_rows(index: dict) -> list[tuple]:
    """The same of the n-ary index of version 0.0.x, where a node has at most one range.

    Files are listed in ``root.splatFiles`` and named by place; children are the values of ``child`` (an object or an
    array), ranges lie in ``data["3dgs"]``. The root itself is no node; below it levels fall from ``totalLevels - 1``.
    Ranges of a file must not overlap, and none is of the environment's file.
    """
    if not re.fullmatch(r"0\.0\.[0-9]+", str(index.get("version"))):
        raise ValueError(f"version {index.get('version')!r}")
    levels, root = _count(index["totalLevels"], "totalLevels"), index["root"]
    files, around = root["splatFiles"], environment_file(index)
    if not levels or len(set(files)) < len(files) or not all(f.lower().endswith((".sog", ".spz", ".ply")) for f in files):
        raise ValueError("levels or files")
    _bounds(root["boundingBox"])

    def below(node: dict) -> list[dict]:
        children = node.get("child") or []
        return list(children.values() if isinstance(children, dict) else children)

    rows = []
    for me, (node, parent, depth, box) in enumerate(_flat(below(root), below, "boundingBox")):
        if depth > levels:
            raise ValueError(f"a node at depth {depth} of {levels}")
        held, place = (node.get("data") or {}).get("3dgs"), (None, None, None)
        if held:
            file, start, count = (_count(held[k], k) for k in ("name", "start", "count"))
            if file >= len(files) or files[file] == around:
                raise ValueError(f"file {file}")
            if count:
                place = files[file], start, count
        rows.append((me, parent, levels - depth, *place, *box))
    for name, ranges in _by_file(rows).items():
        for (s, n, _), (t, _, _) in zip(ranges, ranges[1:]):
            if s + n > t:
                raise ValueError(f"{name}: ranges overlap at row {t}")
    return rows


def environment_file(index: dict) -> str | None:
    """The file of an n-ary index that lies around the scene and is in no tree."""
    env = (index["root"].get("data") or {}).get("env")
    if env is None:
        return None
    at = _count(env["name"], "environment")
    if at >= len(index["root"]["splatFiles"]):
        raise ValueError(f"environment {at}")
    return index["root"]["splatFiles"][at]


def manifest_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _SHAPE)


def extract_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (file, id) of each range (node, file, start, count), in blocks of 65,536 so that the join is on equal keys."""


    block = 1 << 16
    last = F.col("start") + F.col("count") - 1
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest("start", last) / block))
    parts = ranges.where("count > 0").select("node", "file", "start", "count", F.explode(blocks).alias("__block"))
    held = rows.withColumn("__block", F.floor(F.col("id") / block))
    return held.join(parts, ["file", "__block"]).where("id >= start AND id < start + count").drop("__block", "start", "count")
