"""RAD files written here byte by byte, read back; files of the writer; refusals; ended writes."""

import json
import math
import os
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisoframe.operators import codebooks
from anisoframe.sources import rad
from anisoframe.sources.ply import COLUMNS


def padded(b):
    return b + b"\0" * (-len(b) % 8)


def chunk(base, count, properties, degree=0, tree=None, **more):
    """properties: (name, encoding, bytes, compressed, extra)."""
    payload, listed = b"", []
    for name, encoding, data, packed, extra in properties:
        if packed:
            c = zlib.compressobj(9, zlib.DEFLATED, -15)
            data = c.compress(data) + c.flush()
        listed.append({"property": name, "encoding": encoding, "offset": len(payload), "bytes": len(data), **({"compression": "gz"} if packed else {}), **extra})
        payload += padded(data)
    meta = {"version": 1, "base": base, "count": count, "maxSh": degree, "payloadBytes": len(payload), "properties": listed, **({} if tree is None else {"lodTree": tree}), **more}
    text = json.dumps(meta).encode()
    return b"RADC" + struct.pack("<I", len(text)) + padded(text) + struct.pack("<Q", len(payload)) + payload


def whole(chunks, counts, **more):
    listed, at = [], 0
    for c in chunks:
        listed.append({"offset": at, "bytes": len(c)})
        at += len(c)
    meta = {"version": 1, "type": "gsplat", "count": sum(counts), "chunkSize": counts[0] if counts else 1, "allChunkBytes": at, "chunks": listed, **more}
    text = json.dumps(meta).encode()
    return b"RAD0" + struct.pack("<I", len(text)) + padded(text) + b"".join(chunks)


def saved(data, name="a.rad"):
    path = f"{tempfile.mkdtemp()}/{name}"
    with open(path, "wb") as f:
        f.write(data)
    return path


def planes(rows, kind):
    """Numbers of rows part by part."""
    return b"".join(struct.pack(kind, v) for part in zip(*rows) for v in part)


def byte_planes(rows, kind):
    packed = [[struct.pack(kind, v) for v in part] for part in zip(*rows)]
    return b"".join(bytes(v[b] for part in packed for v in part) for b in range(struct.calcsize(kind)))


def deltas(rows):
    out = b""
    for part in zip(*rows):
        last = 0
        for v in part:
            out += bytes([(v - last) & 255])
            last = v
    return out


PLAIN = {
    "center": ("f32", planes([(1.5, -2.25, 3.0), (0.0, 7.0, -8.5)], "<f")), "alpha": ("f32", planes([(0.5,), (1.5,)], "<f")), "rgb": ("f32", planes([(0.25, 0.5, 0.75), (0, 1, -1)], "<f")),
    "scales": ("f32", planes([(1, 2, 3), (0, 0.5, 4)], "<f")), "orientation": ("f32", planes([(0, 0, 0), (0.5, 0.5, 0.5)], "<f")),
}


def one(change=(), n=2, **more):
    parts = PLAIN | {k: v for k, v in change}
    return chunk(0, n, [(k, v[0], v[1], i % 2 == 0, v[2] if len(v) > 2 else {}) for i, (k, v) in enumerate(parts.items())], **more)


def read(spark, path, columns=None, **options):
    return [r.asDict() for r in rad.read_rad(spark, path, columns, **options).orderBy("id").collect()]


def test_floats(spark):
    a, b = read(spark, saved(whole([one()], [2])))
    assert (a["x"], a["y"], a["z"], b["x"], b["z"]) == (1.5, -2.25, 3.0, 0.0, -8.5) and (a["r"], b["b"], a["sz"], b["sx"]) == (0.25, -1.0, 3.0, 0.0)
    assert (a["qx"], a["qw"]) == (0, 1) and (b["qx"], b["qy"], b["qz"], b["qw"]) == (0.5, 0.5, 0.5, 0.5)
    assert a["opacity"] == 0.5 and math.isclose(b["opacity"], math.exp((9 - 1) / math.e), rel_tol=1e-6)
    assert a["sh"] == [] and a["child_start"] is None and a["sh_label"] is None and a["radius"] is None and (a["id"], b["id"], a["chunk"]) == (0, 1, 0)


def test_halves_and_byte_planes(spark):
    centres = [(1.5, -2.25, 3.0), (0.1, 7.0, -8.5)]
    for kind, data in (("f16", planes(centres, "<e")), ("f16_lebytes", byte_planes(centres, "<e")), ("f32_lebytes", byte_planes(centres, "<f"))):
        change = {"center": (kind, data), "alpha": ("f16", planes([(0.5,), (1.25,)], "<e")), "rgb": ("f16", planes([(0.25, 0.5, 0.75), (0, 1, -1)], "<e")), "orientation": ("f16", planes([(0, 0, 1), (0.5, 0, 0)], "<e"))}
        change["scales"] = ("ln_f16", planes([(0.0, 1.0, -1.0), (-math.inf, 2.0, 0.5)], "<e"))
        a, b = read(spark, saved(whole([one(change.items())], [2])))
        near = np.float32(0.1) if "32" in kind else np.float16(0.1)
        assert (a["x"], a["y"], b["x"], b["z"]) == (1.5, -2.25, float(near), -8.5), kind
        assert math.isclose(a["sy"], math.e, rel_tol=1e-6) and b["sx"] == 0 and a["qw"] == 0 and math.isclose(b["qw"], 0.75**0.5, rel_tol=1e-6)
        assert math.isclose(b["opacity"], math.exp((4 - 1) / math.e), rel_tol=1e-6) and b["r"] == 0


def test_bytes_and_deltas(spark):
    codes = [(0, 128, 255), (7, 3, 254)]
    value = lambda c, low, high: c / 255 * (high - low) + low
    for kind, data in (("r8", planes(codes, "B")), ("r8_delta", deltas(codes))):
        change = {"alpha": ("r8", bytes([51, 255]), {"min": 0, "max": 2}), "rgb": (kind, data, {"min": -0.5, "max": 1.5}), "scales": ("ln_0r8", planes([(0, 1, 255), (128, 0, 2)], "B"), {"min": -12, "max": 9}), "orientation": ("oct88r8", bytes([255, 128, 0, 128, 255, 255]))}
        a, b = read(spark, saved(whole([one(change.items())], [2])))
        assert np.allclose([a[c] for c in "rgb"] + [b[c] for c in "rgb"], [value(c, -0.5, 1.5) for row in codes for c in row], atol=1e-6), kind
        assert math.isclose(a["opacity"], 0.4, rel_tol=1e-6) and math.isclose(b["opacity"], math.exp(24 / math.e), rel_tol=1e-5)
        assert a["sx"] == 0 and math.isclose(a["sy"], math.exp(-12), rel_tol=1e-5) and math.isclose(a["sz"], math.exp(9), rel_tol=1e-5)
        assert math.isclose(b["sx"], math.exp(-12 + 127 * 21 / 254), rel_tol=1e-5) and b["sy"] == 0
        assert (a["qx"], a["qw"]) == (0, 1) and b["qy"] > 0.999 and abs(b["qw"]) < 1e-6


def test_harmonics_labels_and_tree(spark):
    sh = [(0.5,) * 9, tuple(k / 16 for k in range(9))]
    for kind, data in (("f32", planes(sh, "<f")), ("f16", planes(sh, "<e"))):
        a, b = read(spark, saved(whole([one([("sh1", (kind, data))], degree=1)], [2], maxSh=1)), ["id", "sh"])
        assert a["sh"] == list(sh[0]) and b["sh"] == list(sh[1])
    signed = [(1, 127, -127, 0, 5, 6, 7, 8, 9), (-1, -2, -3, -4, 100, -100, 50, 0, 1)]
    raw = [tuple(v & 255 for v in row) for row in signed]
    for kind, data in (("s8", planes(raw, "B")), ("s8_delta", deltas(raw))):
        got = read(spark, saved(whole([one([("sh1", (kind, data, {"min": -2, "max": 2}))], degree=1)], [2], maxSh=1)), ["id", "sh"])
        assert np.allclose([r["sh"] for r in got], np.array(signed) / 127 * 2, atol=1e-6), kind
    book = [(0.0,) * 9, (0.25,) * 9, tuple(k / 8 for k in range(9))]
    for kind, width in (("u16", "<H"), ("u32", "<I")):
        chunks = []
        for base in (0, 2):
            parts = [("sh_label", (kind, planes([(2,), (1,)] if base else [(0,), (2,)], width)))]
            parts += [("child_count", ("u16", planes([(2,), (0,)] if not base else [(0,), (0,)], "<H"))), ("child_start", ("u32", planes([(1,), (0,)] if not base else [(0,), (0,)], "<I")))]
            parts += [("sh1_code", ("f32", planes(book, "<f")))] if not base else []
            chunks.append(chunk(base, 2, [(k, v[0], v[1], True, {}) for k, v in (PLAIN | dict(parts)).items()], tree=True, degree=1))
        path = saved(whole(chunks, [2, 2], maxSh=1, shCodeCount=3, lodTree=True))
        got = read(spark, path)
        assert [r["sh"] for r in got] == [list(book[k]) for k in (0, 2, 2, 1)] and [r["sh_label"] for r in got] == [0, 2, 2, 1]
        assert [(r["child_start"], r["child_count"]) for r in got] == [(1, 2), (0, 0), (0, 0), (0, 0)] and [r["chunk"] for r in got] == [0, 0, 1, 1]
        assert math.isclose(got[0]["radius"], 2.0) and math.isclose(got[1]["radius"], 1.5 * (1 + 2.8 * 0.5), rel_tol=1e-6)
        assert [r["id"] for r in read(spark, path, ["id", "x"], start=1, stop=3)] == [1, 2]
        assert rad.read_rad(spark, path, ["id"], start=3).rdd.getNumPartitions() == 1


def test_only_what_is_asked_for_is_read(spark):
    """A property that can't be inflated only harms those who ask for it."""
    bad = one([("rgb", ("f32", b"", {"compression": "gz"}))])
    path = saved(whole([bad], [2]))
    assert [r["x"] for r in read(spark, path, ["id", "x"])] == [1.5, 0.0]
    with pytest.raises(Exception, match="rgb"):
        read(spark, path, ["id", "r"])


@pytest.mark.parametrize("data", [
    b"RAD1" + whole([one()], [2])[4:], whole([one()], [2], version=2), whole([one()], [2], type="mesh"), whole([one()], [2], maxSh=4), whole([one()], [3]),
    whole([one(version=3)], [2]), whole([one(payloadBytes=8)], [2]), whole([one(tree=True)], [2]), whole([one([("alpha", ("s8", b"\1\2", {"max": 1}))])], [2]),
    whole([one([("alpha", ("r8", b"\1\2"))])], [2]), whole([one([("alpha", ("f32", planes([(-1.0,), (0,)], "<f")))])], [2]), whole([one([("center", ("f32", planes([(math.nan, 0, 0)] * 2, "<f")))])], [2]),
    whole([one([("center", ("f32", b"\0" * 20))])], [2]), whole([one([("sh1", ("f32", b"\0" * 72))], degree=1)], [2]), whole([one([("sh_label", ("u16", b"\0" * 4))])], [2]),
    whole([one()], [2], lodTree=True), whole([one()], [2])[:-8], whole([one()], [2], allChunkBytes=8),
])
def test_refusals(spark, data):
    with pytest.raises(Exception, match="RAD"):
        read(spark, saved(data))


def test_trees(spark):
    def tree(starts, counts):
        parts = PLAIN | {"child_count": ("u16", planes([(c,) for c in counts], "<H")), "child_start": ("u32", planes([(s,) for s in starts], "<I"))}
        return saved(whole([chunk(0, 2, [(k, v[0], v[1], True, {}) for k, v in parts.items()], tree=True)], [2], lodTree=True))

    assert len(read(spark, tree([1, 0], [1, 0]))) == 2
    for starts, counts in (([0, 0], [1, 0]), ([1, 0], [1, 1]), ([1, 1], [1, 1]), ([1, 0], [5, 0])):
        with pytest.raises(Exception, match="RAD"):
            read(spark, tree(starts, counts), ["id", "child_count"])


def gaussians(spark, n, sh=0, **extra):
    h = lambda k: (F.xxhash64("id", F.lit(k)) % 1000).cast("double") / 1000
    q = [h(20 + k) + 0.001 for k in range(4)]
    norm = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    columns = {c: h(k) * 50 for k, c in enumerate("xyz")} | {"opacity": F.abs(h(3))} | {c: F.abs(h(4 + k)) for k, c in enumerate("rgb")} | {c: F.exp(h(7 + k) * 3) for k, c in enumerate(("sx", "sy", "sz"))} | {c: x / norm for c, x in zip(("qx", "qy", "qz", "qw"), q)}
    rows = spark.range(n).withColumns(columns)
    return rows.withColumn("sh", F.array(*(h(40 + k) for k in range(sh)))) if sh else rows


def test_round_trip(spark):
    folder = tempfile.mkdtemp()
    rows = gaussians(spark, 1000, 24).withColumns({"child_start": (F.col("id") * 2 + 1), "child_count": F.when(F.col("id") < 499, 2).when(F.col("id") == 499, 1).otherwise(0)}).repartition(7)
    assert rad.write_rad(rows, f"{folder}/scene.rad", ["id"], chunk=300) == 1000
    assert sorted(os.listdir(folder)) == ["scene-0.radc", "scene-1.radc", "scene-2.radc", "scene-3.radc", "scene.rad"]
    got, want = read(spark, f"{folder}/scene.rad"), [r.asDict() for r in rows.orderBy("id").collect()]
    for g, w in zip(got, want):
        assert all(g[c] == float(np.float32(w[c])) for c in "xyz") and abs(g["opacity"] - w["opacity"]) <= 1 / 255 + 1e-6
        assert all(abs(g[c] - w[c]) <= 0.5 / 255 + 1e-6 for c in "rgb") and all(abs(math.log(g[c] / w[c])) <= 21 / 254 / 2 + 1e-5 for c in ("sx", "sy", "sz"))
        assert abs(sum(g[c] * w[c] for c in ("qx", "qy", "qz", "qw"))) > 0.999
        assert np.abs(np.array(g["sh"]) - np.clip(w["sh"], -127 / 128, 127 / 128)).max() <= 1 / 256 + 1e-9 and (g["child_start"], g["child_count"]) == (w["child_start"], w["child_count"])
    with pytest.raises(Exception, match="scene"):
        rad.write_rad(rows, f"{folder}/scene.rad", ["id"])


def test_codebook_opacity_and_empty(spark):
    folder = tempfile.mkdtemp()
    book = np.array([[k / 16] * 9 for k in range(5)])
    rows = gaussians(spark, 50).withColumns({"sh_label": F.col("id") % 5, "opacity": F.lit(3.0), "sx": F.lit(0.0), "r": F.lit(5.0)})
    rad.write_rad(rows, f"{folder}/b.rad", ["id"], book)
    got = read(spark, f"{folder}/b.rad")
    assert all(np.abs(np.array(r["sh"]) - book[r["id"] % 5]).max() < 1 / 200 and r["sx"] == 0 and abs(r["opacity"] - 3) < 0.02 and r["r"] == 5 for r in got)
    assert not [f for f in os.listdir(folder) if "codebook" in f or "staging" in f]
    assert rad.write_rad(rows.limit(0), f"{folder}/e.rad", ["id"], book) == 0 and read(spark, f"{folder}/e.rad") == []


def test_an_ended_write_leaves_nothing(spark):
    """A task fails after others have written: no header, no chunk, no staging folder; then the same name can be written."""
    folder = tempfile.mkdtemp()
    rows = gaussians(spark, 200_000)
    broken = rows.withColumn("opacity", F.when(F.col("id") == 150_000, F.raise_error("lost")).otherwise(F.col("opacity")).cast("double"))
    placed = broken.withColumn("__chunk", F.floor(F.col("id") / rad.ROWS)).repartition(4, "__chunk").sortWithinPartitions("__chunk", "id").drop("id")
    plan = {"count": 200_000, "degree": 0, "tree": False, "ranges": codebooks.rad_ranges(rows), "codebook": None, "chunk": rad.ROWS}
    spark.dataSource.register(rad.RadSource)
    with pytest.raises(Exception, match="lost"):
        placed.write.format("rad").option("plan", json.dumps(plan)).mode("append").save(f"{folder}/x.rad")
    assert os.listdir(folder) == []
    short = placed.where("__chunk < 2").withColumn("opacity", F.lit(0.5))
    with pytest.raises(Exception, match="missing"):
        short.write.format("rad").option("plan", json.dumps(plan)).mode("append").save(f"{folder}/x.rad")
    assert not [f for f in os.listdir(folder) if not f.startswith("x.rad.staging")]
    assert rad.write_rad(rows, f"{folder}/x.rad", ["id"]) == 200_000
    assert rad.read_rad(spark, f"{folder}/x.rad", ["id"]).agg(F.sum("id")).first()[0] == 199_999 * 100_000


def test_half_percentiles(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=5000) * 10.0 ** rng.integers(-6, 6, 5000), [0.0, -0.0, np.inf, -np.inf, 70000.0, -1e-9] * 3])
    rows = spark.createDataFrame([(float(x),) for x in v], "v double")
    with np.errstate(over="ignore"):
        halves = np.sort(v.astype(np.float32).astype(np.float16).astype(float))
    for p in (0.0, 0.01, 0.5, 0.99, 1.0):
        got = codebooks.half_percentiles(rows, [F.col("v")], {"p": p}).first()["p"]
        rank = min(len(v) - 1, math.floor(float(np.float32(len(v)) * np.float32(p)) + 0.5))
        assert got == halves[rank], p
        disc = codebooks.encoding_range(rows, F.col("v"), p, p).first()["low"]
        assert disc == halves[max(math.ceil(len(v) * p), 1) - 1]
    assert codebooks.half_percentiles(rows.where("false"), [F.col("v")], {"p": 0.5}).first()["p"] is None
