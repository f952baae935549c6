"""PLY files that are written with harmonics, and the compressed form, written here bit by bit."""

import struct
import tempfile

import numpy as np
from pyspark.sql import functions as F
from test_rad import gaussians

from anisoframe.sources import ply


def test_written_with_harmonics(spark):
    rows = gaussians(spark, 40, 9).withColumn("opacity", F.col("opacity") * 0.9 + 0.05).withColumn("sh", F.when(F.col("id") != 3, F.col("sh"))).repartition(2)
    folder = tempfile.mkdtemp()
    files = ply.write_ply(rows, folder).collect()
    assert sum(f.n for f in files) == 40
    got = sorted((r for f in files for r in ply.read_ply(spark, f.file).collect()), key=lambda r: (r.x, r.y))
    want = sorted(rows.collect(), key=lambda r: (np.float32(r.x), np.float32(r.y)))
    for g, w in zip(got, want):
        assert all(np.isclose(g[c], w[c], rtol=1e-5, atol=1e-6) for c in ply.COLUMNS)
        assert np.allclose(g.sh, w.sh or [0.0] * 9, atol=1e-6)


def test_compressed(spark):
    """One chunk of three rows: places and scales in 11, 10 and 11 bits, rotations of ten, colours of eight."""
    ranges = {"min_x": -1, "min_y": -2, "min_z": -3, "max_x": 1, "max_y": 2, "max_z": 3, "min_scale_x": -4, "min_scale_y": -4, "min_scale_z": -4, "max_scale_x": 1, "max_scale_y": 1, "max_scale_z": 1, "min_r": 0, "min_g": 0, "min_b": 0, "max_r": 1, "max_g": 0.5, "max_b": 2}
    rows = [((0, 0, 0), (2047, 1023, 2047), 0, (511, 511, 511), (255, 128, 0, 255)), ((2047, 1023, 2047), (0, 0, 0), 3, (1023, 511, 511), (0, 0, 255, 51)), ((1000, 500, 20), (7, 8, 9), 1, (300, 700, 511), (1, 2, 3, 4))]
    head = "ply\nformat binary_little_endian 1.0\nelement chunk 1\n" + "".join(f"property float {c}\n" for c in ranges) + f"element vertex {len(rows)}\n" + "".join(f"property uint packed_{c}\n" for c in ("position", "rotation", "scale", "color")) + "end_header\n"
    body = struct.pack(f"<{len(ranges)}f", *ranges.values())
    for p, s, tag, q, c in rows:
        body += struct.pack("<4I", p[0] << 21 | p[1] << 11 | p[2], tag << 30 | q[0] << 20 | q[1] << 10 | q[2], s[0] << 21 | s[1] << 11 | s[2], c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3])
    path = f"{tempfile.mkdtemp()}/c.ply"
    with open(path, "wb") as f:
        f.write(head.encode() + body)
    got = ply.read_ply(spark, path).orderBy("id").collect()
    for r, (p, s, tag, q, c) in zip(got, rows):
        at = lambda k, v, top, n: ranges[f"min_{n}"] + (ranges[f"max_{n}"] - ranges[f"min_{n}"]) * v[k] / top
        assert np.allclose([r.x, r.y, r.z], [at(0, p, 2047, "x"), at(1, p, 1023, "y"), at(2, p, 2047, "z")])
        assert np.allclose(np.log([r.sx, r.sy, r.sz]), [at(0, s, 2047, "scale_x"), at(1, s, 1023, "scale_y"), at(2, s, 2047, "scale_z")])
        assert np.allclose([r.r, r.g, r.b, r.opacity], [at(0, c, 255, "r"), at(1, c, 255, "g"), at(2, c, 255, "b"), c[3] / 255])
        three = [(v / 1023 - 0.5) * 2**0.5 for v in q]
        full = [r.qw, r.qx, r.qy, r.qz]
        assert np.isclose(full.pop(tag), max(0, 1 - sum(v * v for v in three)) ** 0.5, atol=1e-6) and np.allclose(full, three, atol=1e-6)
