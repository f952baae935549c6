"""Readers and writers, the expression language's checks, numbers at the edges, and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisoframe.functions import expressions
from anisoframe.functions import scalars as N
from anisoframe.operators import codebooks, filters, lod
from anisoframe.operators.running import ranked
from anisoframe.sources import manifests, ply, spz
from anisoframe.sources.files import sniff
from anisoframe.streaming import schedule


def gaussians(n, seed=1):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.column_stack([rng.uniform(-50, 50, (n, 3)), rng.uniform(0.05, 0.95, n), rng.uniform(0, 1, (n, 3)), rng.uniform(0.01, 2, (n, 3)), q])


def table(df):
    rows = df.orderBy("id").collect()
    return np.array([[r[c] for c in ply.COLUMNS] for r in rows]), np.array([r.sh for r in rows])


def test_ply(spark, tmp_path):
    made, sh = gaussians(1000), np.random.default_rng(2).normal(size=(1000, 9))
    (tmp_path / "a.ply").write_bytes(ply.encode(made, sh))
    got, got_sh = table(ply.read_ply(spark, f"file://{tmp_path}/a.ply"))
    assert np.allclose(got, made, atol=1e-4) and np.allclose(got_sh, sh, atol=1e-5)
    points = np.zeros(3, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
    points["red"] = 255
    head = "ply\r\nformat binary_little_endian 1.0\r\nelement vertex 3\r\n" + "".join(f"property {'uchar' if k == 'u1' else 'float'} {c}\r\n" for c, k in [("x", ""), ("y", ""), ("z", ""), ("red", "u1"), ("green", "u1"), ("blue", "u1")]) + "end_header\r\n"
    (tmp_path / "p.ply").write_bytes(head.encode() + points.tobytes())
    got, _ = table(ply.read_ply(spark, f"{tmp_path}/p.ply"))
    assert (got[:, 4] == 1).all() and (got[:, 3] == 1).all() and (got[:, 7] == 0.001).all()
    for bad in (b"ply\nelement vertex 1\nelement vertex 2\nend_header\n", b"ply\nelement vertex 1\nproperty list uchar int a\nend_header\n", b"ply\nelement vertex 1\nend_header\n", b"no"):
        with pytest.raises(ValueError):
            ply.Header(bad)
    (tmp_path / "cut.ply").write_bytes(ply.encode(made)[:-1])
    with pytest.raises(ValueError):
        ply.read_ply(spark, f"{tmp_path}/cut.ply")


def test_ply_writer(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply.encode(gaussians(300)))
    rows = ply.read_ply(spark, f"{tmp_path}/a.ply")
    files = ply.write_ply(rows.repartition(3), f"file://{tmp_path}/out").collect()
    assert sum(f.n for f in files) == 300
    back = np.concatenate([table(ply.read_ply(spark, f.file))[0] for f in files])
    want = table(rows)[0]
    assert np.allclose(back[np.argsort(back[:, 0])], want[np.argsort(want[:, 0])], atol=1e-4)


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_spz(spark, tmp_path, version):
    made, sh = gaussians(500), np.clip(np.random.default_rng(3).normal(size=(500, 24)) / 4, -1, 0.99)
    data = spz.encode(made, sh, version)
    (tmp_path / "a.spz").write_bytes(data)
    df = spz.read_spz(spark, f"{tmp_path}/a.spz")
    got, got_sh = table(df)
    assert np.allclose(got[:, :3], made[:, :3], atol=0.05 if version == 1 else 2e-4)
    assert np.abs((got[:, 10:] * made[:, 10:]).sum(axis=1)).min() > (0.9997 if version > 2 else 0.99)  # old rotations have eight bits
    assert np.allclose(got_sh, sh, atol=1 / 200) and np.allclose(got[:, 3], made[:, 3], atol=1 / 500)
    assert table(spz.read_spz(spark, f"{tmp_path}/a.spz", max_sh=1))[1].shape[1] == 9
    with pytest.raises(Exception):
        spz.decode(data[:-3])


def test_manifests(spark):
    box = {"min": [0, 0, 0], "max": [1, 1, 1]}
    leaf = lambda f, o, n: {"bound": box, "lods": {"0": {"file": f, "offset": o, "count": n}}}
    tree = {"filenames": ["a"], "tree": {"bound": box, "children": [leaf(0, 0, 3), leaf(0, 3, 4)]}}
    rows = manifests.manifest_table(spark, manifests.lod_rows(json.loads(json.dumps(tree))))
    data = spark.range(10).withColumn("file", F.lit("a"))
    got = manifests.extract_ranges(data, rows.where("file IS NOT NULL"))
    assert got.count() == 7 and got.groupBy("node").count().count() == 2
    tree["tree"]["children"][1] = leaf(0, 4, 4)
    with pytest.raises(ValueError):
        manifests.lod_rows(tree)
    index = {"root": {"bound": box, "range": {"file": "a", "start": 0, "count": 5}, "children": [{"bound": box, "range": {"file": "a", "start": 4, "count": 5}}]}}
    with pytest.raises(ValueError):
        manifests.index_rows(index)


def test_sniff():
    assert [sniff(b"ply\n"), sniff(b"\x1f\x8b"), sniff(b"", "x.RAD")] == ["ply", "spz", "rad"]
    with pytest.raises(ValueError):
        sniff(b"", "x.txt")


def test_expression_types(spark):
    bad = [
        lambda s, o, a: {"position": s.opacity}, lambda s, o, a: {"when": 1.0}, lambda s, o, a: {"colour": s.position}, lambda s, o, a: {"opacity": float("inf")},
        lambda s, o, a: {"opacity": o.lt(s.position, 1)}, lambda s, o, a: {"position": o.cross(s.position, s.quaternion)}, lambda s, o, a: {"opacity": o.select(s.opacity, 1, 2)},
    ]
    for build in bad:
        with pytest.raises((TypeError, ValueError)):
            expressions.define(build)


def test_numbers_at_the_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 2.0), (-2.5, float("inf"))], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(N.quotient(a, b).alias("q"), N.log(a).alias("l"), N.minimum(a, b).alias("m"), N.equal(a, a).alias("e"), N.less(a, b).alias("t"), N.round_away(a).alias("r"), N.is_finite(b).alias("f")).collect()
    assert [str(r.q) for r in got] == ["inf", "-inf", "nan", "nan", "-0.0"]
    assert [str(r.l) for r in got] == ["0.0", "nan", "-inf", "nan", "nan"]
    assert [r.m for r in got] == [0.0, -1.0, 0.0, 2.0, -2.5]
    assert [r.e for r in got] == [True, True, True, False, True] and [r.t for r in got] == [False, True, False, False, True]
    assert [str(r.r) for r in got] == ["1.0", "-1.0", "0.0", "nan", "-3.0"] and not got[4].f
    halves = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (65504.0,), (1e9,), (None,)], "x double").select(N.half_round("x").alias("h")).collect()
    assert [r.h for r in halves] == [0.0, 1.0, -2.0, 65504.0, float("inf"), None]
    words = spark.createDataFrame([(1.5,), (-0.25,)], "x double").select(N.bits_float(N.float_bits("x")).alias("x")).collect()
    assert [r.x for r in words] == [1.5, -0.25]


def test_ranks_and_empty_tables(spark):
    rows = spark.range(0, 5000, 1, 7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = ranked(rows, ["k", "id"]).orderBy("k", "id").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert ranked(rows.where("false"), ["k", "id"]).count() == 0
    with pytest.raises(ValueError):
        codebooks.nearest_codes(rows, np.zeros((codebooks.ENTRIES + 1, 1)))
    assert codebooks.codebook_size(17) == 3 and codebooks.codebook_size(5, 100) == 5 and lod.level_targets(1000, 10, 4) == [250, 63, 16, 4]


def test_tree_errors(spark):
    nodes = spark.createDataFrame([(0, 1, 2), (1, 3, 1), (2, 3, 1), (3, 0, 0), (4, 4, 1), (5, 9, 1)], "node_id long, child_start long, child_count long")
    found = sorted(map(tuple, lod.tree_errors(nodes).collect()))
    assert found == [(3, "owned twice"), (4, "not behind its parent"), (9, "missing")]


def test_invalid_rows(spark):
    base = dict(zip(ply.COLUMNS, [0.0, 0.0, 0.0, 1.0, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0]))
    cases = [({}, "KEEP"), ({"x": float("nan")}, "INVALID"), ({"z": float("inf")}, "INVALID"), ({"opacity": -0.1}, "INVALID"), ({"opacity": 0.0}, "EMPTY"), ({"qw": 0.0}, "INVALID"), ({"sx": 0.0}, "KEEP"), ({"sx": 0.0, "sy": 0.0, "sz": 0.0}, "EMPTY"), ({"x": 2.0}, "KEEP"), ({"x": 2.1}, "CROPPED")]
    rows = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], "id long, " + ", ".join(f"{c} double" for c in base))
    got = {r.id: r.reason for r in rows.select("id", filters.reason((0, 0, 0, 2)).alias("reason")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_streams(spark, tmp_path):
    """Windows with a watermark over a stream give what the batch does, once all windows have closed."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    end.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    got = run(schedule.windowed(stream, "1 hour", late="30 days"), "windows").where("event_type <> 'end'")
    want = schedule.windowed(events, "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))[: got.count()]
    views = stream.where("user_id >= 0").select("user_id", "event_type", F.col("event_id").alias("order"))
    seen = run(schedule.view_change_stream(views, "event_type", "user_id"), "views")
    batch = schedule.view_changes(events.select("user_id", "event_type", "event_id"), ["event_type"], "user_id", "event_id")
    assert seen.count() == batch.count()
