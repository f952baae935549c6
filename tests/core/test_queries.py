"""Every query with SQL against DuckDB, and the others against what must hold."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from anisoframe.functions import codecs
from anisoframe.operators import codebooks
from anisoframe.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(r[columns.index(c)] for c in names) for r in found.fetchall()), key=str)


def test_depth_orders_agree(spark):
    """The coarse orders hold the rows of the exact one, in an order that their truncated keys allow."""
    exact = {r.id: r.depth for r in queries.queries()["depth_axial"](spark, SF).collect()}
    fast = queries.queries()["depth_fast"](spark, SF).orderBy("place").collect()
    assert {r.id for r in fast} == set(exact)
    assert all(a.depth >= b.depth * (1 - 2**-14) for a, b in zip(fast, fast[1:]))
    front = queries.queries()["depth_front"](spark, SF).orderBy("place").collect()
    assert [r.place for r in front] == list(range(1, len(front) + 1))
    assert all(a.depth <= b.depth + abs(b.depth) * 2**-6 + 1e-9 for a, b in zip(front, front[1:]))


def test_partitions_and_merges(spark):
    regions = queries.queries()["kd_regions"](spark, SF).collect()
    n = queries.queries()["morton_code"](spark, SF).count()
    assert sum(r.n for r in regions) == n and max(r.n for r in regions) <= 1000
    merged = queries.queries()["merge_round"](spark, SF)
    assert n / 2 <= merged.count() < n
    labels = queries.queries()["kmeans"](spark, SF).collect()
    assert {r.label for r in labels} <= set(range(codebooks.codebook_size(len(labels))))


def test_sample_size(spark):
    """A step for a size takes about so many rows, heavy ones first; one for all rows takes all."""
    rows = spark.range(20_000).select("id", (F.pow(F.lit(2.0), F.col("id") % 11) / (1 + F.col("id") % 7)).alias("weight"))
    total = rows.agg(F.sum("weight")).first()[0]
    for size in (500, 3000, 15_000):
        taken = codebooks.weighted_sample(rows, "weight", ["id"], size=size)
        n, kept = taken.agg(F.count("*"), F.sum("weight")).first()
        assert abs(n - size) <= 0.03 * size and abs(kept - total) < 0.02 * total
    assert codebooks.weighted_sample(rows, "weight", ["id"], size=20_000).count() == 20_000
    assert codebooks.sample_step(rows.where("false"), "weight", 5) == 1.0


def test_opacity_of_mass(spark):
    """The inverse of the kernel's mass, which for whole powers is a harmonic number."""
    rows = spark.createDataFrame([(float(p), sum(1 / k for k in range(1, p + 1))) for p in (1, 2, 3, 10, 100, 5000)] + [(0.25, 0.25), (3.4028234663852886e38, 88.0)], "want double, mass double")
    for r in rows.select("want", codecs.mass_to_opacity(F.col("mass")).alias("got")).collect():
        assert abs(r.got - r.want) <= 1e-9 * r.want


def test_probes_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    book, x = rng.normal(size=(500, 6)), rng.normal(size=(700, 6))
    want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    monkeypatch.setattr(codebooks, "TILE", 64)
    assert (codebooks.Search(book).all(x) == want).all()
    assert (codebooks.Search(book, probes=22).all(x) == want).all()
    assert (codebooks.Search(book, probes=6).all(x) == want).mean() > 0.8
    assert (codebooks.Search(np.repeat(book[:3], 2, axis=0), probes=1).all(book[:3]) == [0, 2, 4]).all()
