"""Bounds, Morton order, blocks of rows with their bounds, and rays against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..functions.scalars import is_finite, lit
from .filters import POSITION, ROTATION, SCALE, every, late
from .running import checkpointed, ranked

AXES = ("x", "y", "z")
CELLS, BLOCK = 1024, 256
LAST = 0x3FFFFFFF
#: Rays that are sent to all tasks at once; more go in several rounds.
RAYS = 10_000


def finite_centre() -> Column:
    return every([is_finite(c) for c in POSITION])


def centre_bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """Least and greatest finite centre, for each value of the keys."""
    both = [f(F.col(a)).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    return rows.where(finite_centre()).groupBy(*keys).agg(*both)


def full_bounds(rows: DataFrame, *keys: str, cutoff: float = 0.01) -> DataFrame:
    """Bounds of the boxes around every row's iso-surface at the cutoff; rows that never reach it have none."""
    extents = G.box_extents(SCALE, ROTATION, G.iso_radius(F.col("opacity"), cutoff))
    rows = rows.where(finite_centre()).withColumns({f"__e{a}": e for a, e in zip(AXES, extents)})
    low = [F.min(F.col(a) - F.col(f"__e{a}")).alias(f"min_{a}") for a in AXES]
    return rows.groupBy(*keys).agg(*low, *(F.max(F.col(a) + F.col(f"__e{a}")).alias(f"max_{a}") for a in AXES))


def union_bounds(bounds: DataFrame, *keys: str) -> DataFrame:
    return bounds.groupBy(*keys).agg(*(F.min(f"min_{a}").alias(f"min_{a}") for a in AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in AXES))


def interleaved(cells: list[Column], bits: int = 10) -> Column:
    """The bits of three numbers in turn. The cells should be columns: each is written out once for each bit."""
    out = F.lit(0).cast("long")
    for axis, c in enumerate(cells):
        for k in range(bits):
            out = out.bitwiseOR(F.shiftleft(c.bitwiseAND(F.lit(1 << k).cast("long")), 2 * k + axis))
    return out


def cell(p: Column, low: Column, high: Column, cells: int = CELLS) -> Column:
    """Cell of a coordinate between the bounds; 0 if they are equal."""
    extent = high - low
    at = F.floor((p - low) * lit(cells) / F.when(extent > 0, extent))
    return F.coalesce(F.least(F.lit(cells - 1).cast("long"), at), F.lit(0).cast("long"))


def with_morton(rows: DataFrame, name: str = "morton") -> DataFrame:
    """``rows`` with the 30-bit Morton code of their centre within the bounds of all; what isn't finite has the last code."""
    bounds = F.broadcast(centre_bounds(rows).select(*(F.col(f"{n}_{a}").alias(f"__{n}_{a}") for n in ("min", "max") for a in AXES)))  # one row
    fine = finite_centre()
    cells = {f"__c{a}": cell(F.when(fine, F.col(a)), F.col(f"__min_{a}"), F.col(f"__max_{a}")) for a in AXES}
    code = F.when(fine, interleaved([F.col(c) for c in cells])).otherwise(F.lit(LAST).cast("long"))
    # The cells are a projection of their own, so that they aren't worked out once for each bit.
    return rows.join(bounds, F.lit(True), "left").withColumns(cells).withColumn(name, code).select(*rows.columns, name)


def morton_ordered(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with their code, their rank (from 0) in Morton order, ties by key, and their block of 256."""
    out = ranked(with_morton(rows), ["morton", key], "rank").withColumn("rank", F.col("rank") - 1)
    return out.withColumn("block", F.shiftright("rank", 8))


def block_bounds(ordered: DataFrame) -> DataFrame:
    """Bounds of the iso-surface boxes of every block: the zone map that rays and crops are checked with."""
    return full_bounds(ordered, "block").join(ordered.groupBy("block").agg(F.count("*").alias("n")), "block")


def slab_test(o: list[Column], d: list[Column], near: Column, far: Column) -> Column:
    """Whether a ray may meet the bounds min_*, max_*; bounds that aren't finite pass, inverted ones fail."""
    bounds = [(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES]
    finite = every([is_finite(v) for b in bounds for v in b])
    inside = F.lit(True)
    for (low, high), p, v in zip(bounds, o, d):
        pad = lit(1e-5) * (F.abs(p) + F.greatest(F.abs(low), F.abs(high)))
        still = v == 0
        step = F.when(~still, v)
        a, b = (low - pad - p) / step, (high + pad - p) / step
        near = F.when(still, near).otherwise(F.greatest(near, F.least(a, b)))
        far = F.when(still, far).otherwise(F.least(far, F.greatest(a, b)))
        inside = inside & (~still | ((p >= low - pad) & (p <= high + pad)))
    return ~(bounds[0][0] > bounds[0][1]) & (~finite | (inside & (near <= far)))


def with_hits(rows: DataFrame, radius: Column) -> DataFrame:
    """``rows`` (Gaussians joined with rays ox..dz, near, far) with ``t``, where the ray enters the ellipsoid at a radius;
    rows that it misses, or whose ellipsoid it starts in, go.

    One scale of zero makes a flat disk, more than one nothing. Each step is a projection of its own, so that no
    expression is written out at each of its uses.
    """
    q, names = V.conjugate(ROTATION), list(rows.columns)
    o = V.rotate(q, V.minus(V.columns("ox oy oz"), POSITION))
    d = V.rotate(q, V.columns("dx dy dz"))
    rows = rows.withColumns({"__r": radius} | {f"__o{i}": v for i, v in enumerate(o)} | {f"__d{i}": v for i, v in enumerate(d)}).where("__r IS NOT NULL")
    lo, ld = V.columns("__o0 __o1 __o2"), V.columns("__d0 __d1 __d2")
    size = [s * F.col("__r") for s in SCALE]
    some = [F.when(s > 0, s) for s in size]
    rows = rows.withColumns({f"__{n}{i}": v / s for n, local in (("p", lo), ("m", ld)) for i, (v, s) in enumerate(zip(local, some))})
    po, pd = V.columns("__p0 __p1 __p2"), V.columns("__m0 __m1 __m2")
    c = V.cross(po, pd)
    rows = rows.withColumns({"__a": V.dot(pd, pd), "__b": V.dot(po, pd), "__c": V.dot(c, c)})
    disc = F.col("__a") - F.col("__c")
    solid = (-F.col("__b") - F.sqrt(F.when(disc >= 0, disc))) / F.when(F.col("__a") > 0, F.col("__a"))
    disks = []
    for k in range(3):
        t = -lo[k] / F.when(F.abs(ld[k]) >= 1e-6, ld[k])
        others = [i for i in range(3) if i != k]
        square = V.total([(po[i] + t * pd[i]) * (po[i] + t * pd[i]) for i in others])
        disks.append(F.when((size[k] == 0) & (square <= 1), t))
    rows = rows.withColumn("t", F.coalesce(solid, *disks))
    return late(rows, (F.col("t") >= F.col("near")) & (F.col("t") <= F.col("far"))).select(*names, "t")


def raycast(ordered: DataFrame, rays: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(ray_id, key columns of the rows, t) of every hit.

    rays: ray_id, ox, oy, oz, dx, dy, dz (of any length), near, far, min_opacity. Rays meet the blocks' bounds first;
    only rows of blocks that a ray may hit are read against it. The rays are a stated query set and go to all tasks in
    rounds of at most ``RAYS``.
    """
    blocks = checkpointed(block_bounds(ordered)) if blocks is None else blocks
    n = rays.count()
    rounds = 1 + n // RAYS
    out = None
    for i in range(rounds):
        part = F.broadcast(rays.where(F.pmod(F.xxhash64("ray_id"), F.lit(rounds)) == i))
        o, d = V.columns("ox oy oz"), V.columns("dx dy dz")
        met = blocks.join(part, slab_test(o, d, F.col("near"), F.col("far")) & (V.dot(d, d) > 0)).select("block", *part.columns)
        found = with_hits(ordered.join(met, "block"), G.iso_radius(F.col("opacity"), F.col("min_opacity"))).select("ray_id", "id", "t")
        out = found if out is None else out.unionByName(found)
    return out


def nearest_hits(hits: DataFrame) -> DataFrame:
    """The first hit of every ray, ties by the smaller id."""
    return hits.groupBy("ray_id").agg(F.min(F.struct("t", "id")).alias("first"), F.count("*").alias("n_hits")).select("ray_id", "first.id", "first.t", "n_hits")


