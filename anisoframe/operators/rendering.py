"""Depth order, projection to the image, compositing, edits by shapes and fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import vectors as V
from ..functions.scalars import float_bits, is_finite, lit
from .filters import POSITION, ROTATION, SCALE, in_range, late, to_view
from .running import ranked

LIMIT = 1e20


def depth(view: dict, radial: bool = False) -> Column:
    """Distance along the view axis, or from the camera with the axis's sign."""
    c = to_view(view)
    return F.when(c[2] < 0, V.length(c)).otherwise(-V.length(c)) if radial else -c[2]


def back_to_front(rows: DataFrame, view: dict, radial: bool = False, fast: bool = False, key: str = "id") -> DataFrame:
    """(key, depth, place): farthest first, ties by key; rows behind the camera and depths that aren't finite go.

    fast: only the upper 23 bits of the single-precision depth count.
    """
    d = rows.select(key, depth(view, radial).alias("depth")).where((F.col("depth") >= 0) & is_finite(F.col("depth")))
    by = F.shiftright(float_bits(F.abs("depth")), 8) if fast else F.col("depth")  # the sign of -0.0 would sort first
    return ranked(d.withColumn("by", by), [F.desc("by"), F.asc(key)], "place").drop("by")


def front_to_back(rows: DataFrame, view: dict, key: str = "id") -> DataFrame:
    """(key, depth, place): nearest first by the upper 16 bits of the depth, ties by key; rows behind stay."""
    d = rows.select(key, depth(view).alias("depth")).where(is_finite(F.col("depth")))
    b = float_bits("depth")
    # The bits of negative numbers run backwards.
    ordered = F.when(b >= 1 << 31, F.lit(0xFFFFFFFF) - b).otherwise(b + F.lit(1 << 31))
    return ranked(d.withColumn("by", F.shiftright(ordered, 16)), ["by", key], "place").drop("by")


def project(rows: DataFrame, view: dict, blur: float = 0.3, least_alpha: float = 1 / 255, deviations: float = 3.0) -> DataFrame:
    """Image position, 2D covariance with blur, its axes' radii and the alpha that the blur leaves, for rows in front."""
    c = to_view(view)
    axes = [[lit(v) for v in view[a]] for a in ("right", "up", "back")]
    inv = lit(1) / F.when(c[2] < 0, c[2])
    fx, fy = lit(view["fx"]), lit(view["fy"])
    j0 = [fx * inv, lit(0), -(fx * inv * c[0]) * inv]
    j1 = [lit(0), fy * inv, -(fy * inv * c[1]) * inv]
    r = G.rotation_matrix(ROTATION)
    world = lambda j: [V.total([j[k] * axes[k][i] for k in range(3)]) for i in range(3)]
    # In steps, so that no expression is written out at each of its uses.
    out = rows.where(c[2] < 0).withColumns({"depth": -c[2], "px": -fx * c[0] * inv, "py": -fy * c[1] * inv} | {f"__w{n}{i}": w for n, j in enumerate((j0, j1)) for i, w in enumerate(world(j))})
    turned = {f"__p{n}{k}": V.total([r[i][k] * F.col(f"__w{n}{i}") for i in range(3)]) * SCALE[k] for n in range(2) for k in range(3)}
    p0, p1 = V.columns("__p00 __p01 __p02"), V.columns("__p10 __p11 __p12")
    out = out.withColumns(turned).withColumns({"__a": V.dot(p0, p0), "__b": V.dot(p0, p1), "__d": V.dot(p1, p1)})
    alpha, _ = G.alpha_shape(F.col("opacity"))
    wide_a, wide_d = F.col("__a") + lit(blur), F.col("__d") + lit(blur)
    det = wide_a * wide_d - F.col("__b") * F.col("__b")
    thin = F.col("__a") * F.col("__d") - F.col("__b") * F.col("__b")
    out = out.withColumns({"cov_xx": wide_a, "cov_xy": F.col("__b"), "cov_yy": wide_d, "__det": det, "alpha": alpha * F.sqrt(F.greatest(lit(0), thin / F.when(det > 0, det)))})
    half, mean = lit(0.5) * (F.col("cov_xx") - F.col("cov_yy")), lit(0.5) * (F.col("cov_xx") + F.col("cov_yy"))
    big = mean + F.sqrt(half * half + F.col("cov_xy") * F.col("cov_xy"))
    fits = (F.col("__det") > 0) & (F.col("alpha") > 0) & (F.col("alpha") >= lit(least_alpha))
    support = F.least(lit(deviations), F.sqrt(F.greatest(lit(0), lit(2) * F.ln(F.col("alpha") / lit(least_alpha)))))
    return late(out, fits).withColumns({"radius1": support * F.sqrt(big), "radius2": support * F.sqrt(F.col("__det") / big)}).drop(*(x for x in out.columns if x.startswith("__")))


def large_enough(projected: DataFrame, pixels: float) -> DataFrame:
    return projected.where((F.col("radius1") >= lit(pixels)) | (F.col("radius2") >= lit(pixels)))


def composite(fragments: DataFrame, pixel: list[str], slab: float = 16.0, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Front-to-back "over" of fragments (pixel columns, depth, id, alpha below one, colours): colour, coverage and count.

    Compositing can be done piece by piece: slabs of depth first, then the slabs of a pixel, so that a pixel with a third
    of all fragments is many windows.
    """
    clear = F.log1p(-F.col("alpha"))
    parts = [*pixel, "__slab"]
    before = Window.partitionBy(*parts).orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = fragments.withColumn("__slab", F.floor(F.col("depth") / lit(slab))).withColumn("__before", F.coalesce(F.sum(clear).over(before), lit(0)))
    weight = F.exp("__before") * F.col("alpha")
    slabs = rows.groupBy(*parts).agg(*(F.sum(weight * F.col(c)).alias(c) for c in channels), F.sum(clear).alias("__clear"), F.count("*").alias("n"))
    ahead = Window.partitionBy(*pixel).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.withColumn("__ahead", F.exp(F.coalesce(F.sum("__clear").over(ahead), lit(0))))
    return slabs.groupBy(*pixel).agg(*(F.sum(F.col("__ahead") * F.col(c)).alias(c) for c in channels), (lit(1) - F.exp(F.sum("__clear"))).alias("coverage"), F.sum("n").alias("n"))


def downsample(pixels: DataFrame, factor: int, channels: tuple[str, ...]) -> DataFrame:
    """Mean of factor x factor pixels, rounded half up."""
    keys = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("px", "py")]
    return pixels.groupBy(*keys).agg(*(F.floor(F.avg(c) + lit(0.5)).cast("long").alias(c) for c in channels))


def shape_distance(kind: str, p: list[Column], size: tuple[float, ...] = (0, 0, 0), radius: float = 0.0) -> Column:
    """Signed distance to a shape in its own coordinates.

    all; plane (z); sphere (radius); box (half sizes, rounding); ellipsoid (half axes); cylinder (radius, half height
    size[1]); capsule (radius, half height size[1]); cone (opening towards -z, sine and cosine of its angle).
    """
    x, y, z = p
    zero = lit(0)
    if kind == "all":
        return lit(-LIMIT)
    if kind == "plane":
        return z
    if kind == "sphere":
        return V.length(p) - lit(radius)
    if kind == "box":
        q = [F.abs(v) - lit(s) for v, s in zip(p, size)]
        return V.length([F.greatest(v, zero) for v in q]) + F.least(F.greatest(*q), zero) - lit(radius)
    if kind == "ellipsoid":
        u = [v / lit(s) for v, s in zip(p, size)]
        k0, k1 = V.length(u), V.length([v / lit(s) for v, s in zip(u, size)])
        return F.when(k1 > 0, k0 * (k0 - lit(1)) / F.when(k1 > 0, k1)).otherwise(lit(-min(size)))
    if kind == "cylinder":
        d = [V.length([x, z]) - lit(radius), F.abs(y) - lit(size[1])]
        return F.least(F.greatest(*d), zero) + V.length([F.greatest(v, zero) for v in d])
    if kind == "capsule":
        return V.length([x, y - F.least(F.greatest(y, lit(-size[1])), lit(size[1])), z]) - lit(radius)
    if kind == "cone":
        s, c = lit(size[0]), lit(size[1])
        q0, q1 = V.length([x, y]), -z
        along = F.greatest(q0 * s + q1 * c, zero)
        return V.length([q0 - s * along, q1 - c * along]) * F.when(q0 * c - q1 * s < 0, lit(-1)).otherwise(lit(1))
    raise ValueError(f"no shape {kind!r}")


def selection_distance(selection: dict) -> Column:
    """Signed distance of this row's centre to a shape, or of a field's value to a range (null: never selected).

    Shapes: shape, centre, rotation, size, radius. Fields: field, low, high. Both: invert.
    """
    if "field" in selection:
        v = F.col(selection["field"])
        low, high = selection.get("low"), selection.get("high")
        d = F.greatest(lit(low) - v if low is not None else lit(-LIMIT), v - lit(high) if high is not None else lit(-LIMIT))
        # Ends belong to a range and, inverted, not to what is outside.
        d = F.when(d == 0, lit(-1e-20)).otherwise(d) if low is None or high is None or low <= high else lit(LIMIT)
        d = F.when(in_range(v), d)
    else:
        p = V.minus(POSITION, [lit(c) for c in selection.get("centre", (0, 0, 0))])
        if "rotation" in selection:
            p = V.rotate(V.conjugate([lit(c) for c in selection["rotation"]]), p)
        d = shape_distance(selection["shape"], p, selection.get("size", (0, 0, 0)), selection.get("radius", 0.0))
    return -d if selection.get("invert") else d


def amount(distance: Column, soft: float) -> Column:
    """How much a selection takes of a row: inside or not, or a ramp of width ``soft`` over the edge; 0 for null."""
    inside = F.when(distance < 0, lit(1)).otherwise(lit(0)) if soft == 0 else F.least(F.greatest(-distance / lit(soft) + lit(0.5), lit(0)), lit(1))
    return F.coalesce(inside, lit(0))


def edited(edits: list[dict]) -> dict[str, Column]:
    """New r, g, b, opacity after the edits, each on what the one before left.

    An edit: selections (each with rgba and mask), blend (mul, set, add), soft, smooth, invert. Several selections are a
    union: the nearest edge counts, and values are weighted by each one's amount; ``smooth`` blends the edges.
    """
    rgba = [F.col(c) for c in ("r", "g", "b", "opacity")]
    for edit in edits:
        soft, smooth, invert = edit.get("soft", 0.0), edit.get("smooth", 0.0), edit.get("invert", False)
        picks = edit["selections"]
        distances = [selection_distance(s) for s in picks]
        if len(picks) == 1:
            weights, d = [lit(1)], distances[0]
        elif smooth == 0:
            weights = [F.when(x.isNull(), lit(0)).otherwise(lit(1)) if invert else amount(x, soft) for x in distances]
            d = reduce(F.least, distances)
        else:
            top = reduce(F.greatest, [-x / lit(smooth) for x in distances])
            weights = [F.coalesce(F.exp(-x / lit(smooth) - top), lit(0)) for x in distances]
            d = -(F.ln(V.total(weights)) + top) * lit(smooth)
        whole = V.total(weights)
        factor = F.when(whole > 0, amount(-d if invert else d, soft)).otherwise(lit(0))
        new = []
        for i, old in enumerate(rgba):
            # A channel that a selection doesn't mask has no value.
            sums = (V.total([w * lit(v(s)) for w, s in zip(weights, picks)]) for v in (lambda s, i=i: s["rgba"][i] * s["mask"][i], lambda s, i=i: s["mask"][i]))
            value, mask = (x / F.when(whole > 0, whole) for x in sums)
            target = {"mul": old * (lit(1) + value - mask), "set": old * (lit(1) - mask) + value, "add": old + value}[edit["blend"]]
            new.append(F.when(factor > 0, old + (target - old) * factor).otherwise(old))
        rgba = new
    return dict(zip(("r", "g", "b", "opacity"), rgba))


def view_colour(direction: list[Column], coefficients: Column, degree: int) -> list[Column]:
    """What harmonics add to r, g, b in a direction; coefficients: an array, three for each basis function."""
    basis = G.sh_basis(direction, degree)
    return [V.total([b * F.get(coefficients, F.lit(3 * k + c)) for k, b in enumerate(basis)]) for c in range(3)]


