"""Which rows are kept: validity, emptiness, crops, frustum and size culls, and counts of what went why."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..functions.scalars import is_finite, lit

POSITION, SCALE, ROTATION, COLOUR = V.columns("x y z"), V.columns("sx sy sz"), V.columns("qx qy qz qw"), V.columns("r g b")


def every(tests: list[Column]) -> Column:
    return reduce(and_, tests)


def late(rows: DataFrame, test: Column) -> DataFrame:
    """``rows`` that pass a test of columns that took many steps to make.

    A plain filter would be pushed below those steps, with each step written out at each of its uses.
    """
    mark = F.explode(F.when(test, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))).alias("__kept")
    return rows.select("*", mark).drop("__kept")


def valid() -> Column:
    """All numbers finite, opacity not negative, a rotation that isn't zero. A scale of zero (log -inf) is allowed."""
    numbers = [*POSITION, *SCALE, *ROTATION, *COLOUR, F.col("opacity")]
    return every([is_finite(c) for c in numbers]) & (F.col("opacity") >= 0) & (V.dot(ROTATION, ROTATION) > 0) & every([s >= 0 for s in SCALE])


def empty() -> Column:
    return (F.col("opacity") <= 0) | (G.feature_size(SCALE, F.col("opacity")) <= 0)


def distance_to(x: float, y: float, z: float) -> Column:
    return V.length(V.minus(POSITION, [lit(x), lit(y), lit(z)]))


def in_sphere(x: float, y: float, z: float, radius: float) -> Column:
    """Rows whose centre lies in the sphere or on it."""
    d = distance_to(x, y, z)
    return (d <= lit(radius)) & ~F.isnan(d)


def reason(sphere: tuple[float, float, float, float] | None = None) -> Column:
    """INVALID before EMPTY before CROPPED before KEEP."""
    out = F.when(~valid(), F.lit("INVALID")).when(empty(), F.lit("EMPTY"))
    if sphere:
        out = out.when(~in_sphere(*sphere), F.lit("CROPPED"))
    return out.otherwise(F.lit("KEEP"))


def retain(rows: DataFrame, sphere: tuple[float, float, float, float] | None = None) -> DataFrame:
    return rows.where(reason(sphere) == "KEEP")


def retain_counts(rows: DataFrame, sphere: tuple[float, float, float, float] | None = None) -> DataFrame:
    return rows.groupBy(reason(sphere).alias("reason")).agg(F.count("*").alias("n"))


def enabled() -> Column:
    """Not switched off; a row whose three scales are all zero is."""
    return ~every([s == 0 for s in SCALE])


def in_frustum(view: dict) -> Column:
    """Centres in front of the camera, between the planes and within ``clip`` times the image.

    view: position, axis columns right, up, back of the camera, focal lengths fx, fy, planes near, far, clip.
    """
    c = to_view(view)
    depth = -c[2]
    clip = lit(view.get("clip", 1.4)) * depth
    inside = (depth > lit(view["near"])) & (depth < lit(view["far"]))
    return inside & (F.abs(c[0] * lit(view["fx"])) <= clip) & (F.abs(c[1] * lit(view["fy"])) <= clip)


def to_view(view: dict) -> list[Column]:
    """Coordinates along the camera's axes; it looks down its negative third."""
    d = V.minus(POSITION, [lit(v) for v in view["position"]])
    return [V.dot(d, [lit(v) for v in view[axis]]) for axis in ("right", "up", "back")]


def visible_alpha(least: float) -> Column:
    alpha, _ = G.alpha_shape(F.col("opacity"))
    return (alpha > 0) & (alpha >= lit(least))


def in_range(value: Column, low: float | None = None, high: float | None = None, invert: bool = False) -> Column:
    """A field within inclusive bounds; NaN and infinities never are, inverted or not; low above high selects nothing."""
    inside = F.lit(low is None or high is None or low <= high)
    if low is not None:
        inside = inside & (value >= lit(low))
    if high is not None:
        inside = inside & (value <= lit(high))
    return is_finite(value) & (~inside if invert else inside)


def in_file_range(start: int, count: int, index: str = "id") -> Column:
    return (F.col(index) >= start) & (F.col(index) < start + count)


