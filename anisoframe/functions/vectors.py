"""Vectors and quaternions (x, y, z, w) as lists of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import INF, lit

Vector = Sequence[Column]


class Columns(Sequence):
    """Columns by their names, made when they are used: a column needs a session."""

    def __init__(self, names: str):
        self.names = names.split()

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i):
        return [F.col(c) for c in self.names[i]] if isinstance(i, slice) else F.col(self.names[i])


def columns(names: str) -> Columns:
    return Columns(names)


def total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts)


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b)])


def length(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalize(v: Vector) -> list[Column]:
    """Unit length; a vector of length zero, or of none that is finite, stays as it is."""
    n = length(v)
    fine = (n > 0) & (n < lit(INF))
    return [F.when(fine, x / F.when(fine, n)).otherwise(x) for x in v]


def quaternion_product(a: Vector, b: Vector) -> list[Column]:
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def rotate(q: Vector, v: Vector) -> list[Column]:
    """v turned by the unit quaternion q."""
    u = cross(q[:3], v)
    uu = cross(q[:3], u)
    return [x + lit(2) * (q[3] * a + b) for x, a, b in zip(v, u, uu)]


def conjugate(q: Vector) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def rotation_matrix(q: Vector) -> list[list[Column]]:
    """Rows of the matrix of a unit quaternion."""
    x, y, z, w = q
    one, two = lit(1), lit(2)
    return [
        [one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)],
        [two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)],
        [two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)],
    ]


def largest_component(v: Vector) -> Column:
    """Index of the largest component, the first of equals; NaN is never larger."""
    best, at = v[0], F.lit(0)
    for i, x in enumerate(v[1:], 1):
        more = (x > best) & ~F.isnan(x)
        best, at = F.when(more, x).otherwise(best), F.when(more, F.lit(i)).otherwise(at)
    return at
