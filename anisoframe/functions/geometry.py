"""Formulas of anisotropic Gaussians: covariance, sizes, iso-surfaces, view-dependent colour, similarity."""

from __future__ import annotations

from math import e, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import INF, as_column, lit
from .vectors import Vector, dot, length, minus, rotation_matrix, total

#: Symmetric 3x3 matrices are listed as xx, xy, xz, yy, yz, zz.
_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
#: Exponent of the usual approximation of an ellipsoid's surface.
SURFACE_POWER = 1.6075
#: Power of the penalty for uneven boxes.
ASPECT_POWER = 0.5


def covariance(scale: Vector, q: Vector) -> list[Column]:
    """R diag(s²) Rᵀ, six entries."""
    r = rotation_matrix(q)
    return [total([r[i][k] * r[j][k] * scale[k] * scale[k] for k in range(3)]) for i, j in _PAIRS]


def determinant(m: Vector) -> Column:
    xx, xy, xz, yy, yz, zz = m
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def inverse(m: Vector) -> list[Column]:
    """Of a matrix whose determinant is above zero."""
    xx, xy, xz, yy, yz, zz = m
    d = determinant(m)
    d = F.when(d > 0, d)
    return [x / d for x in (yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)]


def quadratic(m: Vector, d: Vector) -> Column:
    xx, xy, xz, yy, yz, zz = m
    x, y, z = d
    return xx * x * x + yy * y * y + zz * z * z + lit(2) * (xy * x * y + xz * x * z + yz * y * z)


def surface(s: Vector) -> Column:
    """Approximate surface of an ellipsoid with these half-axes."""
    x, y, z = s
    p = lit(SURFACE_POWER)
    return lit(4 * pi) * F.pow((F.pow(x * y, p) + F.pow(x * z, p) + F.pow(y * z, p)) / lit(3), lit(1 / SURFACE_POWER))


def opacity_radius(opacity: Column) -> Column:
    """How much wider than a plain Gaussian an opacity above one makes it."""
    return F.when(opacity > 1, F.sqrt(lit(1) + lit(e) * F.ln(F.when(opacity > 1, opacity)))).otherwise(lit(1))


def feature_size(scale: Vector, opacity: Column) -> Column:
    return lit(2) * F.greatest(*scale) * opacity_radius(opacity)


def alpha_shape(opacity: Column) -> tuple[Column, Column]:
    """What an opacity is drawn with: alpha up to one, and beyond that a kernel shape from 0 to 1."""
    wide = opacity > 1
    shape = lit(0.25) * (F.sqrt(lit(e) * F.ln(F.when(wide, opacity)) + lit(1)) - lit(1))
    return F.least(opacity, lit(1)), F.when(wide, F.least(shape, lit(1))).otherwise(lit(0))


def opacity_of(alpha: Column, shape: Column) -> Column:
    k = lit(1) + lit(4) * F.least(shape, lit(1))
    return F.when(shape > 0, F.exp((k * k - lit(1)) / lit(e))).otherwise(alpha)


def iso_radius(opacity: Column, cutoff: Column | float) -> Column:
    """Radius in standard deviations at which the drawn alpha falls to the cutoff; null where it never reaches it."""
    alpha, shape = alpha_shape(opacity)
    least = F.greatest(as_column(cutoff), lit(1.1754943508222875e-38))  # the smallest normal single
    fine = (alpha > 0) & (alpha < lit(INF))
    relative = least / F.when(fine, alpha)
    inside = relative < 1
    relative = F.when(inside, relative)
    k = lit(1) + lit(4) * shape
    power = F.exp((k * k - lit(1)) / lit(e))
    g = F.when(shape > 0, -F.expm1(F.log1p(-relative) / power)).otherwise(relative)
    return F.sqrt(lit(-2) * F.ln(g))


def box_extents(scale: Vector, q: Vector, radius: Column) -> list[Column]:
    """Half sizes of the box around |R| s r."""
    return [total([F.abs(x) * s * radius for x, s in zip(row, scale)]) for row in rotation_matrix(q)]


def blended_radius(extents: Vector, aspect: float = ASPECT_POWER) -> Column:
    """Radius of equal volume, made larger the more the half sizes of a box differ."""
    x, y, z = (F.greatest(v, lit(1e-12)) for v in extents)
    volume = F.cbrt(x * y * z)
    return volume * F.pow(F.sqrt((x * x + y * y + z * z) / lit(3)) / volume, lit(aspect))


def log_similarity(mean_a: Vector, cov_a: Vector, rgb_a: Vector, mean_b: Vector, cov_b: Vector, rgb_b: Vector) -> Column:
    """Logarithm of the Bhattacharyya coefficient, less the squared distance of colours; 0 for equal Gaussians."""
    mid = [(a + b) / lit(2) for a, b in zip(cov_a, cov_b)]
    da, db, dm = determinant(cov_a), determinant(cov_b), determinant(mid)
    fine = (da > 0) & (db > 0) & (dm > 0)
    part = lambda d: F.ln(F.when(fine, d))
    shape = lit(0.25) * part(da) + lit(0.25) * part(db) - lit(0.5) * part(dm)
    far = quadratic(inverse(mid), minus(mean_a, mean_b)) / lit(8)
    colour = minus(rgb_a, rgb_b)
    return F.when(fine, F.least(shape - far, lit(0)) - dot(colour, colour)).otherwise(lit(-INF))


# Factors of real spherical harmonics of degrees 1 to 4.
SH_FACTORS = (
    (0.4886025,), (1.0925484, 0.3153915, 0.5462742), (0.5900436, 2.8906114, 0.4570458, 0.3731763, 1.4453057),
    (2.50334294, 1.77013077, 0.94617470, 0.66904654, 0.10578555, 0.47308735, 0.62583574),
)


def sh_basis(direction: Vector, degree: int) -> list[Column]:
    """Basis values of degrees 1 to ``degree`` in a unit direction."""
    x, y, z = direction
    n = lit
    xx, yy, zz, xy, yz, xz = x * x, y * y, z * z, x * y, y * z, x * z
    (a,), (b, c, d), (f, g, h, i, j), (k, m, o, p, q, r, s) = SH_FACTORS
    bands = [
        [n(-a) * y, n(a) * z, n(-a) * x],
        [n(b) * xy, n(-b) * yz, n(c) * (n(2) * zz - xx - yy), n(-b) * xz, n(d) * (xx - yy)],
        [
            n(-f) * y * (n(3) * xx - yy), n(g) * xy * z, n(-h) * y * (n(4) * zz - xx - yy), n(i) * z * (n(2) * zz - n(3) * xx - n(3) * yy),
            n(-h) * x * (n(4) * zz - xx - yy), n(j) * z * (xx - yy), n(-f) * x * (xx - n(3) * yy),
        ],
        [
            n(k) * xy * (xx - yy), n(-m) * yz * (n(3) * xx - yy), n(o) * xy * (n(7) * zz - n(1)), n(-p) * yz * (n(7) * zz - n(3)),
            n(q) * (zz * (n(35) * zz - n(30)) + n(3)), n(-p) * xz * (n(7) * zz - n(3)), n(r) * (xx - yy) * (n(7) * zz - n(1)),
            n(-m) * xz * (xx - n(3) * yy), n(s) * (xx * (xx - n(3) * yy) - yy * (n(3) * xx - yy)),
        ],
    ]
    return [v for band in bands[:degree] for v in band]


def affine(m: list[list[float]], v: Vector) -> list[Column]:
    """A point under the rows of an affine 3x4 matrix."""
    return [total([lit(c) * x for c, x in zip(row, v)]) + lit(row[3]) for row in m]


def box_distance(p: Vector, low: Vector, high: Vector) -> Column:
    return length([x - F.least(F.greatest(x, a), b) for x, a, b in zip(p, low, high)])
