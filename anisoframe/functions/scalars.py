"""Scalar functions with IEEE rules, where Spark's own raise, give null or order NaN."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN, INF = float("nan"), float("inf")
#: Doubles from here on are whole numbers; rounding them would overflow a long.
_WHOLE = float(1 << 52)


def lit(x: float) -> Column:
    return F.lit(float(x))


def as_column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else lit(x)


def fixed(x: Column, digits: int = 6) -> Column:
    """A double as a whole number of its last digit: what two engines agree on."""
    return F.floor(x * lit(10.0**digits) + lit(0.5)).cast("long")


def quotient(a: Column, b: Column) -> Column:
    """a / b; by zero it is an infinity with the sign of a, and NaN for 0 / 0."""
    by_zero = F.when((a == 0) | F.isnan(a), lit(NAN)).when(a > 0, lit(INF)).otherwise(lit(-INF))
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(by_zero)


def log(x: Column) -> Column:
    """Natural logarithm; -infinity at zero and NaN below."""
    return F.when(x == 0, lit(-INF)).when(x < 0, lit(NAN)).otherwise(F.ln(x))


def _rounded(x: Column, f) -> Column:
    return F.when(F.abs(x) < _WHOLE, f(F.when(F.abs(x) < _WHOLE, x)).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return _rounded(x, F.floor)


def ceil(x: Column) -> Column:
    return _rounded(x, F.ceil)


def round_away(x: Column) -> Column:
    """Nearest whole number, ties away from zero."""
    return _rounded(x, lambda v: F.signum(v) * F.floor(F.abs(v) + lit(0.5)))


def minimum(a: Column, b: Column) -> Column:
    """The smaller; of a number and NaN the number."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    """The larger; of a number and NaN the number."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(x, low), high)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < lit(INF))


def equal(a: Column, b: Column) -> Column:
    """Equality by which NaN differs from everything."""
    return (a == b) & ~F.isnan(a)


def less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(b)


def less_equal(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(b)


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(F.when(x > -1, x))).when(x == -1, lit(-INF)).otherwise(lit(NAN))


@F.arrow_udf(T.DoubleType())
def half_round(x: pa.Array) -> pa.Array:
    """The nearest half-precision number, ties to even, as a double."""
    with np.errstate(over="ignore"):
        halves = x.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
    return pa.array(halves, mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def half_code(x: pa.Array) -> pa.Array:
    """Whole numbers from 0 to 65535 in the order of the half-precision numbers nearest to the single-precision ones."""
    with np.errstate(over="ignore"):
        bits = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float16).view(np.uint16).astype(np.int64)
    return pa.array(np.where(bits & 0x8000, bits ^ 0xFFFF, bits | 0x8000), mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def half_of_code(x: pa.Array) -> pa.Array:
    """The half-precision number of a code of ``half_code``, as a double."""
    code = x.fill_null(0).to_numpy(zero_copy_only=False)
    bits = np.where(code & 0x8000, code & 0x7FFF, code ^ 0xFFFF).astype(np.uint16)
    return pa.array(bits.view(np.float16).astype(np.float64), mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def float_bits(x: pa.Array) -> pa.Array:
    """The bits of a single-precision number as an unsigned number."""
    with np.errstate(over="ignore"):
        bits = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32).astype(np.int64)
    return pa.array(bits, mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def bits_float(x: pa.Array) -> pa.Array:
    """The single-precision number of unsigned bits."""
    values = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32).view(np.float32).astype(np.float64)
    return pa.array(values, mask=x.is_null().to_numpy(zero_copy_only=False))


def hash32(x: Column) -> Column:
    """A mix of 32 bits (unsigned in a long): xor-shifts and two odd factors, the values fixed."""
    mask = F.lit(0xFFFFFFFF)

    def times(v: Column, factor: int) -> Column:
        # In two halves, so that products stay below 2^63.
        high = F.shiftright(v, 16) * factor
        return ((v.bitwiseAND(0xFFFF)) * factor + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)

    x = x.cast("long").bitwiseAND(mask)
    x = times(x.bitwiseXOR(F.shiftright(x, 16)), 0x7FEB352D)
    x = times(x.bitwiseXOR(F.shiftright(x, 15)), 0x846CA68B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def srgb_to_linear(x: Column) -> Column:
    x = F.greatest(x, lit(0))
    return F.when(x <= lit(0.04045), x / lit(12.92)).otherwise(F.pow((x + lit(0.055)) / lit(1.055), lit(2.4)))
