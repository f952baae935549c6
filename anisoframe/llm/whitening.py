"""Embedding whitening by cyclic Jacobi rotations.

Vectors become whole numbers, so that their sums and their centred scatter are exact however the rows are dealt out. The
scatter is added up by Spark, a row for each task and place; only it (its size is fixed by the dimension, which is checked)
comes to the driver. There Jacobi rotations, in sweeps over all pairs of dimensions, go on until no off-diagonal entry counts
beside its two diagonal ones. That test is relative, so small eigenvalues come out as accurate as large ones. The matrix that
whitens goes to all tasks, and a last pass measures the covariance of what it made.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, fresh, small_batches, struct

#: Whole numbers are floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Dimensions of a vector, at most: the driver holds a square of them.
DIMENSIONS = 2048
#: Components that are returned, at most.
COMPONENTS = 32
#: Entries this large don't fit a long once they are multiplied; they count as not finite.
TOO_LARGE = 2.0**55
#: Bits of a part of a whole number: products of two parts, added up over ``ROWS`` rows, are exact in doubles.
PART, ROWS = 20, 4096
#: Bits of a part of a sum on its way through Spark.
CARRY = 40


def whole_numbers(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that count, their entries as whole numbers) of an array of lists of doubles."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False).to_numpy(zero_copy_only=False))
    flat = pc.fill_null(vectors.take(pa.array(at)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dimension)
    fine = (np.abs(flat) < TOO_LARGE).all(axis=1)  # NaN fails too
    return at[fine], np.floor(flat[fine] * STEPS).astype(np.int64) + SHIFT


def _parts(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles below 2**PART that add up to them, times powers of it."""
    out = []
    while True:
        low = x & ((1 << PART) - 1)
        rest = x >> PART
        if not ((rest != 0) & (rest != -1)).any():
            return [*out, x.astype(float)]  # below 2**PART in size, with its sign
        out.append(low.astype(float))
        x = rest


def exact_scatter(x: np.ndarray) -> np.ndarray:
    """x.T @ x of whole numbers, as Python's whole numbers of any size."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for s in range(0, len(x), ROWS):
        parts = _parts(x[s : s + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (PART * (i + j))
    return total


def _carried(values: list[int]) -> list[int]:
    """Whole numbers of any size as four longs each, the last with the sign; sums of longs put together give their sum."""
    mask = (1 << CARRY) - 1
    return [part for v in values for part in (v & mask, (v >> CARRY) & mask, (v >> 2 * CARRY) & mask, v >> 3 * CARRY)]


def _added(rows: DataFrame, make, vector: str) -> list[int]:
    """Sums of lists of whole numbers: ``make`` gives one from all batches of a task, Spark adds them place by place."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"parts": [_carried(make(batch.column(0) for batch in batches))]}, pa.schema([("parts", pa.list_(pa.int64()))]))

    parts = rows.select(vector).mapInArrow(run, struct(parts=T.ArrayType(LONG))).select(F.posexplode("parts").alias("k", "v"))
    sums = dict(parts.groupBy("k").agg(F.sum("v").alias("v")).collect())  # as many rows as the lists are long
    return [sum(sums[4 * i + j] << (CARRY * j) for j in range(4)) for i in range(len(sums) // 4)]


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix without negative eigenvalues, largest first.

    A sweep meets every pair once, in rounds of pairs that share no dimension and so are rotated together. A pair is
    rotated while its off-diagonal entry exceeds 2**-53 times the root of the product of its diagonal ones.
    """
    n = len(matrix)
    a, q = np.array(matrix, float), np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            one, two = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            both = (one < n) & (two < n)
            i, j = one[both], two[both]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            off, low, high = a[i, j], a[i, i], a[j, j]
            open_ = np.abs(off) > 2.0**-53 * np.sqrt(np.abs(low)) * np.sqrt(np.abs(high))
            if not open_.any():
                continue
            turned = True
            i, j, off, low, high = i[open_], j[open_], off[open_], low[open_], high[open_]
            with np.errstate(over="ignore"):  # a huge slope is a turn of nothing
                slope = (high - low) / (2 * off)
            t = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(slope, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[i], a[j] = c[:, None] * a[i] - s[:, None] * a[j], s[:, None] * a[i] + c[:, None] * a[j]
            a[:, i], a[:, j] = a[:, i] * c - a[:, j] * s, a[:, i] * s + a[:, j] * c
            q[:, i], q[:, j] = q[:, i] * c - q[:, j] * s, q[:, i] * s + q[:, j] * c
            a[i, j] = a[j, i] = 0
            a[i, i], a[j, j] = low - t * off, high + t * off
        if not turned:
            break
    else:
        raise RuntimeError(f"the rotations did not end in {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


@dataclass
class Whitening:
    """What whitens vectors: n rows with sums S were fitted; ``matrix`` has a column for each component."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def centre(self) -> list[int]:
        """The mean's nearest whole numbers, which rows are moved by before anything is multiplied."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([float(Fraction(s, self.n) - m) for s, m in zip(self.sums, self.centre)])
        return ((x - np.array(self.centre)) - rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; None where that takes more than a long."""
        d, rest = x - np.array(self.centre), [s - self.n * m for s, m in zip(self.sums, self.centre)]
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if len(rest) * most * most < 1 << 63:
            return ((self.n * d - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """What whitens the rows' vectors; None if there is no row whose vector counts.

    Vectors have the length that most rows have (of equally many, the greatest); others don't count, nor do null ones and
    those with null or non-finite entries. A component along which all rows are equal (its eigenvalue is within rounding
    of the variances that it mixes) whitens to zero and is left out of ``identity_error``.
    """
    v = "v"
    rows = vectors.select(F.col(vector_col).cast(T.ArrayType(DOUBLE)).alias(v))
    lengths = rows.where(F.size(v) > 0).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths["d"]
    if d > DIMENSIONS:
        raise ValueError(f"vectors have at most {DIMENSIONS} dimensions")

    def sums(columns) -> list[int]:
        n, total = 0, np.zeros(d, object)
        for column in columns:
            x = whole_numbers(column, d)[1]
            n, total = n + len(x), total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        return [n, *map(int, total)]

    found = _added(rows, sums, v)
    if not found or not found[0]:
        return None
    model = Whitening(found[0], found[1:], np.zeros((d, 0)), np.zeros(0))
    upper = np.triu_indices(d)
    n, centre = model.n, model.centre

    def scatter(columns) -> list[int]:
        total = np.zeros((d, d), object)
        for column in columns:
            total += exact_scatter(whole_numbers(column, d)[1] - np.array(centre))
        return list(map(int, total[upper]))

    rest = [s - n * m for s, m in zip(model.sums, centre)]
    exact = np.zeros((d, d))
    for i, j, v_ij in zip(*upper, _added(rows, scatter, v)):
        exact[i, j] = exact[j, i] = float(Fraction(v_ij * n - rest[i] * rest[j], n * n))
    values, axes = jacobi(exact)
    k = min(components, d)
    noise = d * 2.0**-50 * ((axes * axes) * np.diag(exact)[:, None]).sum(axis=0)
    some = values > noise
    model.matrix = (axes / np.sqrt(np.where(some, values, 1)) * some)[:, :k]
    trace = float(np.trace(exact))
    model.explained = (np.maximum(values, 0) / trace if trace > 0 else np.zeros(d))[:k]
    model.identity_error = _identity_error(rows, model, d, v)
    return model


def _identity_error(rows: DataFrame, model: Whitening, d: int, v: str) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, measured on all of them."""
    k = model.matrix.shape[1]

    def moments(batches):
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.whitened(whole_numbers(batch.column(0), d)[1])
            total, first = total + w.T @ w, first + w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"m": [[*total.ravel(), *first]]}, pa.schema([("m", pa.list_(pa.float64()))]))

    parts = rows.select(v).mapInArrow(moments, struct(m=T.ArrayType(DOUBLE))).select(F.posexplode("m").alias("k", "v"))
    sums = dict(parts.groupBy("k").agg(F.sum("v").alias("v")).collect())  # (components + 1) * components rows
    m = np.array([sums[i] for i in range(k * k + k)]) / model.n
    covariance = m[: k * k].reshape(k, k) - np.outer(m[k * k :], m[k * k :])  # the means are rounding errors
    some = np.abs(model.matrix).max(axis=0) > 0
    return float(np.abs((covariance - np.eye(k))[np.ix_(some, some)]).max(initial=0))


WHITENED = struct(deviation=LONG, whitened=T.ArrayType(DOUBLE))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector that counts and component.

    Vectors that count are those of ``fit``; all others, and so null, empty and short ones and those with null or
    non-finite entries (or entries of 2**55 or more), give no rows. Null, equal and repeated ids stay rows of their own,
    with the same values for the same vector. ``deviation`` is null where it takes more than a long. Of a table without a
    vector that counts the result is empty. Other columns are not read; should the id's name be one of the result's, that
    one gets an underscore.
    """
    small_batches(vectors.sparkSession, 10_000)
    model = fit(vectors, vector_col, components)
    names = {c: fresh(c, [id_col]) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")}
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(T.ArrayType(DOUBLE)).alias("v"))
    schema = T.StructType([rows.schema["id"], *WHITENED.fields])
    d = len(model.sums) if model else 0
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            if own is None:
                continue
            at, x = whole_numbers(batch.column(1), d)
            w = own.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(own.deviations(x), pa.int64()), lists], names=schema.names)

    explained = F.array(*map(F.lit, map(float, model.explained if model else [0.0])))
    out = rows.mapInArrow(run, schema).select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias(names["component"]), F.lit(model.n if model else 0).cast("long").alias(names["n"]),
        F.col("deviation").alias(names["deviation"]), F.col("w").alias(names["whitened"]), F.get(explained, F.col("at")).alias(names["explained"]),
        F.lit(model.identity_error if model else 0.0).alias(names["identity_error"]),
    )
