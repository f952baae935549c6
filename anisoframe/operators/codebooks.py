"""Codebooks: scalar quantizers on a histogram, weighted k-means on vectors, samples in proportion to weight, dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import half_code, half_of_code, lit
from .running import running_totals

BINS = 65536
#: Most entries of a vector codebook, and so of what is sent to all tasks.
ENTRIES = 262_144
#: Rows and codes that are compared at once.
ROWS, TILE = 1024, 4096


def codebook_size(n: int, entries: int | None = None) -> int:
    """An eighth of the rows unless asked otherwise, never more than the rows or ``ENTRIES``."""
    return min(n, ENTRIES, entries if entries is not None else -(-n // 8))


def histogram(rows: DataFrame, value: str, importance: float = 0.0, bins: int = BINS, key: str = "chunk") -> DataFrame:
    """(key, bin, weight, total): values of each chunk in even bins between its least and greatest one."""
    ends = rows.groupBy(key).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    rows = rows.join(ends, key)
    extent = F.col("__high") - F.col("__low")
    at = F.coalesce(F.floor((F.col(value) - F.col("__low")) * (lit(bins - 1) / F.when(extent > 0, extent)) + lit(0.5)), F.lit(0).cast("long"))
    weight = F.exp(lit(importance) * (F.col(value) - F.col("__high"))) if importance else lit(1)
    rows = rows.select(key, at.alias("bin"), weight.alias("w"), F.col(value).alias("v"))
    return rows.groupBy(key, "bin").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("v")).alias("total"))


def lloyd(weights: np.ndarray, totals: np.ndarray, codes: int = 256, passes: int = 32) -> np.ndarray:
    """Codes of weighted bins in ascending order: weighted quantiles, moved to the means of their bins until they stay."""
    values = totals / weights
    ends = np.cumsum(weights)
    marks = (np.arange(codes) + 0.5) / codes * ends[-1]
    book = values[np.minimum(np.searchsorted(ends, marks, side="left"), len(values) - 1)].astype(np.float32).astype(float)
    for _ in range(passes):
        nearest = np.searchsorted((book[:-1] + book[1:]) / 2, values, side="left")
        mass, centre = (np.bincount(nearest, w, codes) for w in (weights, totals))
        moved = np.where(mass > 0, centre / np.where(mass > 0, mass, 1), book).astype(np.float32).astype(float)
        same = bool((moved == book).all())
        book = np.sort(moved)
        if same:
            break
    return book


def scalar_codebooks(rows: DataFrame, value: str, importance: float = 0.0, codes: int = 256, key: str = "chunk") -> DataFrame:
    """(key, codebook): 256 codes for each chunk. What a task gathers are a chunk's bins, at most ``BINS``."""
    kind = rows.schema[key].dataType.simpleString()

    def fit(bins: pa.Table) -> pa.Table:
        bins = bins.sort_by("bin")
        book = lloyd(bins["weight"].to_numpy(), bins["total"].to_numpy(), codes)
        return pa.table({key: bins[key].slice(0, 1), "codebook": [book.tolist()]})

    return histogram(rows, value, importance, key=key).groupBy(key).applyInArrow(fit, f"{key} {kind}, codebook array<double>")


def scalar_label(value: Column, codebook: Column) -> Column:
    """Index of the nearest code of an ascending codebook: how many midpoints lie below the value."""
    middles = F.zip_with(F.slice(codebook, 1, F.size(codebook) - 1), F.slice(codebook, 2, F.size(codebook) - 1), lambda a, b: (a + b) / lit(2))
    return F.size(F.filter(middles, lambda m: m < value)).cast("int")


def sample_step(rows: DataFrame, weight: str, size: int) -> float:
    """The step at which ``weighted_sample`` takes about ``size`` rows.

    Rows are counted and summed in buckets of nearly equal weight. With the k heaviest buckets taken whole, the others fill
    the rest of the sample at a step of their sum over the places left; that holds for the first k whose step reaches the
    next bucket's mean weight. If all rows are wanted the step is smaller than any weight.
    """
    buckets = rows.where(F.col(weight) > 0).groupBy(F.floor(F.log2(weight) * 16).alias("b")).agg(F.count("*").alias("n"), F.sum(weight).alias("s"))
    found = buckets.select("n", "s", (F.col("s") / F.col("n")).alias("mean")).orderBy(F.desc("mean")).collect()  # bounded by the exponents of doubles
    if not found:
        return 1.0
    n, s, mean = (np.array([r[c] for r in found], float) for c in ("n", "s", "mean"))
    places, light = size - (np.cumsum(n) - n), np.cumsum(s[::-1])[::-1]
    step = np.divide(light, places, out=np.full(len(n), np.inf), where=places > 0)
    fits = np.flatnonzero(step >= mean)
    return float(step[fits[0]]) if len(fits) and size < n.sum() else float(np.finfo(float).tiny)


def weighted_sample(rows: DataFrame, weight: str, order: list[str], size: int | None = None, step: float | None = None) -> DataFrame:
    """A systematic sample: rows that weigh a step or more stay, of lighter ones those at which the running total passes
    the middle of a step; these then weigh a step."""
    step = sample_step(rows, weight, size) if step is None else step
    w = F.col(weight)
    heavy = rows.where(w >= lit(step))
    light = running_totals(rows.where(w < lit(step)), order, {"__total": w})
    mark = lambda total: F.floor(total / lit(step) + lit(0.5))
    light = light.where(mark(F.col("__total")) > mark(F.col("__total") - w)).withColumn(weight, lit(step)).drop("__total")
    return heavy.unionByName(light)


def seeds(vectors: DataFrame, entries: int, key: str = "id", vector: str = "v") -> np.ndarray:
    """Evenly spaced rows in the order of their key, as a matrix."""
    placed = running_totals(vectors.select(key, vector), [key], {"__place": F.lit(1).cast("long")})
    n = placed.agg(F.max("__place")).first()[0] or 0
    spark = vectors.sparkSession
    want = spark.range(entries).select((F.lit(1) + F.floor(F.col("id") * F.lit(n) / F.lit(entries))).cast("long").alias("__place"), F.col("id").alias("__entry"))
    rows = placed.join(F.broadcast(want), "__place").orderBy("__entry").select(vector).toArrow()  # as many as entries, of ENTRIES at most
    flat = rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows.num_rows, -1)


def nearest_codes(vectors: DataFrame, codes: np.ndarray, vector: str = "v", probes: int | None = None) -> DataFrame:
    """``vectors`` with the label of the nearest code and the squared distance; the smaller label of equals.

    The codebook goes to every task, so its size is checked; rows are compared with ``TILE`` codes at a time and keep the
    best so far. probes: codes are put in about sqrt(n) groups and only so many groups, those with the nearest centres, are
    scored for a row.
    """
    if len(codes) > ENTRIES:
        raise ValueError(f"a codebook has at most {ENTRIES} entries")
    shared = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(codes, np.float64))
    schema = T.StructType([*vectors.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    at = vectors.columns.index(vector)

    def run(batches):
        book = shared.value
        search = Search(book, probes)
        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, -1)
            label = np.concatenate([np.zeros(0, np.int32), *(search(x[s : s + ROWS]) for s in range(0, len(x), ROWS))]).astype(np.int32)
            distance = ((x - book[label]) ** 2).sum(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(distance)], names=[*batch.schema.names, "label", "distance"])

    return vectors.mapInArrow(run, schema)


class Search:
    """Nearest codes of rows, in tiles of codes, or in the groups with the nearest centres only."""

    def __init__(self, book: np.ndarray, probes: int | None = None):
        self.book, self.norms, self.probes, self.centres = book, (book * book).sum(axis=1), probes, None
        if probes is not None and len(book) > probes:
            self.centres = book[np.linspace(0, len(book) - 1, max(1, int(len(book) ** 0.5))).astype(int)]
            group = Search(self.centres).all(book)
            self.members = np.argsort(group, kind="stable")
            self.ends = np.searchsorted(group[self.members], np.arange(len(self.centres) + 1))

    def best(self, x: np.ndarray, which: np.ndarray, least: np.ndarray, label: np.ndarray) -> None:
        """Compare rows with the codes at ascending places; what is nearer, or as near with a smaller label, is kept."""
        for s in range(0, len(which), TILE):
            part = which[s : s + TILE]
            score = self.norms[part][None] - 2 * x @ self.book[part].T
            k = score.argmin(axis=1)
            found, to = score[np.arange(len(x)), k], part[k]
            better = (found < least) | (found == least) & (to < label)
            least[better], label[better] = found[better], to[better]

    def all(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self(x[s : s + ROWS]) for s in range(0, len(x), ROWS))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        least, label = np.full(len(x), np.inf), np.full(len(x), len(self.book), np.int64)
        if self.centres is None:
            self.best(x, np.arange(len(self.book)), least, label)
            return label
        near = (self.centres * self.centres).sum(axis=1)[None] - 2 * x @ self.centres.T
        open_ = np.argpartition(near, min(self.probes, near.shape[1]) - 1, axis=1)[:, : self.probes]
        rows, groups = np.repeat(np.arange(len(x)), open_.shape[1]), open_.ravel()
        order = np.argsort(groups, kind="stable")
        for g, own in zip(np.unique(groups), np.split(rows[order], np.flatnonzero(np.diff(groups[order])) + 1)):
            a, b = least[own], label[own]
            self.best(x[own], self.members[self.ends[g] : self.ends[g + 1]], a, b)
            least[own], label[own] = a, b
        # Where all groups that were searched are empty every code is compared.
        none = np.flatnonzero(label == len(self.book))
        if len(none):
            a, b = least[none], label[none]
            self.best(x[none], np.arange(len(self.book)), a, b)
            label[none] = b
        return label


def k_means(vectors: DataFrame, codes: np.ndarray, iterations: int = 10, weight: Column | None = None, vector: str = "v") -> tuple[np.ndarray, DataFrame]:
    """(codes, labelled rows) after weighted Lloyd steps; an entry without rows stays, and nothing moving ends it early.

    Means are sums per label and place, combined before they are shuffled.
    """
    weight = lit(1) if weight is None else weight
    for _ in range(iterations):
        labelled = nearest_codes(vectors, codes, vector)
        sums = means(labelled, weight, vector).collect()  # as many rows as entries
        moved = codes.copy()
        for r in sums:
            moved[r["label"]] = r["mean"]
        if np.array_equal(moved, codes):
            break
        codes = moved
    return codes, nearest_codes(vectors, codes, vector)


def means(labelled: DataFrame, weight: Column, vector: str = "v") -> DataFrame:
    """(label, n, mean): weighted means of the vectors of each label."""
    rows = labelled.select("label", weight.alias("w"), F.posexplode(vector).alias("k", "x"))
    sums = rows.groupBy("label", "k").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))


def with_palette(rows: DataFrame, palette: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the entry of their label; the palette is broadcast only if it is within the session's threshold."""
    return rows.join(palette, label, "left")


def distinct_codes(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Each combination of codes once, with how many rows have it."""
    return rows.groupBy(*codes).agg(F.count("*").alias("n"))


def delta_encoded(rows: DataFrame, value: str, chunk: str, order: str, modulus: int = 256) -> DataFrame:
    """Differences to the row before in the chunk, modulo 256; a chunk's size is bounded by its format."""
    w = Window.partitionBy(chunk).orderBy(order)
    return rows.withColumn("delta", F.pmod(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(modulus)))


def delta_decoded(rows: DataFrame, chunk: str, order: str, modulus: int = 256) -> DataFrame:
    w = Window.partitionBy(chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.pmod(F.sum("delta").over(w), F.lit(modulus)))


def half_percentiles(rows: DataFrame, values: list[Column], fractions: dict[str, float], nearest: bool = True) -> DataFrame:
    """One row: for each fraction the value at that share of all values, which are rounded to half precision first.

    Values are counted by their 65,536 codes at most, so that what is ranked in one place has a fixed size. nearest: the
    rank is the fraction of the count in single precision, rounded; else the first rank whose share reaches the fraction.
    Without values there are nulls.
    """
    codes = rows.select(F.explode(F.array(*values)).alias("v")).where("v IS NOT NULL").select(half_code("v").alias("code"))
    order = Window.orderBy("code")
    counts = codes.groupBy("code").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy())})

    def rank(p: float) -> Column:
        if nearest:
            share = (F.col("all").cast("float") * F.lit(p).cast("float")).cast("double")
            return F.least(F.col("all") - 1, F.floor(share + lit(0.5)))
        return F.greatest(F.ceil(F.col("all") * lit(p)), F.lit(1).cast("long")) - 1

    found = counts.agg(*(F.min(F.when(F.col("upto") > rank(p), F.col("code"))).alias(n) for n, p in fractions.items()))
    return found.select(*(half_of_code(n).alias(n) for n in fractions))


def encoding_range(rows: DataFrame, value: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The percentiles that a chunk's encoding spans, of values in half precision."""
    return half_percentiles(rows, [value], {"low": low, "high": high}, nearest=False)


def rad_ranges(rows: DataFrame) -> dict:
    """What the numbers of paged files are encoded in: the ranges of colours and of logarithmic scales that hold 98 in 100,
    and which of opacity, colours and scales need half precision instead.

    Of a row's scales the middle and the largest count. Two rows come to the driver.
    """
    logs = [F.when(F.col(c) > 0, F.ln(c)).otherwise(lit(-np.inf)) for c in ("sx", "sy", "sz")]
    # The larger of the two smaller ones that are left when the largest is taken out.
    middle = F.greatest(F.least(logs[0], logs[1]), F.least(F.greatest(logs[0], logs[1]), logs[2]))
    ends = {"low": 0.01, "high": 0.99}
    colour = half_percentiles(rows, [F.col(c) for c in "rgb"], ends).first()
    scale = half_percentiles(rows, [middle, F.greatest(*logs)], ends).first()
    opacity = rows.agg(F.max("opacity")).first()[0] or 0.0
    rgb = min(0.0, colour["low"] or 0.0), max(1.0, colour["high"] if colour["high"] is not None else 1.0)
    low = scale["low"] if scale["low"] is not None else 0.0
    ln = min(-12.0, max(float(np.log(1e-30)), low)), max(9.0, scale["high"] if scale["high"] is not None else 9.0)
    # Beyond one an opacity is kept as a shape; those so near to one that half precision shows no difference don't count.
    wide = 0.25 * (np.sqrt(1 + np.e * np.log(max(1.0, opacity))) - 1) > 2.0**-11
    meta = {"rgbMin": rgb[0], "rgbMax": rgb[1], "lnScaleMin": ln[0], "lnScaleMax": ln[1], "sh1Max": 127 / 128, "sh2Max": 127 / 128, "sh3Max": 127 / 128, "lodOpacity": True}
    return {"alphaF16": bool(wide), "rgbF16": bool(rgb[0] < -1 or rgb[1] > 2), "scaleF16": bool(ln[1] - ln[0] > 25), "meta": meta}
