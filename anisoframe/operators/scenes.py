"""Scenes of several levels: built one over the other, put into one row space, ordered in leaves, boxed and measured."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.scalars import lit
from .filters import POSITION, SCALE
from .lod import with_covariance
from .merging import merge_step, usual_side, weight
from .running import ranked, stored
from .spatial import AXES, cell, centre_bounds, finite_centre, interleaved


def built_levels(rows: DataFrame, root: int = 262_144, factor: float = 2.0, key: str = "id", rounds: int = 200) -> DataFrame:
    """(level, key, parent, row and its weight): every level from the rows themselves (0) to one of at most ``root`` rows.

    A level has its predecessor's rows divided by ``factor``, rounded up, or one less if that isn't fewer: rounds of merges
    are taken until just so many are left, of the last round's pairs the most similar. A round is a plan of a fixed size
    over written rows and its links are put together with those before, so that ``parent`` is the key of the row above
    (null in the last level). Cells grow when a round merged few rows. Weights and weighted centres add up to the same at
    every level. Rows whose numbers aren't all finite are merged when nothing else is left to merge (``merge_step``). Keys
    are whole numbers, each of one row. An empty table gives no rows.
    """
    if root < 1 or factor <= 1:
        raise ValueError("a root of one row or more, and a factor above one")
    rows = stored(rows if "weight" in rows.columns else rows.withColumn("weight", weight()))
    n, level, out = rows.count(), 0, None
    while n > root:
        here, target, links, (side, length) = rows.withColumn("level", F.lit(level)), min(n - 1, ceil(n / factor)), None, usual_side(rows)
        for _ in range(rounds):
            step, merged = merge_step(rows, side, key, most=n - target, anyhow=side > 2 * length)
            step = step.select(F.col(key).alias("__from"), F.col("parent").alias("__to"))
            new = step.toDF(key, "parent") if links is None else links.join(step, F.col("parent") == F.col("__from")).select(key, F.col("__to").alias("parent"))
            links, rows = stored(new), stored(merged)
            left = rows.count()
            side, n = side * (4 if left == n else 2 if n - left < n // 8 else 1.26), left
            if n <= target:
                break
        else:
            raise RuntimeError(f"level {level} has {n} rows, not {target}, after {rounds} rounds")
        done = here.join(links, key)
        out = done if out is None else out.unionByName(done, allowMissingColumns=True)
        level += 1
    last = rows.withColumns({"level": F.lit(level), "parent": F.lit(None).cast(rows.schema[key].dataType)})
    return last if out is None else out.unionByName(last, allowMissingColumns=True)


def one_row_space(levels: DataFrame, key: str = "id") -> DataFrame:
    """``levels`` (level, key, ...) with ``row``: its place from 0 when the levels follow each other, each by key."""
    return ranked(levels, ["level", key], "row").withColumn("row", F.col("row") - 1)


def level_offsets(levels: DataFrame) -> DataFrame:
    """(level, start, n): where each level starts in the one row space. A row for each level."""
    counts = levels.groupBy("level").agg(F.count("*").alias("n"))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # a row for each level
    return counts.select("level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


def inherited(coarse: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a coarse level with the columns of the row that represents them; null where there is none."""
    return coarse.join(values, key, "left")


def leaf_order(rows: DataFrame, leaf: str = "region", level: str = "level", key: str = "id") -> DataFrame:
    """``rows`` with their Morton code within their leaf's bounds and ``place``, their rank from 0 in leaf and level.

    Ties go by key; what isn't finite comes last. Leaves are those of ``lod.regions``, of a limited number of rows: a
    leaf is ordered by one task.
    """
    ends = centre_bounds(rows, leaf).select(leaf, *(F.col(f"{n}_{a}").alias(f"__{n}_{a}") for n in ("min", "max") for a in AXES))
    fine = finite_centre()
    cells = {f"__c{a}": cell(F.when(fine, F.col(a)), F.col(f"__min_{a}"), F.col(f"__max_{a}")) for a in AXES}
    code = F.when(fine, interleaved([F.col(c) for c in cells])).otherwise(F.lit((1 << 30) - 1).cast("long"))
    coded = rows.join(ends, leaf, "left").withColumns(cells).withColumn("morton", code).select(*rows.columns, "morton")
    place = F.row_number().over(Window.partitionBy(leaf, level).orderBy("morton", key)) - 1
    return coded.withColumn("place", place.cast("long"))


def region_boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bounds, n): the box of each group's Gaussians at three standard deviations."""
    reach = {f"__e{a}": lit(3) * F.sqrt(F.greatest(F.col(c), lit(1e-20))) for a, c in zip(AXES, ("cxx", "cyy", "czz"))}
    rows = with_covariance(rows).withColumns(reach)
    low = [F.min(F.col(a) - F.col(f"__e{a}")).alias(f"min_{a}") for a in AXES]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *low, *(F.max(F.col(a) + F.col(f"__e{a}")).alias(f"max_{a}") for a in AXES))


def projected_size(views: list[dict], radius: Column) -> Column:
    """Pixels that a node's diameter takes, the most of any view.

    A view: position, forward (unit), right and up (each scaled so that 1 is the edge of the picture at depth 1), pixels
    (a length of 1 at distance 1) and, if it is so, orthographic. Full size counts in the picture; beyond its edge the
    share falls with the square, to a twentieth, which is also what counts behind the view.
    """
    sizes = []
    for v in views:
        d = V.minus(POSITION, [lit(x) for x in v["position"]])
        depth, across, upward = (V.dot(d, [lit(x) for x in v[k]]) for k in ("forward", "right", "up"))
        full = lit(1) if v.get("orthographic") else depth
        edge = F.greatest(full, F.abs(across), F.abs(upward))
        share = F.when((depth >= 0) & (edge > 0), F.pow(full / F.when(edge > 0, edge), lit(2))).otherwise(lit(0))
        sizes.append(lit(2) * radius * lit(v["pixels"]) * (lit(0.05) + lit(0.95) * share) / F.greatest(V.length(d), lit(1e-6)))
    return F.greatest(lit(0), *sizes)


def integer_widths(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, most, bits): the narrowest of 8, 16 and 32 bits that holds a chunk's whole numbers from 0; else null."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__least"), F.max(value).alias("most"))
    bits = F.when(F.col("__least") < 0, None).when(F.col("most") < 1 << 8, 8).when(F.col("most") < 1 << 16, 16).when(F.col("most") < 1 << 32, 32)
    return ends.select(*keys, "most", bits.alias("bits"))


def shown_size() -> Column:
    """The radius that a row is measured with: three standard deviations of its longest axis."""
    return lit(3) * F.greatest(*SCALE)

