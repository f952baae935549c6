"""Levels of detail: spatial partitions, merges of Gaussians, trees over them and cuts through the trees."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import vectors as V
from ..functions.scalars import lit
from .filters import COLOUR, POSITION, ROTATION, SCALE
from .merging import shaped
from .running import checkpointed, running_totals
from .spatial import AXES

COVARIANCE = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def level_targets(n: int, root: int = 262_144, factor: float = 4.0) -> list[int]:
    """Row counts of the levels above n rows, until one is small enough."""
    out = []
    while n > root and n > 1:
        n = max(1, min(n - 1, int(-(-n // factor))))
        out.append(n)
    return out


def axis_bins(rows: DataFrame, node: str = "node", bins: int = 256) -> DataFrame:
    """(node, axis, bin, n, low, high): rows of each node in even bins of each axis. One grouped count for all nodes."""
    ends = rows.groupBy(node).agg(*(f(a).alias(f"__{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))
    rows = rows.join(ends, node)
    axes = [F.struct(F.lit(i).alias("axis"), F.col(a).alias("v"), F.col(f"__min_{a}").alias("lo"), F.col(f"__max_{a}").alias("hi")) for i, a in enumerate(AXES)]
    rows = rows.select(node, F.explode(F.array(*axes)).alias("e")).select(node, "e.*")
    extent = F.col("hi") - F.col("lo")
    at = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("v") - F.col("lo")) * lit(bins) / F.when(extent > 0, extent)))
    rows = rows.where("hi > lo").withColumn("bin", at)
    return rows.groupBy(node, "axis", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def best_cuts(bins: DataFrame, node: str = "node") -> DataFrame:
    """(node, axis, cut): for each node the cut after which both sides' shares of rows and length cost the least.

    A side costs its rows times its length; uneven nodes are cut along long axes first. Rows here are bins, at most 256
    for an axis of a node.
    """
    by = Window.partitionBy(node, "axis").orderBy("bin")
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(node, "axis")
    b = bins.withColumns({
        "nl": F.sum("n").over(before), "nr": F.sum("n").over(after), "hl": F.max("high").over(before), "lr": F.min("low").over(after),
        "lo": F.min("low").over(whole), "hi": F.max("high").over(whole), "nn": F.sum("n").over(whole),
    }).where("nr IS NOT NULL")
    extent = F.col("hi") - F.col("lo")
    cost = (F.col("nl") * (F.col("hl") - F.col("lo")) + F.col("nr") * (F.col("hi") - F.col("lr"))) / (F.col("nn") * extent)
    b = b.withColumn("longest", F.max(extent).over(Window.partitionBy(node)))
    cost = cost * F.sqrt(F.col("longest") / extent)
    first = F.min(F.struct(cost.alias("cost"), F.abs(F.col("nl") - F.col("nr")).alias("uneven"), "axis", "bin", F.col("lr").alias("cut"))).alias("f")
    return b.groupBy(node).agg(first).select(node, "f.axis", "f.cut")


def box_bins(rows: DataFrame, node: str = "node", bins: int = 256) -> DataFrame:
    """(node, axis, bin, n, lo, hi, min_*, max_*): rows of each node in even bins of each axis, with the box of a bin's
    centres and the node's ends on the axis. One grouped count for all nodes; an axis of no length has no bins."""
    ends = rows.groupBy(node).agg(*(f(a).alias(f"__{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))
    axes = [F.struct(F.lit(i).alias("axis"), F.col(a).alias("v"), F.col(f"__min_{a}").alias("lo"), F.col(f"__max_{a}").alias("hi")) for i, a in enumerate(AXES)]
    longest = F.greatest(*(F.col(f"__max_{a}") - F.col(f"__min_{a}") for a in AXES))
    each = rows.join(ends, node).select(node, *AXES, F.greatest(longest * lit(1e-9), lit(1e-9)).alias("eps"), F.explode(F.array(*axes)).alias("e")).select(node, *AXES, "eps", "e.*")
    each = each.where("hi - lo > eps").withColumn("bin", F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * lit(bins))))
    both = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    return each.groupBy(node, "axis", "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("eps").alias("eps"), *both)


def area_cuts(binned: DataFrame, node: str = "node", bins: int = 256) -> DataFrame:
    """(node, axis, bin, cut): for each node the end of the bin behind which a cut costs least.

    A cut costs the surfaces of both sides' boxes times their rows, times both volumes, by the node's own, and more across
    shorter axes. Of equal cuts that of less volume, less of the larger volume, less surface, less of the larger surface,
    more even sides, a longer axis, the first axis, the first bin. Boxes of both sides are running ones over the bins of an
    axis, of which a node has ``bins`` at most.
    """
    by = Window.partitionBy(node, "axis").orderBy("bin")
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    whole, all_axes = Window.partitionBy(node, "axis"), Window.partitionBy(node)
    sides = {"l": before, "r": after, "p": whole}
    columns = {f"{k}n": F.sum("n").over(w) for k, w in sides.items()}
    columns |= {f"{k}_{end}_{a}": f(f"{end}_{a}").over(w) for k, w in sides.items() for end, f in (("min", F.min), ("max", F.max)) for a in AXES}
    b = binned.withColumns(columns).withColumn("longest", F.max(F.col("hi") - F.col("lo")).over(all_axes)).where("rn IS NOT NULL")
    length = {f"{k}{a}": F.greatest("eps", F.col(f"{k}_max_{a}") - F.col(f"{k}_min_{a}")) for k in sides for a in AXES}
    b = b.withColumns(length)
    x, y, z = ({k: F.col(f"{k}{a}") for k in sides} for a in AXES)
    b = b.withColumns({f"{k}s": lit(2) * (x[k] * y[k] + x[k] * z[k] + y[k] * z[k]) * (F.lit(1) if k == "p" else F.col(f"{k}n")) for k in sides} | {f"{k}v": x[k] * y[k] * z[k] for k in sides})
    extent = F.col("hi") - F.col("lo")
    sah, volume = F.col("ls") + F.col("rs"), F.col("lv") + F.col("rv")
    score = sah / (F.col("ps") * F.col("pn")) * volume / F.col("pv") * F.sqrt(F.col("longest") / extent)
    order = [score, volume, F.greatest("lv", "rv"), sah, F.greatest("ls", "rs"), F.abs(F.col("ln") - F.col("rn")) / F.col("pn"), -extent, F.col("axis"), F.col("bin")]
    cut = F.col("lo") + extent * (F.col("bin") + 1) / lit(bins)
    first = F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), cut.alias("cut"))).alias("f")
    return b.groupBy(node).agg(first).select(node, F.col("f.o7").alias("axis"), F.col("f.o8").alias("bin"), "f.cut")


def regions(rows: DataFrame, limit: int, key: str = "id", depth: int = 48) -> DataFrame:
    """``rows`` with a region of at most ``limit`` rows each: nodes over the limit are cut, all of a level in one pass.

    Coincident centres can't be cut; such a node is dealt out by key.
    """
    rows = checkpointed(rows.withColumn("region", F.lit("r")))
    done = None
    for _ in range(depth):
        counts = rows.groupBy("region").agg(F.count("*").alias("__n"))
        full = checkpointed(counts.where(F.col("__n") > limit))
        small = rows.join(full, "region", "left_anti")
        done = small if done is None else done.unionByName(small)
        if full.isEmpty():
            return done
        big = rows.join(full, "region")
        cuts = area_cuts(box_bins(big.select("region", *AXES), "region"), "region").drop("bin")
        at = F.element_at(F.array(*POSITION), F.col("axis") + 1)
        parted = big.join(cuts, "region", "left")
        one = F.when(F.col("axis").isNull(), F.concat(F.lit("s"), F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / limit) + 1)))
        side = F.coalesce(one, F.when(at < F.col("cut"), F.lit("0")).otherwise(F.lit("1")))
        rows = checkpointed(parted.withColumn("region", F.concat("region", side)).drop("__n", "axis", "cut"))
    raise RuntimeError(f"regions are not within {limit} rows after {depth} cuts")


def packed_leaves(leaves: DataFrame, limit: int, group: str = "level", order: str = "leaf", size: str = "size") -> DataFrame:
    """``leaves`` with a chunk number: filled in order, a leaf that no longer fits opens the next. One row is a leaf's
    metadata; a level's are read in one pass by one task."""
    kinds = {c: leaves.schema[c].dataType.simpleString() for c in (group, order)}

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        chunk, used, out = 0, 0, []
        for s in rows[size].to_pylist():
            if used and used + s > limit:
                chunk, used = chunk + 1, 0
            used += s
            out.append(chunk)
        return pa.table({group: rows[group], order: rows[order], "chunk": pa.array(out, pa.int64())})

    return leaves.select(group, order, F.col(size).cast("long").alias(size)).groupBy(group).applyInArrow(fill, f"{group} {kinds[group]}, {order} {kinds[order]}, chunk long")


def with_covariance(rows: DataFrame) -> DataFrame:
    return rows.withColumns(dict(zip(COVARIANCE, G.covariance(SCALE, ROTATION))))


def mass() -> Column:
    """What a row weighs in a merge: its surface times its opacity."""
    return G.surface(SCALE) * F.col("opacity")


def merged_moments(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, weight, x, y, z, r, g, b, covariance): weighted moments of each group.

    Sums are taken around the group's first centre, so that far groups lose no digits; groups without weight count rows.
    """
    rows = with_covariance(rows).withColumn("__w", mass())
    origin = rows.groupBy(*keys).agg(*(F.min(a).alias(f"__o{a}") for a in AXES), F.sum("__w").alias("__all"))
    rows = rows.join(origin, list(keys))
    w = F.when(F.col("__all") > 0, F.col("__w")).otherwise(lit(1))
    d = [F.col(a) - F.col(f"__o{a}") for a in AXES]
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    sums = [F.sum(w).alias("__w"), F.count("*").alias("n"), F.first("__all").alias("weight"), *(F.first(f"__o{a}").alias(f"__o{a}") for a in AXES)]
    sums += [F.sum(w * x).alias(f"__s{i}") for i, x in enumerate(d)] + [F.sum(w * c).alias(f"__k{i}") for i, c in enumerate(COLOUR)]
    sums += [F.sum(w * (F.col(c) + d[i] * d[j])).alias(f"__c{c}") for c, (i, j) in zip(COVARIANCE, pairs)]
    out = rows.groupBy(*keys).agg(*sums)
    m = [F.col(f"__s{i}") / F.col("__w") for i in range(3)]
    return out.select(
        *keys, "n", "weight", *((F.col(f"__o{a}") + x).alias(a) for a, x in zip(AXES, m)),
        *((F.col(f"__k{i}") / F.col("__w")).alias(c) for i, c in enumerate("rgb")),
        *((F.col(f"__c{c}") / F.col("__w") - m[i] * m[j]).alias(c) for c, (i, j) in zip(COVARIANCE, pairs)),
    )


def _shapes(batches):
    """Scales and rotations of covariances, largest axis first, and the opacity that keeps the weight; null where a
    covariance isn't finite."""
    for batch in batches:
        rows = batch.to_pandas()
        c = rows[list(COVARIANCE)].to_numpy(float)
        fine = np.isfinite(c).all(axis=1)
        made = np.full((len(c), 8), np.nan)
        made[fine] = shaped(c[fine][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3), rows["weight"].to_numpy(float)[fine])
        names = ["sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, mask=~fine) for x in made.T)], names=[*batch.schema.names, *names])


def merge_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """One Gaussian for each group: its moments, and the scales and rotation of their covariance."""
    moments = merged_moments(rows, *keys)
    new = ("sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity")
    schema = T.StructType([*moments.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])
    return moments.mapInArrow(_shapes, schema).drop(*COVARIANCE)


def mean_harmonics(rows: DataFrame, *keys: str, weight: Column | None = None, column: str = "sh") -> DataFrame:
    """(keys, column): each coefficient's weighted mean over a group; what a row lacks counts as zero.

    ``column`` holds arrays, of any lengths or null; the mean is as long as the longest. Groups without weight count rows.
    """
    w = mass() if weight is None else weight
    rows = rows.select(*keys, w.alias("__w"), column)
    whole = rows.groupBy(*keys).agg(F.sum("__w").alias("__all"), F.count("*").alias("__n"))
    each = rows.select(*keys, "__w", F.posexplode(column).alias("__k", "__v"))
    sums = each.groupBy(*keys, "__k").agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"), F.sum("__v").alias("__p"))
    arrays = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__k", "__s", "__p"))).alias("__c"))
    mean = F.transform("__c", lambda c: F.when(F.col("__all") > 0, c["__s"] / F.col("__all")).otherwise(c["__p"] / F.col("__n")))
    return whole.join(arrays, list(keys), "left").select(*keys, mean.alias(column))


def assigned(rows: DataFrame, representatives: DataFrame, radius: float, key: str = "id", cell: float | None = None) -> DataFrame:
    """(key, rep, distance) of every row: its nearest representative within the radius, ties to the smaller id, or null.

    Representatives are spread to the 27 cells around theirs, so that rows are joined once, by cell. They are meant to be
    few in a cell; a cell with a third of all rows is split by the join, since only they are repeated.
    """
    side = cell or radius
    if side < radius:
        raise ValueError("cells must be at least as long as the radius")
    at = lambda: [F.floor(F.col(a) / lit(side)) for a in AXES]
    around = F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip(AXES, d))) for d in np.ndindex(3, 3, 3)))
    reps = representatives.select(F.col(key).alias("rep"), *(F.col(a).alias(f"r{a}") for a in AXES), *(c.alias(f"c{a}") for a, c in zip(AXES, at())), F.explode(around).alias("d"))
    reps = reps.select("rep", *(f"r{a}" for a in AXES), *((F.col(f"c{a}") + F.col(f"d.d{a}") - 1).alias(f"c{a}") for a in AXES))
    cells = rows.select(key, *AXES, *(c.alias(f"c{a}") for a, c in zip(AXES, at())))
    d = V.length([F.col(a) - F.col(f"r{a}") for a in AXES])
    near = cells.join(reps, [f"c{a}" for a in AXES]).select(key, "rep", d.alias("distance")).where(F.col("distance") <= lit(radius))
    best = near.groupBy(key).agg(F.min(F.struct("distance", "rep")).alias("m")).select(key, "m.rep", "m.distance")
    return rows.select(key).join(best, key, "left")


def assigned_in_tiers(rows: DataFrame, representatives: DataFrame, radii: list[float], key: str = "id") -> DataFrame:
    """(key, rep, distance) of every row: its nearest representative, ties to the smaller id.

    The first radius is tried for all rows, the next ones for those that found none, so that cells stay as small as most
    rows allow; rows beyond the last radius have null.
    """
    rest, out = rows, None
    for i, radius in enumerate(radii):
        found = checkpointed(assigned(rest, representatives, radius, key))
        done = found if i == len(radii) - 1 else found.where("rep IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        rest = rest.join(found.where("rep IS NULL").select(key), key, "left_semi")
    return out


def first_of_cells(rows: DataFrame, side: float, key: str = "id") -> DataFrame:
    """The row with the smallest id of each cell."""
    best = rows.groupBy(*(F.floor(F.col(a) / lit(side)) for a in AXES)).agg(F.min(key).alias(key)).select(key)
    return rows.join(best, key, "left_semi")


def cell_medoids(rows: DataFrame, side: float, key: str = "id") -> DataFrame:
    """One representative of each cell: of the rows nearest to its weighted mean that with the smallest id."""
    cells = {f"c{a}": F.floor(F.col(a) / lit(side)) for a in AXES}
    w = G.feature_size(SCALE, F.col("opacity")) * F.col("opacity")
    rows = rows.withColumns(cells).withColumn("__w", w)
    mean = rows.groupBy(*cells).agg(*((F.sum(F.col("__w") * F.col(a)) / F.sum("__w")).alias(f"m{a}") for a in AXES))
    d = V.length([F.col(a) - F.col(f"m{a}") for a in AXES])
    best = rows.join(mean, list(cells)).groupBy(*cells).agg(F.min(F.struct(d.alias("d"), F.col(key))).alias("m")).select(F.col(f"m.{key}").alias(key))
    return rows.join(best, key, "left_semi").drop("__w", *cells)


def morton_tree(ordered: DataFrame, levels: int = 4) -> DataFrame:
    """(level, node, n, bounds, feature): a node for each prefix of the Morton code, root first."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    rows = ordered.select("morton", *AXES, G.feature_size(SCALE, F.col("opacity")).alias("feature"), steps)
    node = F.expr("shiftright(morton, 30 - 3 * level)")
    return rows.groupBy("level", node.alias("node")).agg(
        F.count("*").alias("n"), *(F.min(a).alias(f"min_{a}") for a in AXES), *(F.max(a).alias(f"max_{a}") for a in AXES), F.max("feature").alias("feature")
    )


def kept_nodes(nodes: DataFrame, base: float, levels: int) -> DataFrame:
    """(level, node, kept): a node stays if it is the root or a leaf, or its feature is at least ``base`` times the largest
    of its kept children; one that goes hands that largest up in its stead. A join for each level, from the leaves."""
    below, out = None, None
    for level in range(levels, -1, -1):
        own = nodes.where(F.col("level") == level).select("level", "node", "feature")
        if below is None:
            own = own.withColumns({"kept": F.lit(True), "up": F.col("feature")})
        else:
            largest = below.groupBy(F.shiftright("node", 3).alias("node")).agg(F.max("up").alias("child"))
            own = own.join(largest, "node", "left")
            keep = (F.col("level") == 0) | F.col("child").isNull() | (F.col("feature") >= lit(base) * F.col("child"))
            own = own.withColumn("kept", keep).withColumn("up", F.when(keep, F.col("feature")).otherwise(F.col("child")))
        below = own.select("level", "node", "kept", "up")
        out = below if out is None else out.unionByName(below)
    return out.select("level", "node", "kept")


def view_distance(behind: float = 1.0, shrink: float = 0.0) -> Column:
    """Of a node's bounds to a view (vx, vy, vz looking along ax, ay, az), longer behind it; at least 1e-6."""
    low = [F.col(f"min_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * lit(shrink / 2) for a in AXES]
    high = [F.col(f"max_{a}") - (F.col(f"max_{a}") - F.col(f"min_{a}")) * lit(shrink / 2) for a in AXES]
    p = V.columns("vx vy vz")
    d = [F.least(F.greatest(x, a), b) - x for x, a, b in zip(p, low, high)]
    back = F.greatest(-V.dot(d, V.columns("ax ay az")), lit(0))
    return F.greatest(V.length(d) + back * lit(behind - 1), lit(1e-6))


def budgeted_cut(nodes: DataFrame, budget: int, levels: int, base: float = 64.0, multiplier: float = 2.0) -> DataFrame:
    """(level, node): the cut that refining nodes in order of their key gives within the budget of nodes.

    nodes: level, node, distance. A node's key is no smaller than its parent's, so that the refined nodes are a prefix of
    that order; nodes of equal keys are refined together or not at all. Finer levels are refined nearer, by ``multiplier``.
    """
    keyed = None
    above = None
    for level in range(levels + 1):
        own = nodes.where(F.col("level") == level).withColumn("key", F.ln(F.col("distance") / lit(base)) - lit((levels - level - 1) * np.log(multiplier)))
        if above is not None:
            parent = above.select(F.col("node").alias("__p"), F.col("key").alias("__k"))
            own = own.join(parent, F.shiftright("node", 3) == F.col("__p")).withColumn("key", F.greatest("key", "__k")).drop("__p", "__k")
        above = own.select("level", "node", "key")
        keyed = above if keyed is None else keyed.unionByName(above)
    keyed = checkpointed(keyed.withColumn("key", F.round("key", 9)))
    children = keyed.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("node", 3).alias("node")).agg(F.count("*").alias("c"))
    inner = keyed.join(children, ["level", "node"])
    steps = inner.groupBy("key").agg(F.sum(F.col("c") - 1).alias("more"))
    used = running_totals(steps, ["key"], {"total": F.col("more")})
    roots = keyed.where("level = 0").count()
    refined = inner.join(used.where(F.col("total") + roots <= budget).select("key"), "key", "left_semi").select("level", "node")
    up = keyed.select("level", "node", (F.col("level") - 1).alias("__l"), F.shiftright("node", 3).alias("__p"))
    shown = up.join(refined.select(F.col("level").alias("__l"), F.col("node").alias("__p")), ["__l", "__p"]).select("level", "node")
    return keyed.where("level = 0").select("level", "node").unionByName(shown).join(refined, ["level", "node"], "left_anti")


def cut_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): what comes in, goes out and stays between two cuts."""
    a, b = before.select(*keys, F.lit(1).alias("__a")), after.select(*keys, F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull(), "incoming").when(F.col("__b").isNull(), "outgoing").otherwise("shared")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def tree_errors(nodes: DataFrame) -> DataFrame:
    """(node_id, error) of a tree given as child ranges (node_id, child_start, child_count): children that are missing,
    owned twice, or not behind their parent (so that no cycle can be)."""
    owned = nodes.where("child_count > 0").select(F.col("node_id").alias("parent"), F.explode(F.expr("sequence(child_start, child_start + child_count - 1)")).alias("node_id"))
    early = owned.where("node_id <= parent").select("node_id", F.lit("not behind its parent").alias("error"))
    twice = owned.groupBy("node_id").count().where("count > 1").select("node_id", F.lit("owned twice").alias("error"))
    gone = owned.join(nodes, "node_id", "left_anti").select("node_id", F.lit("missing").alias("error"))
    return early.unionByName(twice).unionByName(gone)


def texture_bytes(rows: Column, sh_degree: int, indexed: bool = False) -> Column:
    """Bytes that rows take: two records of 16, and for harmonics four bytes of label or 16 for each block."""
    blocks = {0: 0, 1: 1, 2: 2, 3: 4, 4: 6}[sh_degree]
    return rows * (36 if indexed and blocks else 32 + 16 * blocks)


def manifest(leaves: DataFrame) -> str:
    """The JSON text of a scene's leaves; a row each, metadata only."""
    return json.dumps([r.asDict(recursive=True) for r in leaves.orderBy("level", "leaf").toLocalIterator()])

