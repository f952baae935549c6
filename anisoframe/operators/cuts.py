"""Cuts through trees by size within a budget, and ranges of files that move up a tree where they join."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import running_totals, stored

#: Parts of a doubling of size in which nodes are counted, and rows that a shown range may have.
PARTS, NODE_ROWS = 64, 4096


def with_keys(nodes: DataFrame, depth: int = 200) -> DataFrame:
    """``nodes`` (node, parent, size) with ``level`` from the roots (whose parent is null), ``key``, the least size from a
    root down to the node, and ``children``. A join for each level; what no root leads to has no row."""
    counts = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    nodes = stored(nodes.select("node", "parent", F.col("size").cast("double").alias("size")).join(counts, "node", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))
    here = stored(nodes.where("parent IS NULL").withColumns({"level": F.lit(0), "key": F.col("size")}))
    out = here
    for level in range(1, depth):
        above = here.select(F.col("node").alias("parent"), F.col("key").alias("__above"))
        here = stored(nodes.join(above, "parent").withColumns({"level": F.lit(level), "key": F.least("size", "__above")}).select(*out.columns))
        if here.isEmpty():
            return stored(out)
        out = out.unionByName(here)
    raise RuntimeError(f"the tree is deeper than {depth}")


def relaxed_cut(nodes: DataFrame, budget: int, threshold: float = 1.0, tolerance: float = 0.1, start: float = 1000.0) -> DataFrame:
    """(node, level) of a cut: no node is above another, every leaf is in it or below one of it.

    nodes: node, parent (null: a root), size. Nodes larger than a limit are refined, if those above them are; the limit
    starts at ``start`` times the threshold and is relaxed round by round, at most to a half and less the nearer the cut is
    to the budget, until the budget is reached or the limit is the threshold. Rounds are looked for in counts of nodes by
    size, of which there is a fixed number. The last round goes from the largest key down (then from the upper levels, then
    by node) as long as all rows together are within (1 + tolerance) times the budget.
    """
    keyed = with_keys(nodes)
    roots = keyed.where("level = 0").count()
    if not roots:
        return keyed.select("node", "level")
    if budget < roots:
        raise ValueError(f"a budget of {budget} for {roots} roots")
    inner = keyed.where("children > 0").where(F.col("key") > threshold)
    bucket = F.floor(F.log2("key") * PARTS)
    found = inner.groupBy(bucket.alias("b")).agg(F.sum(F.col("children") - 1).alias("more")).orderBy(F.desc("b")).collect()  # bounded by the sizes of doubles
    cap, limit, used, before = int(budget * (1 + tolerance)), start * threshold, roots, None

    def over(value: float) -> int:
        """Rows of the cut that refines the whole buckets above a limit."""
        return roots + sum(r["more"] for r in found if 2 ** (r["b"] / PARTS) >= value)

    while True:
        now = over(limit)
        if now > cap:
            break
        before, used = limit, now
        if used >= budget or limit <= threshold:
            break
        limit = max(0.99 * limit * sqrt(used / budget), 0.5 * limit, threshold)
    whole = inner.where(F.pow(F.lit(2.0), bucket / PARTS) >= before) if before is not None else inner.limit(0)
    refined = whole.select("node")
    if before is None or used < budget:
        rest = inner.join(refined, "node", "left_anti").where(F.pow(F.lit(2.0), bucket / PARTS) >= limit) if limit > threshold else inner.join(refined, "node", "left_anti")
        order = running_totals(rest.select("node", "key", "level", "children"), [F.desc("key"), F.asc("level"), F.asc("node")], {"__more": F.col("children") - 1})
        refined = refined.unionByName(order.where(F.col("__more") <= cap - used).select("node"))
    refined = stored(refined)
    shown = keyed.join(refined.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "level")
    return keyed.where("level = 0").select("node", "level").unionByName(shown).join(refined, "node", "left_anti")


def promoted(tree: DataFrame, ranges: DataFrame) -> DataFrame:
    """(node, parent, depth, level, file, start, count) of the ranges of all nodes.

    tree: node, parent, depth (0 for roots); ranges: node, level, file, start, count of the leaves. A level's ranges of a
    node's children become one if they are of one file and follow each other without a gap; else the node's file is -1 and
    only the counts are added. A join for each depth from below; a node's children are few.
    """
    depths = tree.agg(F.max("depth")).first()[0]
    own = stored(tree.join(ranges, "node"))
    columns = ["node", "parent", "depth", "level", "file", "start", "count"]
    out = own = own.select(*columns)
    if depths is None:
        return out
    for depth in range(depths - 1, -1, -1):
        parts = out.where(F.col("depth") == depth + 1)
        by = Window.partitionBy("parent", "level").orderBy("start")
        parts = parts.withColumn("__due", F.sum("count").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        parts = parts.withColumns({"__due": F.first("start").over(by) + F.coalesce("__due", F.lit(0)), "__file": F.first("file").over(by)})
        fits = F.every((F.col("file") == F.col("__file")) & (F.col("start") == F.col("__due")) & (F.col("file") >= 0))
        made = parts.groupBy(F.col("parent").alias("node"), "level").agg(F.when(fits, F.min("file")).otherwise(F.lit(-1)).alias("file"), F.min("start").alias("start"), F.sum("count").alias("count"))
        made = tree.where(F.col("depth") == depth).join(made, "node").select(*columns)
        out = stored(out.unionByName(made))
    return out


def shown_ranges(tree: DataFrame, ranges: DataFrame, levels: int, most: int = NODE_ROWS) -> DataFrame:
    """(node, level, file, start, count, up_node, up_level): what a viewer loads, a tree of ranges from the coarsest level.

    Of a node of the tree those levels are shown that the nodes above don't show and in which its range, and those of all
    coarser levels, are of one file and have at most ``most`` rows; leaves show all that is left. A range hangs on that of
    the next coarser level, of the node itself or of the nearest one above that shows any.
    """
    every = stored(promoted(tree, ranges))
    large = every.where((F.col("count") > most) | (F.col("file") < 0)).groupBy("node").agg((F.max("level") + 1).alias("finest"))
    inner = tree.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    nodes = stored(tree.join(large, "node", "left").join(inner, "node", "left").select("node", "parent", "depth", F.coalesce("finest", F.lit(0)).alias("finest"), F.coalesce("inner", F.lit(False)).alias("inner")))
    low = F.when(F.col("inner"), F.least(F.col("finest"), F.col("coarsest") + 1)).otherwise(F.lit(0))
    none = F.lit(None).cast(tree.schema["node"].dataType)
    here = nodes.where("parent IS NULL").withColumns({"coarsest": F.lit(levels - 1), "up_node": none, "up_level": F.lit(None).cast("int")}).withColumn("low", low)
    out, depth = stored(here), 0
    here = out
    while True:
        shows = F.col("low") <= F.col("coarsest")
        above = here.select(F.col("node").alias("parent"), (F.col("low") - 1).alias("coarsest"), F.when(shows, F.col("node")).otherwise(F.col("up_node")).alias("up_node"), F.when(shows, F.col("low")).otherwise(F.col("up_level")).alias("up_level"))
        here = stored(nodes.join(above, "parent").where("coarsest >= 0").withColumn("low", low).select(*out.columns))
        if here.isEmpty():
            break
        out, depth = out.unionByName(here), depth + 1
    placed = out.where("low <= coarsest").select("node", "coarsest", "up_node", "up_level", F.explode(F.sequence("low", "coarsest")).alias("level"))
    top = F.col("level") == F.col("coarsest")
    held = placed.join(every.select("node", "level", "file", "start", "count"), ["node", "level"], "left")
    return held.select(
        "node", "level", F.coalesce("file", F.lit(-1)).alias("file"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("count", F.lit(0)).alias("count"),
        F.when(top, F.col("up_node")).otherwise(F.col("node")).alias("up_node"), F.when(top, F.col("up_level")).otherwise(F.col("level") + 1).alias("up_level"),
    )
