"""Queries of quotas, page accounts and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts, trees
from ..operators.running import stored
from .adapter import splats, table
from .registry import S, query


@query(S + """, b AS (SELECT segment, count(*) AS n FROM s GROUP BY segment), t AS (SELECT sum(n) AS total FROM b)
SELECT segment, n, least(greatest(CAST(floor(n * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT), 1), n) AS quota FROM b, t""")
def block_quotas(spark, sf_dir):
    blocks = splats(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"))
    return trees.representative_quotas(blocks, 100)


@query("""SELECT s_suppkey AS page, CAST(s_suppkey % 5 AS INTEGER) AS degree,
CAST(65536 * CASE s_suppkey % 5 WHEN 0 THEN 32 WHEN 1 THEN 48 WHEN 2 THEN 64 WHEN 3 THEN 96 ELSE 128 END AS BIGINT) AS bytes FROM supplier""")
def page_accounts(spark, sf_dir):
    k = F.col("s_suppkey")
    pages = [table(spark, sf_dir, "supplier").where(k % 5 == d).select(k.alias("page"), F.lit(d).alias("degree"), trees.page_bytes(d).alias("bytes")) for d in range(5)]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH p AS (SELECT o_orderkey AS page, o_orderkey % 97 AS priority, o_orderkey % 13 + 1 AS bytes FROM orders),
t AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY priority, page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM p) SELECT page, priority, bytes, used FROM t WHERE used <= 5000""")
def pages_admitted(spark, sf_dir):
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(k.alias("page"), (k % 97).alias("priority"), (k % 13 + 1).alias("bytes"))
    return trees.admitted(pages, 5000, ["priority", "page"])


#: A tree of four depths over the orders: nodes are their keys without the lower bits, numbered apart by depth.
_SHIFTS = (12, 10, 8, 6)
_NODE = " UNION ALL ".join(f"SELECT DISTINCT {d} * 1000000 + (o_orderkey >> {s}) AS node, {f'{d - 1} * 1000000 + (o_orderkey >> {_SHIFTS[d - 1]})' if d else 'NULL'} AS parent, {d} AS depth FROM orders" for d, s in enumerate(_SHIFTS))
#: Ranges of the leaves in three levels: the first is of two files, the last has gaps.
_LEAVES = """leaves AS (SELECT 3000000 + (o_orderkey >> 6) AS node, 0 AS level, CAST(CASE WHEN (o_orderkey >> 6) % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS file, min(o_orderkey) AS start, count(*) AS n FROM orders GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT 3000000 + (o_orderkey >> 6), 1, CAST(2 AS BIGINT), (o_orderkey >> 6) * 16, CAST(16 AS BIGINT) FROM orders
UNION ALL SELECT DISTINCT 3000000 + (o_orderkey >> 6), 2, CAST(3 AS BIGINT), (o_orderkey >> 6) * 4, CAST(4 AS BIGINT) FROM orders WHERE (o_orderkey >> 6) % 5 <> 0)"""
_ABOVE = " UNION ALL ".join(f"SELECT {d} * 1000000 + ((node - 3000000) >> {s - 6}) AS node, {d} AS depth, level, file, start, n FROM leaves" for d, s in enumerate(_SHIFTS))


def _tree(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda d: F.lit(d * 1_000_000).cast("long") + F.shiftright("k", _SHIFTS[d])
    none = F.lit(None).cast("long")
    parts = [k.select(name(d).alias("node"), (name(d - 1) if d else none).alias("parent"), F.lit(d).alias("depth")).distinct() for d in range(4)]
    leaf = F.shiftright("k", 6)
    first = k.groupBy(name(3).alias("node"), F.lit(0).alias("level"), F.when(leaf % 7 == 3, 1).otherwise(0).cast("long").alias("file")).agg(F.min("k").alias("start"), F.count("*").alias("count"))
    second = k.select(name(3).alias("node"), F.lit(1).alias("level"), F.lit(2).cast("long").alias("file"), (leaf * 16).alias("start"), F.lit(16).cast("long").alias("count")).distinct()
    third = k.where(leaf % 5 != 0).select(name(3).alias("node"), F.lit(2).alias("level"), F.lit(3).cast("long").alias("file"), (leaf * 4).alias("start"), F.lit(4).cast("long").alias("count")).distinct()
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), first.unionByName(second).unionByName(third)


@query(f"""WITH {_LEAVES}, a AS ({_ABOVE}) SELECT node, depth, level, CASE WHEN count(DISTINCT file) = 1 AND max(start + n) - min(start) = sum(n) THEN min(file) ELSE -1 END AS file,
min(start) AS start, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY node, depth, level""")
def promoted_ranges(spark, sf_dir):
    tree, ranges = _tree(spark, sf_dir)
    return cuts.promoted(tree, ranges).select("node", "depth", "level", "file", "start", F.col("count").alias("n"))


@query(f"WITH {_LEAVES} SELECT level, CAST(sum(n) AS BIGINT) AS n, TRUE AS whole FROM leaves GROUP BY level")
def shown_ranges(spark, sf_dir):
    """Rows of all shown ranges of a level, which are those of its leaves, and whether each is of one file."""
    shown = cuts.shown_ranges(*_tree(spark, sf_dir), 3, most=300)
    return shown.groupBy("level").agg(F.sum("count").alias("n"), F.every((F.col("file") >= 0) | (F.col("count") == 0)).alias("whole"))


#: Nodes of the tree with one root are numbered apart by more than their number can be.
_APART = 10**12


def _rooted(spark, sf_dir):
    """(leaf, nodes of its path) and the tree's (node, parent, depth): the depths of ``_tree`` under as many more, counted
    down from -1, as it takes to come to one root, so that a budget covers the roots however many orders there are."""
    leaf = F.shiftright("o_orderkey", _SHIFTS[-1])
    leaves = stored(table(spark, sf_dir, "orders").select(leaf.alias("leaf")).dropna().distinct())
    shifts = {d: s - _SHIFTS[-1] for d, s in enumerate(_SHIFTS)}
    last, top = leaves.agg(F.max("leaf")).first()[0] or 0, 0
    while last >> shifts[top] > 0:
        shifts[top - 1] = shifts[top] + 2
        top -= 1
    name = {d: F.lit(d * _APART) + F.shiftright("leaf", s) for d, s in shifts.items()}
    none = F.lit(None).cast("long")
    tree = None
    for d in sorted(shifts):
        part = leaves.select(name[d].alias("node"), name.get(d - 1, none).alias("parent"), F.lit(d).alias("depth")).distinct()
        tree = part if tree is None else tree.unionByName(part)
    return leaves.select("leaf", F.explode(F.array(*name.values())).alias("node")), tree


@query("SELECT count(DISTINCT o_orderkey >> 6) AS n_leaves, count(DISTINCT o_orderkey >> 6) AS n_covered_once, TRUE AS within FROM orders")
def relaxed_cut(spark, sf_dir):
    """Leaves, those that have exactly one node of the cut above them or are in it, and whether the cut is within its bound."""
    above, tree = _rooted(spark, sf_dir)
    size = (F.pmod(F.col("node") * 7919, F.lit(1000)) + 1).cast("double") * F.pow(F.lit(4.0), 3 - F.col("depth"))
    cut = stored(cuts.relaxed_cut(tree.select("node", "parent", size.alias("size")), 60, threshold=2.0))
    met = above.join(cut.withColumn("hit", F.lit(1)), "node", "left").groupBy("leaf").agg(F.sum("hit").alias("hits"))
    n = cut.agg(F.count("*").alias("rows"))
    return met.agg(F.count("*").alias("n_leaves"), F.count(F.when(F.col("hits") == 1, 1)).alias("n_covered_once")).join(n).select("n_leaves", "n_covered_once", (F.col("rows") <= 66).alias("within"))
