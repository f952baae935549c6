"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Equal fingerprints are collapsed first. The 64 bits are cut into six blocks; of two fingerprints that differ in at most
four bits at least two blocks agree, so every link lies in one of the fifteen tables keyed by two blocks. The rows of a
key form a shard with its own BK-tree: children keyed by the Hamming distance to the parent, and only edges within the
radius followed. Keys with more rows than a shard holds are cut into several shards and each fingerprint visits the
shards before its own. The trees grow with the corpus, so they are not broadcast: each is built by the task that
searches it.

Inside a shard a subtree whose members are all linked to the query already is skipped, so a group of thousands of near
copies costs a few visits each, and the shard reports a spanning forest of its links, which leaves the components whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG, as_bytes, checkpointed, fresh, join_hot, small_batches, turn
from .components import connected_components

#: Bits of the six blocks, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 4
SHARD = 4096


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text: 64 majority votes over XXH64 (seed 42) of its word shingles, repeats included.

    A-Z are lower-cased and words split at ASCII white space. A text of fewer words than a shingle is one shingle; a
    text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        votes = [digest(joined, 42)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        votes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(votes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(votes), bitorder="little").view(np.uint64)[0])


def fingerprints(text_col: str, shingle: int = 4) -> Column:
    """Fingerprints of a text column, as longs."""

    def look(texts: pa.Array) -> pa.Array:
        turn("fingerprints")
        return pa.array(np.array([fingerprint(b, shingle) for b in as_bytes(texts)], np.uint64).view(np.int64))

    return F.arrow_udf(look, LONG)(text_col)


class BKTree:
    """Fingerprints under Hamming distance, with the components that links within ``radius`` form."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent, self.uniform = radius, [], [], [], []

    def find(self, i: int) -> int:
        up = self.parent
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def links(self, value: int) -> Iterator[int]:
        """One node within the radius for each component that has any."""
        found: set[int] = set()
        stack = [0] if self.values else []
        values, children, uniform, radius = self.values, self.children, self.uniform, self.radius
        while stack:
            node = stack.pop()
            if found and uniform[node] >= 0 and self.find(uniform[node]) in found:
                continue
            d = (values[node] ^ value).bit_count()
            if d <= radius and (root := self.find(node)) not in found:
                found.add(root)
                yield node
            for k, child in children[node].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)

    def add(self, value: int) -> list[int]:
        """Insert a value; returns the values it was linked to, one for each component it joined."""
        near = list(self.links(value))
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        self.uniform.append(new)
        for node in near:
            self.parent[self.find(node)] = new
        node = 0
        while node != new:
            if self.uniform[node] >= 0 and self.find(self.uniform[node]) != new:
                self.uniform[node] = -1
            d = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(d, new)
        return [self.values[node] for node in near]


def _search(radius: int):
    """Rows (key, shard, visits, fp), ordered so: a shard's own rows build its tree, then its visitors search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, BKTree(radius)
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            keys, shards, visits = (batch.column(c).to_pylist() for c in ("key", "shard", "visits"))
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).tolist()
            for key, shard, visit, value in zip(keys, shards, visits, values):
                if at != (key, shard):
                    at, tree = (key, shard), BKTree(radius)
                near = [tree.values[i] for i in tree.links(value)] if visit else tree.add(value)
                u += [value] * len(near)
                v += near
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return run


def _keys(fp: str) -> Column:
    """The fifteen table keys of a fingerprint."""
    shifts = [0, *accumulate(BLOCKS)]
    block = [F.shiftrightunsigned(fp, shifts[i]).bitwiseAND((1 << BLOCKS[i]) - 1) for i in range(len(BLOCKS))]
    return F.array(*(
        F.shiftleft(F.lit(t).cast("long"), 22) + F.shiftleft(block[a], 11) + block[b]
        for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ))


def near_links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v): links between distinct fingerprints (``fp``: long) at ``radius`` bits or fewer.

    In each shard a spanning forest of the links, so that components are those of all links.
    """
    if radius > 4:
        raise ValueError("six blocks with two equal hold for at most four differing bits")
    rows = values.select("fp", F.explode(_keys("fp")).alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(full, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / shard)).cast("int"))
    rows = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("shard"), "own", "fp")
    rows = rows.select("key", "shard", (F.col("shard") != F.col("own")).alias("visits"), "fp")
    return rows.repartition("key", "shard").sortWithinPartitions("key", "shard", "visits", "fp").mapInArrow(_search(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id, root) of every row; component_id is the smallest id that links reach, the row's own included,
    and root a fingerprint that stands for the component.

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal text share a fingerprint, rows with
    equal id stay rows. Null ids count as no id: a component of null ids only has a null component_id. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprints(text_col).alias("fp")))
    values = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = connected_components(near_links(values, radius))
    member = values.join(roots, values.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    member = checkpointed(member)
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(member, smallest, ["root"], member.count(), "members").select("fp", "component_id", "root", "n")
    return join_hot(rows, checkpointed(named), ["fp"], rows.count()).select(F.col("id").alias(id_col), "fp", "component_id", "root")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the component's smallest id (one, if repeated)."""
    near = checkpointed(near_duplicates(docs, id_col, text_col))
    best = near.groupBy("root").agg(F.min(F.struct(id_col, "fp")).alias("best")).select("best.*")
    fp, ids = fresh("fp", docs.columns), fresh("best_id", docs.columns)
    best = best.select(F.col(id_col).alias(ids), F.col("fp").alias(fp + "_of"))
    kept = docs.withColumn(fp, fingerprints(text_col)).join(
        best, (F.col(fp) == F.col(fp + "_of")) & F.col(id_col).eqNullSafe(F.col(ids)), "left_semi"
    )
    if not near.groupBy(id_col, "fp").count().where("count > 1").isEmpty():  # repeated rows: only then a second shuffle
        kept = kept.dropDuplicates([id_col, fp])
    return kept.select(*docs.columns)
