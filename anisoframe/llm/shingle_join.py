"""Near-duplicate documents: SimHash first, and then all that it misses by the Jaccard similarity of word shingles.

First the BK-trees of ``simhash`` link fingerprints (of the same shingles) that differ in a few bits, and the linked texts
are compared by their whole shingle sets. At 80 % about 10 of 64 bits differ, and a radius that reaches nearly all such
pairs leaves no blocks that are equal and still tell texts apart; so what isn't linked yet is joined by shingles.

The distinct shingles of all texts are put in one order, common ones last. Of two sets of which ``percent`` of the union or
more is shared, the first n - ceil(percent n / 100) + 1 shingles of each have one in common, so every similar pair meets
under a shingle. Pairs that can't reach the similarity by their sizes, by what is left behind the shingle, or by sketches of a
bit for each shingle drop out, none of them a similar pair; the others are compared by their whole sets.

The order puts shingles that more than ``CROWD`` texts have behind all others, so that a text of which a fifth is its own
meets none of those with which it shares a passage, however many these are. What still meets under a common shingle makes no
pair of each two: rounds link the texts of a shingle to one of them first, as long as more pairs than ``ROWS`` times the rows
are left and a round halves them, and only texts that are still in different components are paired then. The texts of a pair's side with thousands of
partners are dealt out in parts, each with a copy of the text that they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import BOOL, LONG, Members, as_bytes, checkpointed, fresh, held_bits, join_hot, small_batches, struct, turn
from .components import connected_components
from .files import new_folder, stored

SHINGLE = 5
PERCENT = 80
#: Rounds in which the texts of a shingle are linked to one of them, before those that are left are paired.
STARS = 1
#: Rounds of that kind there are besides, at most, and pairs for each row up to which there is no need of one.
MORE, ROWS = 6, 1
#: Shingles counted at once, texts from which one is a common one, and how many are told apart by their counts; of others
#: tasks hold a bit set. The order decides how many pairs are compared, never which are found.
CHUNK, CROWD, COMMON = 1 << 19, 8, 1 << 17
#: Bits of the bucket in which a shingle is counted.
BUCKETS = 11
#: Rows of an Arrow batch here: a pair holds two whole texts. And pairs of one text that a task gets.
PAIR_ROWS, PARTNERS = 100, 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Digests of the distinct word shingles of a text, in order.

    A-Z are lower-cased and words split at ASCII white space. A text of fewer words than a shingle is one shingle; all
    texts without words have the same one.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    digests = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ digests[i : i + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketch(values: np.ndarray) -> bytes:
    """The size of a set, and a bit for each of some four times as many buckets: whether an odd number of its members fall there."""
    buckets = 1 << max(6, min(17, (len(values) - 1).bit_length() + 2))
    odd = np.bincount((values & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return len(values).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """False only for sketches of sets that are not similar: where bits differ, so do members."""
    x, y = (int.from_bytes(s[8:], "little") for s in (a, b))
    bits, least = [8 * len(a) - 64, 8 * len(b) - 64], min(len(a), len(b)) * 8 - 64
    for k, v in enumerate((x, y)):
        while bits[k] > least:  # the buckets of the half as many are pairs of these
            bits[k] //= 2
            v = (v >> bits[k]) ^ (v & ((1 << bits[k]) - 1))
        x, y = (v, y) if k == 0 else (x, v)
    low, high = sorted(int.from_bytes(s[:8], "little") for s in (a, b))
    return 100 * low >= percent * high and (100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (low + high)


def parities(values: np.ndarray) -> np.ndarray:
    """A sketch of 256 buckets for sets of any size, as four longs: short enough to go with every row that is joined."""
    odd = np.bincount((values & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(values: np.ndarray, common: np.ndarray, counts: np.ndarray, crowded: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """The shingles of which every similar set shares one, in the common order. crowded: a bit set of all common ones."""
    n = len(values)
    rank = np.zeros(n, np.int64) if crowded is None else held_bits(crowded, values.view(np.int64)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        rank = np.where(common[at] == values, counts[at], rank)
    return values[np.lexsort((values, rank))[: n + -percent * n // 100 + 1]]


def _dealt(found: Callable[[pa.Array], list[np.ndarray]]):
    """Rows to (bucket, keys, counts): how often what ``found`` makes of the first column occurs, ``CHUNK`` values at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("count")
        held: list[np.ndarray] = []

        def seen() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            of = (keys >> np.uint64(64 - BUCKETS)).astype(np.int64)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            sides = ((keys, 8), (n.astype(np.uint32), 4))
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(first, len(keys)) * width).astype(np.int32)), pa.py_buffer(x)]) for x, width in sides]
            return pa.RecordBatch.from_arrays([pa.array(of[first]), *packed], names=["bucket", "keys", "counts"])

        size = 0
        for batch in batches:
            for values in found(batch.column(0)):
                held.append(values)
                size += len(values)
                if size >= CHUNK:
                    yield seen()
                    size = 0
        if size:
            yield seen()

    return run


def _added(least: int):
    """Rows of ``_dealt``, sorted by bucket, to (key, n) of all keys that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            keys, n = (np.frombuffer(b"".join(x for r in rows for x in r.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.uint32)))
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.add.reduceat(n, first)
            keys, n = keys[first][n >= least], n[n >= least]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        turn("add")
        held, at = [], None
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s and of[s] != at:
                    if held:
                        yield total(held)
                    held, at = [], of[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield total(held)

    return run


def _counts(rows: DataFrame, found: Callable[[pa.Array], list[np.ndarray]], least: int) -> DataFrame:
    """(key, n), a written table, of the values that ``found`` makes of the only column and that occur ``least`` times or more.

    Values travel packed, a row for a bucket of a chunk, so that neither side of the shuffle holds a row or a hash entry for
    each. A task adds up one bucket at a time.
    """
    dealt = rows.mapInArrow(_dealt(found), "bucket long, keys binary, counts binary")
    return stored(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added(least), "key long, n long"))


def _lists(values: pa.Array) -> list[np.ndarray]:
    """The lists of a column of long values, as one array."""
    return [values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]


def _common(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``COMMON`` most common shingles, sorted, how many texts have each, and a bit set of all that ``CROWD`` texts have."""
    found = _counts(docs.select(text_col), lambda texts: [shingles(t, shingle) for t in as_bytes(texts)], CROWD + 1)
    rows = found.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    values, counts = rows.column("key").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order], Members(found, "key").array()


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """At most ``PAIR_ROWS`` rows in a batch while it lasts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), PAIR_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _heads(docs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(mark, n, odd, prefix, sketch) of every different text, as a written table; only texts that occur twice are shuffled.

    odd: ``parities``."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_common(docs, text_col, shingle))
    shape = pa.struct([("n", pa.int64()), ("odd", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def look(texts: pa.Array) -> pa.Array:
        turn("heads")
        rows = []
        for text in as_bytes(texts):
            values = shingles(text, shingle)
            rows.append({"n": len(values), "odd": parities(values), "prefix": prefix(values, *order.value, percent).view(np.int64), "sketch": sketch(values)})
        return pa.array(rows, shape)

    head = F.arrow_udf(look, struct(n=LONG, odd=T.ArrayType(LONG), prefix=T.ArrayType(LONG), sketch=T.BinaryType()))
    folder = new_folder(spark, "heads")
    docs.select(_mark(text_col).alias("mark"), head(text_col).alias("h")).select("mark", "h.*").write.parquet(folder)
    heads = spark.read.parquet(folder)
    twice = Members(checkpointed(heads.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark")), "mark")
    return twice.those_out(heads, "mark").unionByName(twice.those_in(heads, "mark").dropDuplicates(["mark"]))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the texts a and b; a text with many pairs is dealt out in parts of ``PARTNERS`` or so."""
    total = pairs.count()
    sides = [(side, texts.withColumnsRenamed({"mark": side, "text": name})) for side, name in (("u", "a"), ("v", "b"))]
    if total <= 20 * PARTNERS:
        for side, named in sides:
            pairs = pairs.join(named, side)
        return pairs
    copies = []
    for (side, named), other in zip(sides, "vu"):
        counts = pairs.select(side).groupBy(side).agg(F.count("*").alias("__n"))
        parts, part = F.ceil(F.col("__n") / PARTNERS), f"__{side}"
        copies.append((named.join(counts, side).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__n"), [side, part]))
        pairs = checkpointed(join_hot(pairs, counts, [side], total, "__n").withColumn(part, F.pmod(F.xxhash64(other), parts)).drop("__n"))
    for copy, keys in copies:
        pairs = pairs.join(copy, keys)
    return pairs


def _verified(docs: DataFrame, pairs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of marks, a written table, whose texts are similar."""
    nodes = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("mark")).distinct())
    texts = docs.select(_mark(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # What the set lets through is joined exactly below, once for each side.
    texts = checkpointed(Members(nodes, "mark").those_in(texts, "mark").dropDuplicates(["mark"]))

    def look(a: pa.Array, b: pa.Array) -> pa.Array:
        turn("compare")
        sides = zip(as_bytes(a), as_bytes(b))
        return pa.array([similar(shingles(x, shingle), shingles(y, shingle), percent) for x, y in sides], pa.bool_())

    return _with_texts(pairs, texts).where(F.arrow_udf(look, BOOL)("a", "b")).select("u", "v")


def _likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs, a written table, whose sketches don't rule it out that they are similar."""
    nodes = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("mark")).distinct())
    sketches = Members(nodes, "mark").those_in(heads.select("mark", F.col("sketch").alias("text")), "mark")
    look = lambda a, b: pa.array([may_be_similar(x, y, percent) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())
    return checkpointed(_with_texts(pairs, sketches).where(F.arrow_udf(look, BOOL)("a", "b")).select("u", "v"))


def fingerprint_pairs(docs: DataFrame, text_col: str, shingle: int, radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs (u, v) of marks that fingerprints within the radius suggest: links of the BK-trees between one text of each
    fingerprint, and between that text and the others of the same fingerprint."""
    rows = checkpointed(docs.select(_mark(text_col).alias("mark"), simhash.fingerprints(text_col, shingle).alias("fp")).distinct())
    leads = checkpointed(rows.groupBy("fp").agg(F.min("mark").alias("lead"), F.count("*").alias("n")))
    links = simhash.near_links(leads, radius).distinct()
    u, v = (leads.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("u", "v"))
    links = links.join(u, "u").join(v, "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    equal = join_hot(rows, leads, ["fp"], rows.count()).where("mark <> lead").select(F.col("lead").alias("u"), F.col("mark").alias("v"))
    return links.unionByName(equal)


def _left(rows: DataFrame) -> int:
    """Pairs of rows (key, root) of equal key and different roots."""
    n, each = F.sum("c").cast("double"), F.sum(F.col("c").cast("double") * F.col("c"))
    held = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(((n * n - each) / 2).alias("pairs"))
    return int(held.agg(F.sum("pairs")).first()[0] or 0)


#: What a text brings along under each of its shingles.
_SIDE = ("mark", "n", "root", "at")


def similar_roots(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, stars: int = STARS) -> DataFrame | None:
    """(mark, root) of every text (by its xxhash64) that is similar to another one; None if there is none.

    Texts with the same root are those that links at ``percent`` of the union or more join.
    """
    links = roots = None

    def linked(pairs: DataFrame) -> None:
        nonlocal links, roots
        found = _verified(docs, pairs, text_col, shingle, percent)
        links = checkpointed(found if links is None else links.unionByName(found))
        roots = checkpointed(connected_components(links).select(F.col("node").alias("mark"), "root"))

    near = checkpointed(fingerprint_pairs(docs, text_col, shingle))
    heads = _heads(docs, text_col, shingle, percent)
    again = _counts(heads.select("prefix"), _lists, 2)
    # A key that the set lets through without need is in one component, and drops out below.
    meet = checkpointed(Members(again, "key").those_in(heads.select("mark", "n", F.posexplode("prefix").alias("at", "key")), "key"))
    total = meet.count()
    left = float("inf")
    for salt in range(stars + MORE + 1):
        rows = meet.withColumn("root", F.col("mark"))
        if roots is not None:
            rows = checkpointed(meet.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark")))
        lead = F.min(F.struct(F.xxhash64("mark", F.lit(salt)), *_SIDE)).alias("lead")
        mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead, F.count("*").alias("texts")).where("low <> high")
        mixed = checkpointed(mixed.select("key", "texts", *(F.col(f"lead.{c}").alias(f"{c}2") for c in _SIDE)))
        if near is None and mixed.isEmpty():
            break
        before, left = left, _left(rows) if stars <= salt < stars + MORE else left
        if star := salt < stars or salt < stars + MORE and ROWS * total < left <= before / 2:
            both = join_hot(rows, mixed, ["key"], total, "texts").where("root <> root2")
        else:
            rows = join_hot(rows, mixed.select("key", "texts"), ["key"], total, "texts").drop("texts")
            bits = [f"odd{i}" for i in range(4)]
            rows = checkpointed(rows.join(heads.select("mark", *(F.col("odd")[i].alias(c) for i, c in enumerate(bits))), "mark"))
            # As in ``may_be_similar``, before a pair is a row.
            alike = f"{100 + percent} * ({' + '.join(f'bit_count({c} ^ {c}2)' for c in bits)}) <= {100 - percent} * (n + n2)"
            both = rows.join(rows.select("key", *(F.col(c).alias(f"{c}2") for c in (*_SIDE, *bits))), "key").where(f"mark < mark2 AND root <> root2 AND {alike}")
        fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
        # What two sets share stands at or behind the first shingle that they share.
        reach = f"{100 + percent} * least(n - at, n2 - at2) >= {percent} * (n + n2)"
        both = both.where(f"{fits} AND {reach}").select("mark", "mark2")
        if near is not None:  # what the fingerprints suggest comes with the first round
            both, near = both.unionByName(near.select(F.col("u").alias("mark"), F.col("v").alias("mark2"))), None
        pairs = checkpointed(both.select(F.least("mark", "mark2").alias("u"), F.greatest("mark", "mark2").alias("v")).distinct())
        if not pairs.isEmpty() and not (pairs := _likely(pairs, heads, percent)).isEmpty():
            linked(pairs)
        if not star:
            break
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that with the component's smallest id (one, if repeated).

    Null and empty texts, and those of white space only, are similar to each other only. A null id is smaller than any
    other. Rows equal in id and text count once. Texts of any length are compared whole. An empty table stays empty, and
    other columns, whatever their names, stay as they are.
    """
    small_batches(docs.sparkSession)
    with _few_rows(docs.sparkSession):
        roots = similar_roots(docs, text_col, shingle, percent)
    own = docs.groupBy(_mark(text_col).alias("mark")).agg(F.min(F.struct(F.col(id_col).alias("id"))).alias("id"), F.count("*").alias("c"))
    own = own.withColumn("root", F.col("mark")) if roots is None else own.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    own = checkpointed(own)
    best = checkpointed(own.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("best"), F.sum("c").alias("c")).where("c > 1"))
    crowded = Members(checkpointed(own.join(best.select("root"), "root", "left_semi").select("mark")), "mark")
    mark, ids, of = (fresh(c, docs.columns) for c in ("mark", "best_id", "best_mark"))
    # Texts that the set lets through without need are the best of their own component as well.
    alone = own.join(best.select("root"), "root", "left_anti").select(F.struct("id", "mark").alias("best"))
    best = best.select("best").unionByName(crowded.those_in(alone.withColumn("mark", F.col("best.mark")), "mark").select("best"))
    best = best.select(F.col("best.id.id").alias(ids), F.col("best.mark").alias(of))
    marked = docs.withColumn(mark, _mark(text_col))
    held = crowded.those_in(marked, mark)
    held = held.join(best, (F.col(mark) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(ids)), "left_semi").dropDuplicates([id_col, mark])
    return crowded.those_out(marked, mark).unionByName(held).select(*docs.columns)
