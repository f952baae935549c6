"""Phrase collocation mining by hierarchical pair naming.

Texts are cut into words, in blocks of whole texts, as codes into the block's own words. Words that are frequent by the count
over all blocks get a global name. A level up, two neighbouring names make a pair; pairs are counted over all blocks, the
frequent ones get a global name, and every place of a block takes the name of the pair that starts there. Since a phrase of
k words is the pair of its first and its last k - 1 words, a name is a row with two parents, from which the counts of all
cuts and the phrases that hold it are looked up. Only what is frequent at one level is looked at in the next, which loses
nothing: a phrase is never more frequent than its parts.

A name is a digest of what it stands for (XXH64 of language and word, then of the two names of a pair), so that every task
can give it without a table of names. All that tasks get of a level is a bit set of the frequent names, of ``SHARED`` bytes
at most however many there are: what it lets through without need is counted and then dropped, as it isn't frequent. Each
level reads the texts again, and nothing but counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LONG, STRING, Members, as_bytes, held_bits, shuffle_width, small_batches, struct
from .files import new_folder

#: Bytes of texts in a block, unless a single text has more.
BLOCK_BYTES = 3 << 20
#: Bytes of the set of a level's frequent names that all tasks get, at most.
SHARED = 16 << 20
#: Different grams that a task counts before it hands them on.
HELD = 500_000
#: The language of texts without one.
UNKNOWN = "und"
#: What a cut's score is multiplied with before it is rounded down.
SCALE = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)  # 0 a word's byte, 1 between words, 2 between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2

_CODES = T.ArrayType(T.IntegerType())
WORDS = struct(block=LONG, codes=_CODES, grams=T.ArrayType(struct(lang=STRING, word=STRING, n=LONG)))
PAIRS = struct(block=LONG, codes=_CODES, grams=T.ArrayType(struct(left=LONG, right=LONG, n=LONG)))


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, the text that each is of, whether a word is the last of its piece) of texts, without a loop over words."""
    whole = np.frombuffer(b"".join(t + b"\n" for t in texts).translate(_LOWER), np.uint8)
    kind = _KIND[whole]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole[kind == 0])])
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    cuts = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    return words, of, np.append(cuts[1:] != cuts[:-1], True)[: len(starts)]


def _listed(block: int, codes: np.ndarray, grams: list[pa.Array], schema: T.StructType) -> pa.RecordBatch:
    """One row: a block, its codes, and a list of structs of the arrays."""
    names = [f.name for f in schema["grams"].dataType.elementType.fields]
    inner = pa.StructArray.from_arrays(grams, names=names)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(codes, pa.int32()), inner)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", "codes", "grams"])


def _word_block(block: int, langs: list[str], texts: list[bytes]) -> pa.RecordBatch:
    words, of, last = words_of(texts)
    coded = words.dictionary_encode()
    known = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([known[x] for x in langs], np.int64)[of] if len(of) else np.zeros(0, np.int64)
    size = max(1, len(coded.dictionary))
    key, codes, n = np.unique(lang * size + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    # A piece's end is a code of -1 of its own.
    out = np.full(len(codes) + int(last.sum()), -1, np.int32)
    out[np.arange(len(codes)) + np.cumsum(last) - last] = codes
    names = pa.array(list(known), pa.string())
    grams = [names.take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)).cast(pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
    return _listed(block, out, grams, WORDS)


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts, from batches of (language, text)."""
    block, langs, texts, size = (TaskContext.get().partitionId() + 1) << 32, [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            if size and size + len(text) > BLOCK_BYTES:
                yield _word_block(block, langs, texts)
                block, langs, texts, size = block + 1, [], [], 0
            langs.append(lang)
            texts.append(text)
            size += len(text)
    if texts:
        yield _word_block(block, langs, texts)


# XXH64 as Spark has it.
_SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(values: np.ndarray, seeds: np.ndarray | np.uint64) -> np.ndarray:
    x = seeds + _P5 + np.uint64(8) ^ _turned(values.view(np.uint64) * _P2, 31) * _P1
    x = _turned(x, 27) * _P1 + _P4
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def names_of(grams: pa.StructArray) -> np.ndarray:
    """The names of a block's grams, as ``xxhash64`` gives them for their columns but the count.

    Of a pair's name and one of its parts the other part follows, so that phrases of three words or more only get the
    same pair of names if two digests agree by chance.
    """
    if grams.type.get_field_index("word") < 0:
        left, right = (grams.field(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        return _mixed(right, _mixed(left, np.uint64(_SEED))).view(np.int64)
    seeds = {x: xxhash.xxh64_intdigest(x.encode(), _SEED) for x in grams.field("lang").unique().to_pylist()}
    found = map(xxhash.xxh64_intdigest, as_bytes(grams.field("word")), map(seeds.__getitem__, grams.field("lang").to_pylist()))
    return np.fromiter(found, np.uint64, len(grams)).view(np.int64)


def frequent_set(names: DataFrame) -> np.ndarray:
    """A bit set of the ids of a table, in words of 64 bits."""
    return Members(names.select("id"), "id", 8 * SHARED).array()


def _raised(block: pa.RecordBatch | None, levels: list[np.ndarray]) -> pa.RecordBatch | None:
    """A block of words, some levels up."""
    for members in levels:
        if block is not None:
            names = names_of(block.column(2)[0].values)
            block = pair_block(block.column(0)[0].as_py(), block.column(1)[0].values.to_numpy(zero_copy_only=False), names, held_bits(members, names))
    return block


def text_counts(docs: DataFrame, levels: list[np.ndarray]) -> DataFrame:
    """(keys, n) of the words by language of (language, text), or of the pairs of names at the level after ``levels`` (its
    frequent names), added up in each task as far as ``HELD`` allows."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = (PAIRS if levels else WORDS)["grams"].dataType.elementType
    keys = schema.names[:-1]

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).select([*keys, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for block in _text_blocks(batches):
            block = _raised(block, shared.value)
            if block is None:
                continue
            held.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(block.column(2)[0].values)]))
            if sum(len(t) for t in held) > HELD:
                held = [added(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(50_000)
        if held:
            yield from added(held).to_batches(50_000)

    return docs.mapInArrow(run, schema)


def pair_block(block: int, codes: np.ndarray, names: np.ndarray, known: np.ndarray | None = None) -> pa.RecordBatch | None:
    """The pairs of neighbours that both have a name; None if there are none. names: by code; known: whether a code has
    one (else: -1 is none)."""
    if len(codes) < 2:
        return None
    named = (codes >= 0) & (names >= 0 if known is None else known)[codes]
    at = np.flatnonzero(named[:-1] & named[1:])
    if not len(at):
        return None
    size = len(names)
    key, pairs, n = np.unique(codes[at].astype(np.int64) * size + codes[at + 1], return_inverse=True, return_counts=True)
    # Places without a pair only matter where they part two pairs: one -1 for any number of them.
    gap = np.append(False, np.diff(at) > 1)
    out = np.full(len(at) + int(gap.sum()), -1, np.int32)
    out[np.arange(len(at)) + np.cumsum(gap)] = pairs
    return _listed(block, out, [pa.array(names[key // size]), pa.array(names[key % size]), pa.array(n, pa.int64())], PAIRS)


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact, in 38 digits."""
    big = T.DecimalType(38, 0)
    top, below = F.lit(SCALE).cast(big) * a.cast(big) * a.cast(big), left.cast(big) * right.cast(big)
    return F.floor((top - F.pmod(top, below)) / below).cast("long")


def _first(rows: DataFrame, keys: str, order: list[Column], limit: int, rank: str) -> DataFrame:
    """The first ``limit`` rows of each key with their rank from 1; first those of shares of a key, then those of the key."""
    share = F.pmod(F.xxhash64("id", "k"), F.lit(shuffle_width(rows.sparkSession)))
    for by in (Window.partitionBy(keys, share), Window.partitionBy(keys)):
        rows = rows.withColumn(rank, F.row_number().over(by.orderBy(*order)).cast("long")).where(F.col(rank) <= limit)
    return rows


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, limit: int = 2000, subsumed: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``limit`` phrases of 2 to ``max_words`` words.

    Words are what white space (space and tab) parts within pieces, and pieces what the marks .,;:!? and line ends part; A
    to Z are lower-cased. a counts a phrase's occurrences, l and r those of the two parts of its weakest cut, n all words
    of the language; score is the weakest cut's SCALE * a * a / (l * r), rounded down, of equal ones that of the shorter
    first part. Phrases below ``min_count`` are left out, and those that lie in a longer one which has ``subsumed`` percent
    of their occurrences or more. Order: score, a (falling), then the phrase by its bytes.

    Null and empty texts have no words, texts of any length are one piece of work each, repeated rows count each time, and
    a null language is ``UNKNOWN``. Other columns are not read. An empty table gives an empty result.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more, and are counted once at least")
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "phrases")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    keys, levels, shared, grams = ["lang", "word"], [], [], None
    for k in range(1, max_words + 1):
        counts = text_counts(docs, shared).groupBy(*keys).agg(F.sum("n").alias("f"))
        if k == 1:
            counts = written(counts, "words")
            totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        names = written(counts.where(F.col("f") >= min_count).select(F.xxhash64(*keys).alias("id"), *keys, "f"), f"names-{k}")
        if k == 1:
            grams = names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
        else:
            grams = written(_with_parents(names, grams), f"grams-{k}")
            levels.append(grams)
        if k < max_words:
            shared.append(frequent_set(names))
        keys = ["left", "right"]
    kept = [_kept(rows, levels[i + 1] if i + 1 < len(levels) else None, subsumed).select("lang", "id", F.lit(i).alias("k"), *_CUT) for i, rows in enumerate(levels)]
    every = kept[0]
    for rows in kept[1:]:
        every = every.unionByName(rows)
    best = _first(every, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], limit, "rank")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _with_parents(names: DataFrame, grams: DataFrame) -> DataFrame:
    """Named pairs with their phrase, and with the counts of their first and their last 1, 2, ... words."""
    for side, columns in (("left", ("lang", "phrase", "heads")), ("right", ("last", "tails"))):
        names = names.join(grams.select(F.col("id").alias(side), *(F.col(c).alias(f"__{c}") for c in columns)), side)
    phrase = F.concat_ws(" ", "__phrase", "__last")
    sums = [F.concat(f"__{c}", F.array("f")).alias(c) for c in ("heads", "tails")]
    return names.select("id", "left", "right", F.col("__lang").alias("lang"), phrase.alias("phrase"), F.col("__last").alias("last"), "f", *sums)


_CUT = ("phrase", "a", "l", "r", "score")


def _kept(grams: DataFrame, longer: DataFrame | None, subsumed: int) -> DataFrame:
    """A level's phrases with their weakest cut, without those that the phrases a word longer stand for.

    Phrases longer by more words hold one longer by one word that has as many occurrences, so these need no look.
    """
    if longer is not None:
        sides = longer.select(F.col("left").alias("id"), F.col("f").alias("__more")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("__more")))
        grams = grams.join(sides.groupBy("id").agg(F.max("__more").alias("__more")), "id", "left")
        grams = grams.where(F.col("__more").isNull() | (F.lit(100).cast("long") * F.col("__more") < F.lit(subsumed).cast("long") * F.col("f")))
    size = F.size("heads")

    def cut(j: Column) -> Column:
        l, r = F.get("heads", j - 1), F.get("tails", size - j - 1)
        return F.struct(scored(F.col("f"), l, r).alias("score"), j.alias("j"), l.alias("l"), r.alias("r"))

    weakest = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    return grams.withColumn("__cut", weakest).select("lang", "id", "phrase", F.col("f").alias("a"), "__cut.l", "__cut.r", "__cut.score")
