"""Removal of every repeated 200-byte string, by prefix-free parsing.

Parsing. A rolling hash over 64 bytes picks triggers: of the 137 places where 64 bytes fit into a 200-byte string, the
one with the smallest hash (the last of equals). A string thus has one trigger, the same wherever it occurs, and every
string with that trigger lies in the trigger's phrase, the text from 136 bytes before it to 200 bytes after its start.

Dictionary. Phrases are counted over the corpus by (trigger, phrase) digests. A phrase that occurs twice is repeated as
a whole. A trigger that occurs once holds no repeat. What remains are the triggers whose phrases differ: only there the
bytes are needed.

Corpus order. Those phrases, one of each kind, are brought together by trigger, many triggers to a batch. The batch is
parsed again with a short window, the distinct pieces form its dictionary, and the suffix order of the dictionary and
that of the parse combine into the suffix order of the batch: a suffix is ranked by the dictionary suffix it starts with
and then by the rank of the parse behind it. Neighbours in this order that agree on 200 bytes, compared byte by byte,
are repeats. For near copies the dictionary is far smaller than the text.

A trigger with more kinds of phrases than fit a batch is counted string by string instead, each string a row, so that no
task gathers it.

Matches never cross texts. Rows equal in id and text count as separate occurrences. Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FORGET, LONG, STRING, as_bytes, fresh, small_batches, turn
from .files import new_folder

LENGTH = 200
TRIGGER = 64
#: Kinds of phrases of one trigger that a task orders at most, and bytes of a batch.
KINDS = 8192
BATCH = 1 << 19
_PIECE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd number serves as the base of the rolling hash


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _up_down(limit: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(_ODD), limit + 1), _powers(_inverse(int(_ODD)), limit + 1)


#: Places for which powers are made once; longer arrays get their own.
_KNOWN = 1 << 20
_known = lru_cache(1)(lambda: _up_down(_KNOWN))


class Rolling:
    """Polynomial hashes of all windows of a byte array, modulo 2^64 and mixed."""

    def __init__(self, window: int, limit: int):
        self.window = window
        self.up, self.down = _known() if limit <= _KNOWN else _up_down(limit)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=total[1:])
        h = (total[self.window :] - total[: -self.window]) * self.up[: len(data) - self.window + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every run of ``width``, the last of equals."""
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    v = (h & ~low) | (low - at)
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    return (low - (v & low)).astype(np.int64)


_ROLLING: dict[int, Rolling] = {}


def _forget() -> None:
    _ROLLING.clear()
    _known.cache_clear()


FORGET["repeats"] = _forget


def _rolling(window: int) -> Rolling:
    return _ROLLING.setdefault(window, Rolling(window, _PIECE + LENGTH))


def triggers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, at): the triggers of all texts, ascending; a text shorter than 200 bytes has none."""
    places, roll = LENGTH - TRIGGER + 1, _rolling(TRIGGER)
    of, at, held, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0

    def look(data: np.ndarray, room: np.ndarray | None) -> np.ndarray:
        low = _lowest(roll(data), places)
        if room is not None:
            low = low[room[: len(low)] >= LENGTH]
        return low[np.flatnonzero(np.diff(low, prepend=-1))]

    def flush() -> None:
        sizes = np.array([len(texts[i]) for i in held])
        data = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
        ends = np.cumsum(sizes)
        found = look(data, np.repeat(ends, sizes) - np.arange(len(data)))
        which = np.searchsorted(ends, found, side="right")
        of.append(np.array(held)[which])
        at.append(found - (ends - sizes)[which])

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > _PIECE:
            if held:
                flush()
                held, size = [], 0
            whole = np.frombuffer(text, np.uint8)
            found = [look(whole[k : k + _PIECE + LENGTH - 1], None) + k for k in range(0, len(text) - LENGTH + 1, _PIECE)]
            one = np.unique(np.concatenate(found))
            of.append(np.full(len(one), i))
            at.append(one)
            continue
        if size + len(text) > _PIECE:
            flush()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        flush()
    return np.concatenate(of), np.concatenate(at)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to a row for each trigger; equal phrases in a row, as in periodic text, are one row."""
    turn("parse")
    digest, before = xxhash.xxh3_64_intdigest, LENGTH - TRIGGER
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        of, at = triggers(texts)
        keys, phrases = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for k, (i, a) in enumerate(zip(of.tolist(), at.tolist())):
            data, left = texts[i], max(0, a - before)
            keys[k] = digest(data[a : a + TRIGGER])
            phrases[k] = digest(data[left : a + LENGTH], a - left)
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]) | (phrases[1:] != phrases[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        row = pa.array(of[first])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(row), batch.column("mark").take(row), signed(keys[first]), signed(phrases[first]), pa.array(at[first]), pa.array(at[last] if len(first) else at), pa.array(last - first + 1)],
            names=["id", "mark", "key", "phrase", "first", "last", "n"],
        )


def _ranks(keys: np.ndarray, left: np.ndarray, h: int) -> np.ndarray:
    """How many of the sequences that start at each place are smaller than it, by prefix doubling; equal ones are alike.

    keys: in the order of the first ``h`` symbols, or of all if fewer are left; what ends first is the smaller. left: the
    symbols of each. Only what a round has not told apart is looked at in the next.
    """
    rank = np.zeros(len(keys), np.int64)
    live = np.argsort(keys)
    key, old = keys[live], rank
    while len(live):
        at, new, whole = np.arange(len(live)), np.ones(len(live), bool), np.ones(len(live), bool)
        new[1:], whole[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        old = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
        rank[live] = old
        again = ~(new & np.append(new[1:], True)) & (left[live] >= h)
        live, old = live[again], old[again]
        behind, more = np.zeros(len(live), np.int64), left[live] > h
        behind[more] = rank[live[more] + h] + 1
        key = old * (len(rank) + 2) + behind
        order = np.argsort(key)
        live, key, old = live[order], key[order], old[order]
        h *= 2
    return rank


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix of a sequence, from 1; a suffix that ends first is the smaller."""
    return _ranks(symbols, np.arange(len(symbols), 0, -1), 1) + 1


def corpus_order(texts: list[bytes], window: int = 8, modulus: int = 16, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(data, order): the texts put together, and its places in the order of the suffixes, each up to its text's end.

    places: only these are put in order.

    A piece ends with a trigger window, or with its text, and takes along the last ``window - 1`` bytes of the piece
    before it. A place belongs to the piece whose closing trigger is the first that starts at the place or later, so
    that equal strings fall into equal pieces and no dictionary suffix is a prefix of another (but at a text's end).
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return data, np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts if t])
    ends = np.cumsum(sizes)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) >= window:
        cut[np.flatnonzero(Rolling(window, len(data))(data) % np.uint64(modulus) == 0) + window] = True
    for k in range(1, window):  # windows that reach back into the text before
        back = ends[:-1] + k
        cut[back[back < len(data)]] = False
    cut[ends] = True
    cuts = np.flatnonzero(cut)
    last = np.isin(cuts, ends)
    begins = np.maximum(np.append(0, cuts[:-1] - window + 1), (ends - sizes)[np.searchsorted(ends, cuts)])
    raw, known, parse = data.tobytes(), {}, np.empty(len(cuts), np.int64)
    for i, (s, e) in enumerate(zip(begins.tolist(), cuts.tolist())):
        parse[i] = known.setdefault(raw[s:e], len(known))
    # Suffixes of the dictionary.
    size = np.array([len(p) for p in known])
    first = np.cumsum(size) - size
    rank = _piece_ranks(b"".join(known), np.cumsum(size), first)
    # Suffixes of the parse, with a smallest symbol behind every text.
    slot = np.arange(len(cuts)) + np.cumsum(last) - last
    symbols = np.zeros(len(cuts) + len(ends), np.int64)
    symbols[slot] = rank[first][parse] + 1
    follow = suffix_ranks(symbols)[slot + 1]
    here = np.arange(len(data)) if places is None else places
    piece = np.minimum(np.searchsorted(cuts, here + window), np.flatnonzero(last)[np.searchsorted(ends, here, side="right")])
    start = rank[first[parse[piece]] + here - begins[piece]]
    return data, here[np.argsort(start * (len(follow) + len(symbols) + 1) + follow[piece])]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number, in byte order; zeros behind the end."""
    return sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8).copy().view(">u8").ravel().astype(np.uint64)


def _piece_ranks(data: bytes, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of pieces put together, each up to its piece's end; equal strings have equal ranks."""
    left = np.repeat(ends, ends - begins) - np.arange(len(data))
    words = _words(np.frombuffer(data, np.uint8))
    # Seven bytes, zeros behind the end, and how many they are, as zero bytes in a text look like the end.
    short = left < 7
    words[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left[short].astype(np.uint64))
    words = words & ~np.uint64(255) | np.minimum(left, 7).astype(np.uint64)
    return _ranks(words, left, 7)


def _repeats(texts: list[bytes], at: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place), ascending: the places that start a string of ``length`` which occurs again, in it or in another.

    at: where the trigger stands in each phrase; only strings with that trigger are looked at, so that each place of the
    corpus is looked at once. counts: the occurrences of each phrase.
    """
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    whole = np.frombuffer(b"".join(texts), np.uint8)
    low = _lowest(Rolling(TRIGGER, len(whole))(whole), LENGTH - TRIGGER + 1)
    places = np.flatnonzero(low == np.repeat(begin + at, sizes)[: len(low)])
    places = places[places + LENGTH <= np.repeat(begin + sizes, sizes)[places]]
    if not len(places):
        return places, places
    # Only what these strings cover is put in order.
    bounds = np.searchsorted(places, np.append(begin, len(whole)))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    left, right = places[bounds[some]], places[bounds[some + 1] - 1] + length
    first = np.cumsum(right - left) - (right - left)
    shift, raw = left - first, whole.tobytes()
    within = places - np.repeat(shift, np.diff(bounds)[some])
    data, order = corpus_order([raw[a:b] for a, b in zip(left.tolist(), right.tolist())], places=within)
    words = _words(data)
    alike = np.arange(1, len(order))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alike = alike[words[order[alike] + k] == words[order[alike - 1] + k]]
    new = np.ones(len(order), bool)
    new[alike] = False
    group = np.cumsum(new) - 1
    of = np.repeat(some, right - left)
    total = np.bincount(group, weights=counts[of[order]])
    hit = np.sort(order[total[group] > 1])
    which = of[hit]
    return which, hit + np.repeat(shift, right - left)[hit] - begin[which]


def _with_trigger(phrase: bytes, at: int) -> np.ndarray:
    """Starts of the phrase's 200-byte strings whose trigger stands at ``at``."""
    low = _lowest(_rolling(TRIGGER)(np.frombuffer(phrase, np.uint8)), LENGTH - TRIGGER + 1)
    return np.flatnonzero(low == at)


def _order_batch(rows: pa.Table) -> pa.RecordBatch:
    """Phrases of whole triggers to the spans (id, mark, spans) that repeat: maximal runs that repeated strings cover."""
    texts, counts = as_bytes(rows.column("bytes").combine_chunks()), rows.column("n").to_numpy()
    which, starts = _repeats(texts, rows.column("at").to_numpy(), counts)
    once = counts[which] == 1  # phrases that occur twice are spans already
    which, starts = which[once], starts[once]
    starts = starts + rows.column("left").to_numpy()[which]
    other = np.append(True, which[1:] != which[:-1])[: len(which)]
    first = np.flatnonzero(other | (np.diff(starts, prepend=starts[:1]) > LENGTH))
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    spans = pa.StructArray.from_arrays([pa.array(starts[first]), pa.array(starts[last] + LENGTH)], names=["start", "end"])
    at = np.flatnonzero(other[first])
    ids, marks = (rows.column(c).combine_chunks().take(pa.array(which[first[at]])) for c in ("id", "mark"))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([ids, marks, lists], names=["id", "mark", "spans"])


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trigger, cut into batches of whole triggers."""
    turn("order")
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            keys = batch.column("key").to_numpy()
            grown = size + np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64))
            full = np.flatnonzero((grown > BATCH)[:-1] & (keys[1:] != keys[:-1]))
            if held and size > BATCH and held[-1].column("key")[-1].as_py() != keys[0]:
                yield _order_batch(pa.Table.from_batches(held))
                held, size = [], 0
                continue
            if not len(full):
                held.append(batch)
                size = int(grown[-1])
                break
            cut = int(full[0]) + 1
            yield _order_batch(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, size, batch = [], 0, batch.slice(cut)
    if held:
        yield _order_batch(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of very common triggers to a row for each 200-byte string, under a 128-bit digest."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        of, starts, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for i, (data, at) in enumerate(zip(as_bytes(batch.column("bytes")), batch.column("at").to_pylist())):
            own = _with_trigger(data, at)
            of.append(np.full(len(own), i))
            starts.append(own)
            digests += [digest(data[o : o + LENGTH]) for o in own.tolist()]
        row, start = pa.array(np.concatenate(of)), np.concatenate(starts)
        start = start + batch.column("left").to_numpy()[row.to_numpy()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(row), batch.column("mark").take(row), pa.array(start), pa.array(digests, pa.binary()), batch.column("n").take(row)],
            names=["id", "mark", "start", "digest", "n"],
        )


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([pack.compress(b) for b in as_bytes(texts)], pa.binary())


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they are: no column is pruned below, so that all that is made of them shares one shuffle."""
    yield from batches


def _cut_out(batches: Iterator[pa.RecordBatch], kinds: int, above: bool = False) -> Iterator[pa.RecordBatch]:
    """Texts and the triggers whose bytes are wanted, to those phrases; of triggers with up to ``kinds`` kinds, or of those above."""
    turn("cut")
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        cols: dict[str, list] = {c: [] for c in ("row", "key", "kinds", "n", "left", "at", "bytes")}
        *_, ids, marks, packs, wants = batch.columns
        for i, (packed, wanted) in enumerate(zip(packs.to_pylist(), wants.to_pylist())):
            wanted = [w for w in wanted or [] if (w["kinds"] > kinds) == above]
            if not wanted:
                continue
            data = unpack.decompress(packed)
            for w in wanted:
                left = max(0, w["first"] - (LENGTH - TRIGGER))
                for c, x in zip(cols, (i, w["key"], w["kinds"], w["n"], left, w["first"] - left, data[left : w["first"] + LENGTH])):
                    cols[c].append(x)
        row = pa.array(cols["row"], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(row), marks.take(row), *(pa.array(cols[c], pa.int64()) for c in ("key", "kinds", "n", "left", "at")), pa.array(cols["bytes"], pa.binary())],
            names=["id", "mark", "key", "kinds", "n", "left", "at", "bytes"],
        )


def _unpacked(packed: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return map(unpack.decompress, packed.to_pylist())


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)]))


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Spans that overlap or touch made one, and cut at ``size``."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], min(size, x["end"])) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _mark(text_col: str) -> Column:
    """A text's hash: with the id it names a row; rows equal in both are cut alike."""
    return F.xxhash64(text_col)


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` and, last, the id, the mark and the compressed text in columns with names of their own."""
    names = [fresh(c, docs.columns) for c in ("dedup_id", "dedup_mark", "dedup_packed")]
    new = dict(zip(names, (F.col(id_col), _mark(text_col), _packed(F.col(text_col)))))
    return docs.select(*(c for c in docs.columns if c != text_col), *(e.alias(n) for n, e in new.items())), names


def _left(rows: DataFrame, names: list[str], more: DataFrame, value: str) -> tuple[DataFrame, str]:
    """(all rows of ``packed_rows`` with a value for their id and mark, the value's column).

    Always by a shuffle: where few values are broadcast instead, a task packs texts and unpacks them again, in two Python
    workers at once, and workers stay for the session.
    """
    of, own, held = (fresh(c, rows.columns) for c in ("cut_id", "cut_mark", "cut_value"))
    more = more.select(F.col("id").alias(of), F.col("mark").alias(own), F.col(value).alias(held))
    return rows.join(more.hint("merge"), F.col(names[0]).eqNullSafe(F.col(of)) & (F.col(names[1]) == F.col(own)), "left").drop(of, own), held


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: int = KINDS, packed: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """(id, mark, spans): byte spans, perhaps overlapping, that repeated 200-byte strings cover in each text with any.

    A span may end behind its text's end; what applies spans cuts it there. packed: what ``packed_rows`` gave, if the
    caller uses it as well; the texts are then shuffled once for both.
    """
    small_batches(docs.sparkSession)
    held, names = packed or packed_rows(docs, id_col, text_col)
    src = docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    long = src.where(F.octet_length("text") >= LENGTH)
    rows = long.mapInArrow(_parse, f"id {kind}, mark long, key long, phrase long, first long, last long, n long")
    known = rows.groupBy("key", "phrase").agg(F.sum("n").alias("n"), F.min(F.struct("id", "mark", "first")).alias("one"))
    known = known.mapInArrow(_same, f"key long, phrase long, n long, one struct<id:{kind},mark:long,first:long>")
    every = known.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    # What occurs twice, or has a trigger that does, is kept: most of a text is in no such phrase.
    folder = new_folder(docs.sparkSession, "phrases")
    known.join(every, "key").drop("total").write.parquet(folder)
    known = docs.sparkSession.read.parquet(folder)
    # Phrases that occur twice: whole.
    twice = known.where("n > 1").select("key", "phrase")
    whole = rows.join(twice, ["key", "phrase"]).select(
        "id", "mark", F.greatest(F.lit(0), F.col("first") - (LENGTH - TRIGGER)).alias("start"), (F.col("last") + LENGTH).alias("end")
    )
    whole = whole.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # Triggers with several kinds of phrases: one of each kind, with its bytes.
    several = known.where("kinds > 1").select("one.id", "one.mark", F.struct("key", "kinds", "n", "one.first").alias("w"))
    wanted = several.groupBy("id", "mark").agg(F.collect_list("w").alias("wanted"))
    shape = f"id {kind}, mark long, key long, kinds long, n long, left long, at long, bytes binary"
    texts = _left(held, names, wanted, "wanted")[0]
    ordered = texts.mapInArrow(lambda rows: _cut_out(rows, kinds), shape).repartition("key").sortWithinPartitions("key")
    ordered = ordered.mapInArrow(_order, f"id {kind}, mark long, spans array<struct<start:long,end:long>>")
    # In one step: two would take two Python workers for each task, and workers stay.
    strings = texts.mapInArrow(lambda rows: _strings(_cut_out(rows, kinds, True)), f"id {kind}, mark long, start long, digest binary, n long")
    common = strings.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1")
    common = strings.join(common, "digest").select("id", "mark", F.array(F.struct("start", (F.col("start") + LENGTH).alias("end"))).alias("spans"))
    found = whole.unionByName(ordered).unionByName(common)
    return found.groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut_texts(packed: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Every text and its merged spans."""
    for data, found in zip(_unpacked(packed), spans.to_pylist()):
        yield data, merged(found, len(data))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """(rows, packed, cuts): ``docs`` with the text compressed in the column ``packed``, and the byte spans that repeat in
    the column ``cuts`` (null: none).

    What reads all columns of ``rows`` shares the shuffle that the spans were found with.
    """
    packed = packed_rows(docs, id_col, text_col)
    rows, names = packed
    found, cuts = _left(rows, names, repeat_spans(docs, id_col, text_col, packed=packed), "spans")
    return found, names[2], cuts


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row: what removal of all repeated strings leaves.

    A null text is read as an empty one; texts below 200 bytes lose nothing. Rows equal in id and text count as separate
    occurrences and are cut alike; null ids are an id. Texts of any length are read whole. Other columns are not read, and
    an empty table gives an empty result.
    """
    rows, packed, cuts = with_spans(docs.select(id_col, text_col), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, gone in _cut_texts(batch.column(packed), batch.column(cuts)):
                found.append((len(data), sum(e - s for s, e in gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest()))
            cols = list(zip(*found)) or [[], [], [], []]
            arrays = [batch.column(id_col), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    counts = [T.StructField(c, LONG) for c in ("n_bytes", "n_removed", "n_spans")]
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *counts, T.StructField("kept_sha256", STRING)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without the bytes that repeated strings cover; every row stays, perhaps with an empty text.

    Matches are of bytes, so a cut may fall inside a character: what is left of such a character is removed as well. A
    null text becomes empty. ``n_chars``, if ``docs`` has that column, is counted anew.
    """
    rows, packed, cuts = with_spans(docs, id_col, text_col)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(data, gone).decode("utf-8", "ignore") for data, gone in _cut_texts(batch.column(packed), batch.column(cuts))]
            new = {text_col: pa.array(texts, pa.string())}
            if n_chars in columns:
                new[n_chars] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.column(n_chars).type)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
