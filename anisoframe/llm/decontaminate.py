"""Benchmark decontamination by FM-indexes over shards of the corpus.

Words of the benchmark are numbered; a batch of documents becomes a sequence of those numbers, cut at every other word
and at document ends. Only runs as long as the shortest window can hold one, so the shard's index is built over these.
Its suffixes are sorted, the Burrows-Wheeler transform is stored as a wavelet tree, and all windows are searched
backwards at once, a rank query for each word and end of the range. Occurrences are located by walking back to sampled
suffix positions, marked on the words, and merged to spans.

A benchmark beyond ``BLOCK`` bytes is searched in blocks, one after the other over the same rows: what goes to the tasks
has a bound, and no rows are shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, as_bytes, checkpointed, fresh, small_batches, struct, turn
from .suffix_dedup import suffix_ranks

WINDOW = 13
#: Bytes of benchmark text that are searched at once.
BLOCK = 8 << 20
SAMPLE = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and characters beyond ASCII."""
    return text.translate(_LOWER).split()


class WaveletTree:
    """Ranks in a sequence of numbers, a level of bits for each binary digit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros(len(end), np.int64)
        end = end.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            start = np.where(one, zeros + before[start], start - before[start])
            end = np.where(one, zeros + before[end], end - before[end])
        return end - start


class FMIndex:
    """Index over word numbers from 1; 0 separates and is never searched for."""

    def __init__(self, words: np.ndarray, top: int, sample: int = SAMPLE):
        gap = words == 0
        unlike = np.where(gap, np.cumsum(gap), words + int(gap.sum()) + 1)  # separators differ, so that suffixes end there
        order = np.empty(len(words), np.int64)
        order[suffix_ranks(unlike) - 1] = np.arange(len(words))
        self.bwt = words[order - 1]
        self.tree = WaveletTree(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=top + 1))])
        self.sampled = (order % sample == 0) | gap[order - 1] | (order == 0)
        self.slot = np.cumsum(self.sampled) - 1  # of a sampled row among their positions
        self.position = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows of the patterns, one in each row of an array; backwards, a word of all patterns at a time."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            word = patterns[live, lengths[live] - 1 - step]
            low[live] = self.before[word] + self.tree.rank(word, low[live])
            high[live] = self.before[word] + self.tree.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the rows, by walking back to sampled ones."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            word = self.bwt[rows[walk]]
            rows[walk] = self.before[word] + self.tree.rank(word, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.position[self.slot[rows]] + steps


class Windows:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found[tuple(ids[i : i + window])].add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.array([(*w, *(0,) * (window - len(w))) for w in found], np.int64).reshape(-1, window)

    def mark(self, shard: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For every document of the shard the words that are hit, and the items that hit it."""
        sizes = np.array([len(w) for w in shard], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        get = self.numbers.get
        for b, n, words in zip(begin.tolist(), sizes.tolist(), shard):
            ids[b : b + n] = np.fromiter(map(get, words, repeat(0)), np.int64, n)
        edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        items: list[set[str]] = [set() for _ in shard]
        hit = np.zeros(len(ids) + 1, np.int64)
        if len(self.lengths):
            long = end - start >= self.lengths.min()
            start, end = start[long], end[long]
        if len(self.lengths) and len(start):
            size = end - start + 1  # each run, then a separator
            origin = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            text = ids[origin]
            text[np.cumsum(size) - 1] = 0
            index = FMIndex(text, len(self.numbers))
            low, high = index.search(self.patterns, self.lengths)
            count = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(count)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            at = origin[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + self.lengths[which], -1)
            doc = np.searchsorted(begin, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                items[d] |= self.items[w]
        hit = np.cumsum(hit) > 0
        return [hit[b : b + n] for b, n in zip(begin.tolist(), sizes.tolist())], items


_SPAN = T.ArrayType(struct(start=LONG, end=LONG))
FOUND = struct(n_words=LONG, n_hit=LONG, items=T.ArrayType(STRING), words=_SPAN)


def _search(block: Windows):
    def look(texts: pa.Array, found: pa.Array | None = None) -> pa.Array:
        turn("search")
        shard = [words_of(b) for b in as_bytes(texts)]
        hits, items = block.mark(shard)
        rows = found.to_pylist() if found is not None else repeat(None)
        out = []
        for words, hit, own, row in zip(shard, hits, items, rows):
            if row:  # what earlier blocks found
                own = own | set(row["items"])
                for span in row["words"]:
                    hit[span["start"] : span["end"]] = True
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
            out.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(own), "words": spans})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return look


def with_found(docs: DataFrame, name: str, benchmark: DataFrame, doc_text: str = "text", id_col: str = "item_id", text_col: str = "text", block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """``docs`` with a column (n_words, n_hit, items, words): what the benchmark hits in a text.

    A document word inside any occurrence of an item's window (``window`` consecutive words, or the whole of a shorter
    item) is hit; ``words`` are the merged spans of hit words. Null and empty texts have no words; items without words
    have no window; repeated items count once, and an item without id counts under an empty id.

    The benchmark is searched in blocks of about ``block`` bytes. One block is with the driver and the tasks at a time:
    after each but the last the rows are written with what was found so far.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    n = 1 + items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block
    out = docs
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)
        look = _search(Windows([(r.id, bytes(r.text or b"")) for r in part.collect()], window))  # a block
        if i == 0:
            out = out.withColumn(name, F.arrow_udf(lambda texts, look=look: look(texts), FOUND)(doc_text))
        else:
            out = checkpointed(out).withColumn(name, F.arrow_udf(lambda texts, found, look=look: look(texts, found), FOUND)(doc_text, name))
    return out


def contaminated(found: Column) -> Column:
    """Whether a document is contaminated: at least a twentieth of its words are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


@F.arrow_udf(_SPAN)
def _character_spans(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Spans of words to spans of characters."""
    out = []
    for text, spans in zip(texts.to_pylist(), words.to_pylist()):
        at = [m.span() for m in _WORD.finditer(text or "")] if spans else []
        out.append([{"start": at[s["start"]][0], "end": at[s["end"] - 1][1]} for s in spans])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def removal_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, items, spans, contaminated) of every row; spans are character offsets of what is hit."""
    rows = with_found(docs.select(id_col, text_col), "__found", benchmark, text_col, **options)
    spans = _character_spans(text_col, "__found.words").alias("spans")
    return rows.select(id_col, "__found.n_words", "__found.n_hit", "__found.items", spans, contaminated(F.col("__found")).alias("contaminated"))


def measure(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Null and empty texts have no words and are clean; texts of any length are searched whole. Repeated rows and ids stay
    rows, and other columns are not read. An empty table gives an empty result, an empty benchmark hits nothing.
    """
    rows = with_found(docs.select(id_col, text_col), "__found", benchmark, text_col, **options)
    digest = F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256")
    return rows.select(
        id_col, "__found.n_words", "__found.n_hit", F.size("__found.items").cast("long").alias("n_items"), digest, contaminated(F.col("__found")).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; others, repeated ones included, stay as they are."""
    name = fresh("found", docs.columns)
    return with_found(docs, name, benchmark, text_col, **options).where(~contaminated(F.col(name))).select(*docs.columns)
