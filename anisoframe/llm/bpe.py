"""Byte-level BPE encoding and decoding, with merges found by a segment tree.

Texts are split into pretokens as the tokenizer's pattern says; each distinct pretoken is encoded once per task. Over a
pretoken's symbols stands a segment tree whose leaves are the ranks of adjacent pairs. The root yields the leftmost
lowest-rank merge; the merge changes at most three leaves, whose paths to the root are updated; this goes on until no
pair can be merged. The trees of many pretokens are kept side by side in arrays, so that a step updates all of them; a
long pretoken is merged by itself.

Texts are read a document at a time and all work is done where the rows are: no shuffle. The vocabulary (tokenizer file)
is read by every task from the path that is given; it has a fixed size.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FORGET, LONG, STRING, as_bytes, small_batches, struct, turn

#: Distinct pretokens that a task remembers before it starts anew, and characters of these.
REMEMBERED, REMEMBERED_CHARS = 300_000, 16 << 20
# White space as the pattern's \s has it, and the pattern that splits texts.
_SPACE = "\t-\r \x85\xa0  -     　"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNKS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NONE = np.int64(1) << 62
#: Bytes from which a pretoken has a tree of its own.
LONG_WORD = 512
#: Low bits of a leaf that hold the place; the 22 above them are left for the rank.
PLACE_BITS = 40


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in printable}
    out.update({b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))})
    return out


class MergeTrees:
    """Segment trees over the pair ranks of many words of equal padded length."""

    def __init__(self, words: np.ndarray, merges: PairTable):
        """words: a row of symbol ids for each word, -1 behind the end."""
        self.words, self.merges = words, merges
        n, width = words.shape
        self.width = 1 << max(1, (width - 1).bit_length())
        self.after = np.minimum(np.tile(np.arange(1, width + 1), (n, 1)), width)
        self.before = np.tile(np.arange(-1, width - 1), (n, 1))
        self.tree = np.full((n, 2 * self.width), _NONE)
        left, right = words[:, :-1], words[:, 1:]
        rank = merges.ranks(left.ravel(), right.ravel()).reshape(left.shape)
        self.tree[:, self.width : self.width + width - 1] = self._leaf(rank, np.arange(width - 1))
        for i in range(self.width - 1, 0, -1):
            self.tree[:, i] = np.minimum(self.tree[:, 2 * i], self.tree[:, 2 * i + 1])

    @staticmethod
    def _leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and then place, so that the smallest leaf is the leftmost lowest rank."""
        return np.where(rank < 0, _NONE, (rank << PLACE_BITS) + place)

    def _update(self, rows: np.ndarray, places: np.ndarray) -> None:
        """Leaves at the places, from the symbols there and after, and all above them."""
        width = self.words.shape[1]
        follow = self.after[rows, places]
        right = np.where(follow < width, self.words[rows, np.minimum(follow, width - 1)], -1)
        node = places + self.width
        self.tree[rows, node] = self._leaf(self.merges.ranks(self.words[rows, places], right), places)
        while len(node) and node[0] > 1:
            node = node >> 1
            self.tree[rows, node] = np.minimum(self.tree[rows, 2 * node], self.tree[rows, 2 * node + 1])

    def run(self) -> np.ndarray:
        """Merge until no pair of any word can be; symbols that were merged away are -1."""
        live = np.flatnonzero(self.tree[:, 1] < _NONE)
        width = self.words.shape[1]
        while len(live):
            at = self.tree[live, 1] & ((1 << PLACE_BITS) - 1)
            gone = self.after[live, at]
            self.words[live, at] = self.merges.merged(self.tree[live, 1] >> PLACE_BITS)
            self.words[live, gone] = -1
            self.tree[live, gone + self.width] = _NONE
            follow = self.after[live, gone]
            self.after[live, at] = follow
            inner = follow < width
            self.before[live[inner], follow[inner]] = at[inner]
            self._update(live, gone)
            self._update(live, at)
            back = self.before[live, at]
            some = back >= 0
            self._update(live[some], back[some])
            live = live[self.tree[live, 1] < _NONE]
        return self.words


def merge_one(symbols: np.ndarray, merges: PairTable) -> np.ndarray:
    """The symbols of one long word after all its merges, by the same tree: one word at a time, so that a merge costs the
    paths of three leaves and no more, whatever the length."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    tree = np.full(2 * width, _NONE)
    tree[width : width + n - 1] = MergeTrees._leaf(merges.ranks(symbols[:-1], symbols[1:]), np.arange(n - 1))
    for start in (width >> k for k in range(1, width.bit_length())):
        tree[start : 2 * start] = np.minimum(tree[2 * start : 4 * start : 2], tree[2 * start + 1 : 4 * start : 2])
    tree, words, none = array("q", tree.tobytes()), array("q", symbols.astype(np.int64).tobytes()), int(_NONE)
    after, before = array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
    rank, size, results, low = merges.rank_of(), merges.size, merges.results.tolist(), (1 << PLACE_BITS) - 1

    def put(place: int, leaf: int) -> None:
        i = width + place
        tree[i] = leaf
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    def pair(place: int) -> int:
        follow = after[place]
        found = rank.get(words[place] * size + words[follow]) if follow < n else None
        return none if found is None else (found << PLACE_BITS) + place

    while (top := tree[1]) < none:
        at = top & low
        gone = after[at]
        words[at], words[gone] = results[top >> PLACE_BITS], -1
        follow = after[at] = after[gone]
        if follow < n:
            before[follow] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out = np.frombuffer(words, np.int64)
    return out[out >= 0]


class PairTable:
    """Ranks and results of pairs of symbols."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray, size: int):
        self.size, self.results, self._rank_of = size, results, None
        key = pairs[:, 0] * size + pairs[:, 1]
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for those that don't merge."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merged(self, ranks: np.ndarray) -> np.ndarray:
        return self.results[ranks]

    def rank_of(self) -> dict[int, int]:
        """The rank by left * size + right."""
        if self._rank_of is None:
            self._rank_of = dict(zip(self.keys.tolist(), self.order.tolist()))
        return self._rank_of


class ByteBPE:
    """A byte-level tokenizer file (json): its vocabulary, merges and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = PairTable(
            np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64), max(vocab.values()) + 1
        )
        self.byte_ids = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.pattern = regex.compile(_PATTERN)
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids (as 32-bit numbers) of pretokens, encoded side by side with others of about their length."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = [b""] * len(data)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        at, long = 0, np.searchsorted(sizes[order], LONG_WORD, side="right")
        for i in order[long:].tolist():
            out[i] = merge_one(self.byte_ids[np.frombuffer(data[i], np.uint8)], self.table).astype("<u4").tobytes()
        order = order[:long]
        while at < len(order):
            width = 1 << max(2, int(sizes[order[at]] - 1).bit_length())
            end = min(int(np.searchsorted(sizes[order], width, side="right")), at + max(1, (1 << 17) // width))
            part = order[at:end]
            size = sizes[part]
            row = np.repeat(np.arange(len(part)), size)
            words = np.full((len(part), width), -1, np.int64)
            words[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = self.byte_ids[np.frombuffer(b"".join([data[i] for i in part.tolist()]), np.uint8)]
            merged = MergeTrees(words, self.table).run()
            keep = merged >= 0
            flat, ends = merged[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(axis=1))).tolist()
            for i, s, e in zip(part.tolist(), [0, *ends], ends):
                out[i] = flat[s:e]
            at = end
        return out

    def _split(self, chunk: str) -> list[str]:
        """The pretokens of a chunk; common shapes without the pattern's help."""
        if chunk.isascii():
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: set[str]) -> None:
        self.held += sum(map(len, chunks))
        split = [self._split(c) for c in chunks]
        new = list({p for s in split for p in s if p not in self.pieces})
        self.pieces.update(zip(new, self.encode_pieces(new)))
        get = self.pieces.__getitem__
        self.chunks.update(zip(chunks, (get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split)))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the strings of added tokens in a text are those tokens."""
        at = 0
        while at < len(texts):
            if max(len(self.chunks), len(self.pieces)) > REMEMBERED or self.held > REMEMBERED_CHARS:
                self.chunks.clear()
                self.pieces.clear()
                self.held = 0
            part, size, new = [], 0, set()
            while at < len(texts) and size < 1 << 20:
                text = texts[at]
                size += len(text) + 1
                at += 1
                spans = self.special.split(text) if self.special and self.special.search(text) else [text]
                row: list = [self.added[s].to_bytes(4, "little") if i % 2 else _CHUNKS.findall(s) for i, s in enumerate(spans)]
                for found in row[::2]:
                    new.update(found)
                part.append(row)
            self._learn({c for c in new if c not in self.chunks})
            get = self.chunks.__getitem__
            for row in part:
                yield np.frombuffer(b"".join(found if i % 2 else b"".join(map(get, found)) for i, found in enumerate(row)), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    turn("bpe")
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _texts(column: pa.Array) -> list[str]:
    return [b.decode() for b in as_bytes(column)]


def encoder(path: str) -> Callable:
    """A function of a text column to its ids (array of int). A null text has none."""

    def look(texts: pa.Array) -> pa.Array:
        rows = list(tokenizer(path).encode(_texts(texts)))
        offsets = np.cumsum([0, *map(len, rows)])
        flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))

    return F.arrow_udf(look, T.ArrayType(T.IntegerType()))


def decoder(path: str) -> Callable:
    """A function of a column of ids to the text."""
    return F.arrow_udf(lambda ids: pa.array([tokenizer(path).decode(i or []) for i in ids.to_pylist()], pa.string()), STRING)


def measure(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and from what they decode to.

    A null text is read as an empty one, which has no ids. Texts and pretokens of any length are encoded whole. Repeated
    rows and ids stay rows; other columns are not read; an empty table gives an empty result.
    """

    def look(texts: pa.Array) -> pa.Array:
        own = tokenizer(path)
        name = _decimals(path)
        rows = []
        for found in own.encode(_texts(texts)):
            ids = found.tolist()
            digits = hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest()
            rows.append((len(ids), digits, hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 3
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    shape = struct(n_tokens=LONG, ids_sha256=STRING, decoded_sha256=STRING)
    return docs.select(id_col, F.arrow_udf(look, shape)(text_col).alias("m")).select(id_col, "m.*")


_NAMES: dict[str, dict[int, str]] = {}


def _forget() -> None:
    _LOADED.clear()
    _NAMES.clear()


FORGET["bpe"] = _forget


def _decimals(path: str) -> dict[int, str]:
    return _NAMES.setdefault(path, {i: str(i) for i in tokenizer(path).bytes_of})
