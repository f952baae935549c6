"""Token ids in binary files of bit or byte planes.

Documents are laid out in ascending order of their id. A file is a run of chunks: blocks of a fixed number of ids, each
turned into planes (all first bits, all second bits and so on, or bytes), each plane compressed with zstandard; then an
index of the chunks and of the documents, and a footer that says where the index is. Chunks are found by the index, so a
reader decodes only those that a document lies in.

Layout (little-endian): chunk planes; index: per chunk its offset, its ids and the size of each plane; per document its
id, a null flag and its number of ids; footer: offset of the index, chunks, documents, planes, ids per chunk, magic.
"""

from __future__ import annotations

import struct as binary
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_symbols
from .common import checkpointed, shuffle_width, small_batches
from .files import new_folder, opened

BLOCK = 1 << 16
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 400_000
END_ID = 1
_MAGIC = b"TOKPLAN1"
_FOOTER = binary.Struct("<QQQQQ8s")
_SPACE = r" \t\n\r\f\v"
#: What only the library splits: special tokens, and characters beyond ASCII and the Latin-1 letters.
_ODD = re.compile(r"<\||[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
# Fixed value: the pattern that the word tokenizer splits lower-case text with, for ASCII and Latin-1 letters.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^{_SPACE}a-zß-öø-ÿ0-9]+")
#: The same in any case; what stands between white space and has an odd character is one part.
_PARTS = re.compile(
    rf"[^{_SPACE}]*(?:{_ODD.pattern})[^{_SPACE}]*|'(?i:s|t|re|ve|m|ll|d)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^{_SPACE}A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    grid = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(grid[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()
    grid = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(grid, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """A file of planes, written in one go."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.out, self.block, self.bits, self.pack = out, block, bits, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.at, self.chunks, self.docs = [], 0, 0, [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        full = len(ids) if last else len(ids) // self.block * self.block
        for start in range(0, full, self.block):
            part = ids[start : min(full, start + self.block)]
            planes = [self.pack.compress(p) for p in to_planes(part, self.bits)]
            self.chunks.append((self.at, len(part), *map(len, planes)))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.held, self.size = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        n = 32 if self.bits else 4
        self.out.write(np.array(self.chunks, "<u8").tobytes())
        for k, kind in enumerate(("<i8", "<u1", "<u8")):
            self.out.write(np.array([d[k] for d in self.docs], kind).tobytes())
        self.out.write(_FOOTER.pack(self.at, len(self.chunks), len(self.docs), n, self.block, _MAGIC))
        self.out.close()


class Reader:
    """Random access to the documents of a file of planes."""

    def __init__(self, handle):
        self.handle, self.unpack = handle, zstandard.ZstdDecompressor()
        size = handle.size()
        handle.seek(size - _FOOTER.size)
        at, chunks, docs, self.planes, self.block, magic = _FOOTER.unpack(handle.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("no file of token planes")
        handle.seek(at)
        raw = handle.read(size - _FOOTER.size - at)
        width = 8 * (2 + self.planes)
        self.chunks = np.frombuffer(raw, "<u8", chunks * (2 + self.planes)).reshape(chunks, -1)
        rest = raw[chunks * width :]
        self.ids = np.frombuffer(rest, "<i8", docs)
        self.none = np.frombuffer(rest, "<u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(rest, "<u8", docs, 9 * docs).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        self.handle.seek(at)
        planes = [self.unpack.decompress(self.handle.read(s)) for s in sizes]
        return from_planes(planes, n)

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents from ``first`` up to ``last``, a chunk in memory at a time and what a document needs."""
        ends = np.cumsum(self.counts)
        have, base, k = np.zeros(0, "<u4"), 0, None
        for d in range(first, len(self.ids) if last is None else last):
            start, end = int(ends[d] - self.counts[d]), int(ends[d])
            if k is None:
                k = start // self.block
                base = k * self.block
            if start > base:
                have, base = have[start - base :], start
            parts, got = [have], len(have)
            while base + got < end:
                part = self.chunk(k)
                if (k * self.block) < start:
                    part = part[start - k * self.block :]
                    base = start
                parts.append(part)
                got += len(part)
                k += 1
            if len(parts) > 1:
                have = np.concatenate(parts)
            yield None if self.none[d] else int(self.ids[d]), have[: end - start]


class Words(dict):
    """Little-endian 32-bit ids of words by a tokenizers library object; a word is encoded when it is first asked for.

    Words of ASCII and Latin-1 letters go to the library's merges at once, in lower case and written in the letters that
    stand for bytes; what else there is goes through the whole library.
    """

    def __init__(self, library):
        self.library, self.merge = library, library.model.tokenize
        self.letters = byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if _ODD.search(word):
            ids = self.library.encode(word, add_special_tokens=False).ids
        else:
            low = word.lower()
            if not (low.isascii() and low.isalnum()):
                low = low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.merge(low)]
        self[word] = raw = binary.pack(f"<{len(ids)}I", *ids)
        return raw


class WordEncoder:
    """The ids of a tokenizer file by the tokenizers library, with words that were seen before looked up.

    The tokenizer drops white space and lower-cases, so a text's ids are those of its parts between white space. Parts
    of ASCII and Latin-1 letters are split at words and marks as the tokenizer's own pattern does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.known = Words(self.library)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            parts = _PARTS.findall(text) if _ODD.search(text) else _WORDS.findall(text.lower())
            yield b"".join(map(self.known.__getitem__, parts))


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _write(folder: str, path: str, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = opened(folder)
        name = f"{uuid.uuid4().hex}.planes"
        part = TaskContext.get().partitionId()
        end, encoder = np.array([END_ID], "<u4"), word_encoder(path)
        out, docs, total = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(where, recursive=True)
                out = Writer(system.open_output_stream(f"{where}/{name}", compression=None), bits=bits)
            for doc, ids in zip(batch.column("id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                out.add(doc, ids)
                docs += 1
                total += len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([docs]), pa.array([total])], names=["part", "file", "docs", "ids"])

    return run


def write_planes(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", bits: bool = False) -> DataFrame:
    """Write the ids of every row in ascending order of its id; returns the files (part, file, docs, ids, start).

    Rows are dealt out by ranges of ids before they are encoded. A null text is one end id; rows with a null id come
    first; rows of equal id stand together, in order of their text's hash. start: the ids in all files before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession, 1000)
    width = shuffle_width(docs.sparkSession)
    order = ("id", F.xxhash64("text"))  # so that rows of one id, or without one, may lie in many files
    rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    files = checkpointed(rows.mapInArrow(_write(folder, path, bits), "part long, file string, docs long, ids long"))
    # A row for each file: a running sum over them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["file"])
            ids, counts, crcs = [], [], []
            with system.open_input_file(path) as handle:
                for doc, tokens in Reader(handle).documents():
                    ids.append(doc)
                    counts.append(len(tokens))
                    crcs.append(zlib.crc32(np.ascontiguousarray(tokens, "<u4")))
            starts = row["start"] + np.cumsum([0, *counts[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[: len(ids)], pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_planes(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files."""
    width = shuffle_width(files.sparkSession)
    return files.select("file", "start").repartition(width, "file").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, folder: str | None = None, bits: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, as read back from the files."""
    files = write_planes(docs, folder or new_folder(docs.sparkSession, "planes"), path, bits=bits)
    return read_planes(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
