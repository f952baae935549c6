"""SPZ files: packed Gaussians in sections, compressed with gzip (versions 1 to 3) or zstandard streams (version 4).

A compressed file can't be entered in the middle, so a file is a task's work and many files are read side by side; a
scene is kept as many files. Harmonics that aren't asked for aren't decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .files import read_range
from .ply import SCHEMA, SH_C0, _batch

# Fixed values of the format.
MAGIC = 0x5053474E
_GZIP_HEAD, _TOC = struct.Struct("<IIIBBBB"), struct.Struct("<QQ")
COLOUR_SCALE = 0.15
SH_DIMS = (0, 9, 24, 45, 72)
LIMIT = 1 << 31


def sections(version: int, n: int, degree: int) -> list[int]:
    """Bytes of centres, alphas, colours, scales, rotations and harmonics."""
    return [n * (6 if version == 1 else 9), n, 3 * n, 3 * n, n * (3 if version < 3 else 4), n * SH_DIMS[degree]]


def check(version: int, degree: int, bits: int) -> None:
    if not 1 <= version <= 4 or degree > 4 or bits > 30:
        raise ValueError(f"version {version}, degree {degree}, {bits} fractional bits")


def unpacked(data: bytes) -> tuple[int, int, int, int, list[bytes]]:
    """(version, rows, degree, fractional bits, sections) of a file."""
    if data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(data, LIMIT)
        if not unpack.eof:
            raise ValueError("the gzip stream is cut off or too long")
        magic, version, n, degree, bits, _, _ = _GZIP_HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("no SPZ file")
        check(version, degree, bits)
        sizes = sections(version, n, degree)
        if version > 3 or len(raw) != _GZIP_HEAD.size + sum(sizes):
            raise ValueError("the sections don't fill the file")
        ends = np.cumsum([_GZIP_HEAD.size, *sizes]).tolist()
        return version, n, degree, bits, [raw[a:b] for a, b in zip(ends, ends[1:])]
    magic, version, n, degree, bits, _, streams = struct.unpack_from("<IIIBBBB", data)
    if magic != MAGIC or version != 4:
        raise ValueError("no SPZ file")
    check(version, degree, bits)
    toc = struct.unpack_from("<I", data, 16)[0]
    sizes, out, at = sections(version, n, degree), [], toc + streams * _TOC.size
    if streams != (6 if degree else 5):
        raise ValueError(f"{streams} streams")
    for k in range(streams):
        packed, plain = _TOC.unpack_from(data, toc + k * _TOC.size)
        if plain != sizes[k] or at + packed > len(data):
            raise ValueError(f"stream {k} has another size than its rows")
        out.append(zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(data[at : at + packed], plain))
        at += packed
    if at != len(data):
        raise ValueError("bytes behind the last stream")
    return version, n, degree, bits, out if degree else [*out, b""]


def decode(data: bytes, max_sh: int = 4) -> tuple[np.ndarray, np.ndarray]:
    version, n, degree, bits, parts = unpacked(data)
    u8 = [np.frombuffer(p, np.uint8) for p in parts]
    if version == 1:
        xyz = np.frombuffer(parts[0], "<f2").astype(float).reshape(n, 3)
    else:
        b = u8[0].reshape(n, 3, 3).astype(np.int64)
        xyz = ((b[:, :, 0] | b[:, :, 1] << 8 | b[:, :, 2] << 16) ^ 0x800000) - 0x800000
        xyz = xyz / float(1 << bits)
    rgb = (u8[2].reshape(n, 3) / 255 - 0.5) * (SH_C0 / COLOUR_SCALE) + 0.5
    scale = np.exp(u8[3].reshape(n, 3) / 16 - 10)
    if version < 3:
        v = u8[4].reshape(n, 3) / 127.5 - 1
        q = np.column_stack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))])
    else:
        q = _smallest_three(np.frombuffer(parts[4], "<u4").astype(np.int64))
    keep = min(degree, max_sh)
    sh = (u8[5].reshape(n, -1)[:, : SH_DIMS[keep]].astype(float) - 128) / 128 if keep else np.zeros((n, 0))
    return np.column_stack([xyz, u8[1] / 255, rgb, scale, q]), sh


def _smallest_three(word: np.ndarray) -> np.ndarray:
    omitted, q, rest = word >> 30, np.zeros((len(word), 4)), word.copy()
    for k in (3, 2, 1, 0):
        own = omitted != k
        size = (rest & 511) / 511 * 0.5**0.5
        q[own, k] = np.where(rest & 512, -size, size)[own]
        rest = np.where(own, rest >> 10, rest)
    q[np.arange(len(q)), omitted] = np.sqrt(np.maximum(0, 1 - (q * q).sum(axis=1)))
    return q


def encode(columns: np.ndarray, sh: np.ndarray | None = None, version: int = 3, bits: int = 12) -> bytes:
    """A file of rows in the order of ``COLUMNS``."""
    n = len(columns)
    degree = SH_DIMS.index(sh.shape[1]) if sh is not None else 0
    byte = lambda v: np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)
    if version == 1:
        centres = columns[:, :3].astype("<f2").tobytes()
    else:
        fixed = np.floor(columns[:, :3] * (1 << bits) + 0.5).astype(np.int64) & 0xFFFFFF
        centres = np.stack([fixed & 255, fixed >> 8 & 255, fixed >> 16], 2).astype(np.uint8).tobytes()
    q = columns[:, 10:14] / np.linalg.norm(columns[:, 10:14], axis=1, keepdims=True)
    if version < 3:
        q = np.where(q[:, 3:] < 0, -q, q)
        turns = byte((q[:, :3] + 1) * 127.5).tobytes()
    else:
        omitted = np.abs(q).argmax(axis=1)
        q = np.where(q[np.arange(n), omitted][:, None] < 0, -q, q)
        word = omitted.astype(np.int64)
        for k in range(4):
            size = np.floor(np.abs(q[:, k]) * 2**0.5 * 511 + 0.5).astype(np.int64)
            word = np.where(omitted == k, word, word << 10 | (q[:, k] < 0).astype(np.int64) << 9 | size)
        turns = word.astype("<u4").tobytes()
    with np.errstate(divide="ignore"):
        scales = byte((np.log(columns[:, 7:10]) + 10) * 16).tobytes()
    colours = byte(((columns[:, 4:7] - 0.5) / (SH_C0 / COLOUR_SCALE) + 0.5) * 255).tobytes()
    parts = [centres, byte(columns[:, 3] * 255).tobytes(), colours, scales, turns]
    parts += [byte(sh * 128 + 128).tobytes()] if degree else []
    if version < 4:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        return pack.compress(_GZIP_HEAD.pack(MAGIC, version, n, degree, bits, 0, 0) + b"".join(parts)) + pack.flush()
    packed = [zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True).compress(p) for p in parts]
    head = struct.pack("<IIIBBBBI", MAGIC, 4, n, degree, bits, 0, len(parts), 32).ljust(32, b"\0")
    return head + b"".join(_TOC.pack(len(p), len(r)) for p, r in zip(packed, parts)) + b"".join(packed)


def read_spz(spark: SparkSession, path: str, max_sh: int = 4) -> DataFrame:
    """The rows of all files at a path (a file, folder or pattern), with the file and the place in it."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").repartition(max(1, spark.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns, sh = decode(read_range(row["path"], 0, row["length"]), max_sh)
                for s in range(0, len(columns), 1 << 16):
                    b = _batch(s, columns[s : s + (1 << 16)], sh[s : s + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * b.num_rows), *b.columns], names=["file", *b.schema.names])

    return files.mapInArrow(run, "file string, " + SCHEMA)


