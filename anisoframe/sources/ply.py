"""PLY files: standard Gaussians, point clouds and the compressed form, read by byte ranges; a writer of the standard form.

Records have one size, so a file is cut into ranges of rows and read by as many tasks; only the header is read first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import opened, ranges, read_range, write_bytes

# Names of the format's number types, and counts of harmonics.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
SH_COUNTS = {0: 0, 9: 1, 24: 2, 45: 3, 72: 4}
SH_C0 = 0.28209479177387814
COLUMNS = ("x", "y", "z", "opacity", "r", "g", "b", "sx", "sy", "sz", "qx", "qy", "qz", "qw")
SCHEMA = "id long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", sh array<double>"
_HEADER = 1 << 16


class Header:
    """Elements in file order (name, count, record type), comments, and where the data starts."""

    def __init__(self, head: bytes):
        m = re.search(rb"end_header\r?\n", head)
        if not head.startswith(b"ply") or m is None:
            raise ValueError("no PLY header")
        self.start, self.comments, self.elements = m.end(), [], []
        fields: list = []
        for line in head[: m.start()].decode("ascii", "replace").splitlines()[1:]:
            word, _, rest = line.strip().partition(" ")
            if word == "format" and rest.split()[0] != "binary_little_endian":
                raise ValueError(f"format {rest}")
            if word == "comment":
                self.comments.append(rest)
            elif word == "element":
                name, count = rest.split()
                if name in (e[0] for e in self.elements):
                    raise ValueError(f"element {name} twice")
                fields = []
                self.elements.append((name, int(count), fields))
            elif word == "property":
                kind, _, name = rest.partition(" ")
                if kind == "list":
                    raise ValueError("list properties")
                if name in (f[0] for f in fields):
                    raise ValueError(f"property {name} twice")
                fields.append((name, TYPES[kind]))
        if any(not f for _, _, f in self.elements):
            raise ValueError("an element without properties")
        self.elements = [(n, c, np.dtype(f)) for n, c, f in self.elements]

    def element(self, name: str) -> tuple[int, int, np.dtype]:
        """(offset, count, type) of an element."""
        at = self.start
        for n, count, kind in self.elements:
            if n == name:
                return at, count, kind
            at += count * kind.itemsize
        raise ValueError(f"no element {name}")

    @property
    def size(self) -> int:
        return self.start + sum(c * k.itemsize for _, c, k in self.elements)


def _unit(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(n > 0, q / np.where(n > 0, n, 1), q)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Bytes are fractions of 255; other numbers stay."""
    return v / 255.0 if v.dtype.itemsize == 1 else v.astype(float)


def decode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, harmonics) of standard or point-cloud records."""
    names, n = rows.dtype.names, len(rows)
    get = lambda c: rows[c].astype(float)
    xyz = [get(c) for c in "xyz"]
    if "scale_0" not in names and "rot_0" not in names and "f_dc_0" not in names:
        if not {"red", "green", "blue"} <= set(names):
            raise ValueError("neither Gaussians nor coloured points")
        alpha = _scaled(rows["alpha"]) if "alpha" in names else np.ones(n)
        one, zero, small = np.ones(n), np.zeros(n), np.full(n, 0.001)
        return np.stack([*xyz, alpha, *(_scaled(rows[c]) for c in ("red", "green", "blue")), small, small, small, zero, zero, zero, one], 1), np.zeros((n, 0))
    opacity = get("opacity_linear") if "opacity_linear" in names else 1 / (1 + np.exp(-get("opacity"))) if "opacity" in names else np.ones(n)
    rgb = [0.5 + SH_C0 * get(f"f_dc_{i}") for i in range(3)] if "f_dc_0" in names else [_scaled(rows[c]) for c in ("red", "green", "blue")]
    q = _unit(np.stack([get(f"rot_{i}") for i in (1, 2, 3, 0)], 1))
    count = sum(c.startswith("f_rest_") for c in names)
    if count not in SH_COUNTS:
        raise ValueError(f"{count} harmonics")
    # The file lists all of red, then of green and blue; rows have three together.
    rest = np.stack([get(f"f_rest_{i}") for i in range(count)], 1).reshape(n, 3, -1).transpose(0, 2, 1).reshape(n, count) if count else np.zeros((n, 0))
    return np.column_stack([*xyz, opacity, *rgb, *(np.exp(get(f"scale_{i}")) for i in range(3)), q]), rest


def decode_packed(rows: np.ndarray, chunks: np.ndarray, first: int) -> np.ndarray:
    """Columns of compressed records; every 256 rows have the ranges of one chunk."""
    at = (first + np.arange(len(rows))) // 256
    own = chunks[at - first // 256]
    word = lambda c: rows[c].astype(np.int64)

    def spread(w: np.ndarray, names: list[str]) -> list[np.ndarray]:
        codes = [(w >> 21) / 2047, (w >> 11 & 1023) / 1023, (w & 2047) / 2047]
        return [own[f"min_{c}"] + (own[f"max_{c}"] - own[f"min_{c}"]).astype(float) * v for c, v in zip(names, codes)]

    q = word("packed_rotation")
    a, b, c = (((q >> s & 1023) / 1023 - 0.5) * 2**0.5 for s in (20, 10, 0))
    d = np.sqrt(np.maximum(0, 1 - a * a - b * b - c * c))
    orders = np.stack([np.stack(o, 1) for o in ((a, b, c, d), (d, b, c, a), (b, d, c, a), (b, c, d, a))])
    quaternion = orders[q >> 30, np.arange(len(rows))]
    colour = word("packed_color")
    rgba = [(colour >> s & 255) / 255 for s in (24, 16, 8, 0)]
    if "min_r" in chunks.dtype.names:
        rgba[:3] = [own[f"min_{n}"] + (own[f"max_{n}"] - own[f"min_{n}"]) * v for n, v in zip("rgb", rgba)]
    scales = [np.exp(v) for v in spread(word("packed_scale"), ["scale_x", "scale_y", "scale_z"])]
    return np.column_stack([*spread(word("packed_position"), ["x", "y", "z"]), rgba[3], *rgba[:3], *scales, quaternion])


def _batch(first: int, columns: np.ndarray, sh: np.ndarray) -> pa.RecordBatch:
    n, k = len(columns), sh.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(sh.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), *(pa.array(c) for c in columns.T), lists], names=["id", *COLUMNS, "sh"])


def read_ply(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of a file, with their place in it as id. Scales are linear, rotations unit, bytes fractions."""
    header = Header(read_range(uri, 0, _HEADER))
    system, path = opened(uri)
    if system.get_file_info(path).size < header.size:
        raise ValueError("the file is shorter than its header says")
    start, count, kind = header.element("vertex")
    packed = "packed_position" in kind.names
    chunk_at, chunk_count, chunk_kind = header.element("chunk") if packed else (0, 0, np.dtype("u1"))
    sh_at, _, sh_kind = header.element("sh") if packed and any(e[0] == "sh" for e in header.elements) else (0, 0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for first in range(part["first"], part["first"] + part["n"], 1 << 16):
                    n = min(1 << 16, part["first"] + part["n"] - first)
                    rows = np.frombuffer(read_range(uri, start + first * kind.itemsize, n * kind.itemsize), kind)
                    if not packed:
                        yield _batch(first, *decode(rows))
                        continue
                    low, high = first // 256, -(-(first + n) // 256)
                    chunks = np.frombuffer(read_range(uri, chunk_at + low * chunk_kind.itemsize, (high - low) * chunk_kind.itemsize), chunk_kind)
                    sh = np.zeros((n, 0))
                    if sh_kind is not None:
                        codes = np.frombuffer(read_range(uri, sh_at + first * sh_kind.itemsize, n * sh_kind.itemsize), np.uint8).reshape(n, -1)
                        sh = (codes * (8 / 255) - 4).reshape(n, 3, -1).transpose(0, 2, 1).reshape(n, -1)
                    yield _batch(first, decode_packed(rows, chunks, first), sh)

    return ranges(spark, uri, start, count, kind.itemsize).mapInArrow(run, SCHEMA)


def encode(columns: np.ndarray, sh: np.ndarray | None = None) -> bytes:
    """A standard file of rows in the order of ``COLUMNS``; harmonics three together."""
    return heading(len(columns), 0 if sh is None else sh.shape[1]) + records(columns, sh)


def heading(n: int, count: int) -> bytes:
    """The header of a standard file of n rows with so many harmonics."""
    names = ["x", "y", "z", "opacity", "f_dc_0", "f_dc_1", "f_dc_2", "scale_0", "scale_1", "scale_2", "rot_1", "rot_2", "rot_3", "rot_0", *(f"f_rest_{i}" for i in range(count))]
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property float {c}\n" for c in names) + "end_header\n"
    return head.encode()


def records(columns: np.ndarray, sh: np.ndarray | None = None) -> bytes:
    n, count = len(columns), 0 if sh is None else sh.shape[1]
    data = columns.astype(float).copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        data[:, 3] = np.log(data[:, 3]) - np.log1p(-data[:, 3])
        data[:, 7:10] = np.log(data[:, 7:10])
    data[:, 4:7] = (data[:, 4:7] - 0.5) / SH_C0
    if count:
        data = np.column_stack([data, sh.reshape(n, -1, 3).transpose(0, 2, 1).reshape(n, count)])
    return data.astype("<f4").tobytes()


def write_ply(rows: DataFrame, folder: str) -> DataFrame:
    """Write every partition as a file, with the harmonics (``sh``) if rows have them; returns (file, n).

    Files are published whole, under names of their own. A task holds the bytes of its file, not its rows. Rows of a file
    have one number of harmonics; a null or short list is filled with zeros up to the
    longest of the first batch, and a longer one later is an error.
    """
    import uuid

    columns = [*COLUMNS, *(["sh"] if "sh" in rows.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, count = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sh = None
            if "sh" in columns:
                lists = [x or [] for x in batch.column(len(COLUMNS)).to_pylist()]
                count = max(map(len, lists)) if count is None else count
                if count not in SH_COUNTS or max(map(len, lists)) > count:
                    raise ValueError("rows with several numbers of harmonics")
                sh = np.array([x + [0.0] * (count - len(x)) for x in lists], float).reshape(len(lists), count)
            held.append(records(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(COLUMNS))]), sh))
            n += batch.num_rows
        if held:
            uri = f"{folder}/{uuid.uuid4().hex}.ply"
            system, path = opened(folder)
            system.create_dir(path, recursive=True)
            write_bytes(uri, heading(n, count or 0) + b"".join(held))
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], names=["file", "n"])

    return rows.select(*columns).mapInArrow(run, "file string, n long")
