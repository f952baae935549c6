"""RAD files: paged Gaussians in chunks of 65,536 rows, as a Spark data source that reads and writes.

``spark.read.format("rad")`` makes a partition of every chunk, and reads and inflates only the properties whose columns the
schema asks for. Writing encodes chunks side by side into a staging folder; the commit gives them their names and publishes
the header, without which nothing can be read, as the last file. A task or job that ends early leaves no header, and the
abort takes its staging folder away.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import e, pi

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.scalars import lit
from ..operators.codebooks import rad_ranges
from ..operators.running import checkpointed, ranked
from .files import opened, read_range, write_bytes
from .ply import COLUMNS

# Fixed values of the format: marks, sizes, numbers of a row's parts, and which encodings a property may have.
FILE, CHUNK = b"RAD0", b"RADC"
ROWS = 65_536
PARTS = {"center": 3, "alpha": 1, "rgb": 3, "scales": 3, "orientation": 3, "sh1": 9, "sh2": 15, "sh3": 21, "sh1_code": 9, "sh2_code": 15, "sh3_code": 21, "sh_label": 1, "child_count": 1, "child_start": 1}
_COEFFICIENTS = ("f32", "f16", "r8", "r8_delta", "s8", "s8_delta")
ENCODINGS = {
    "center": ("f32", "f16", "f32_lebytes", "f16_lebytes"), "alpha": ("f32", "f16", "r8"), "rgb": ("f32", "f16", "r8", "r8_delta"),
    "scales": ("f32", "ln_0r8", "ln_f16"), "orientation": ("f32", "f16", "oct88r8"), "sh_label": ("u16", "u32"), "child_count": ("u16",), "child_start": ("u32",),
    **{f"sh{band}{end}": _COEFFICIENTS for band in (1, 2, 3) for end in ("", "_code")},
}
WIDTHS = {"f32": 4, "f32_lebytes": 4, "u32": 4, "f16": 2, "f16_lebytes": 2, "ln_f16": 2, "u16": 2}
SH_MAX = 127 / 128
NEEDED = ("center", "alpha", "rgb", "scales", "orientation")
#: Which properties a column is made of.
SOURCES = {
    **dict.fromkeys("xyz", ("center",)), "opacity": ("alpha",), **dict.fromkeys("rgb", ("rgb",)), **dict.fromkeys(("sx", "sy", "sz"), ("scales",)),
    **dict.fromkeys(("qx", "qy", "qz", "qw"), ("orientation",)), "sh": ("sh1", "sh2", "sh3", "sh_label"), "sh_label": ("sh_label",),
    "child_start": ("child_start",), "child_count": ("child_count",), "radius": ("scales", "alpha"), "id": (), "chunk": (),
}
SCHEMA = "id long, chunk long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", sh array<double>, sh_label long, child_start long, child_count int, radius double"


def demand(fine: bool, what: str) -> None:
    if not fine:
        raise ValueError(f"RAD: {what}")


def _aligned(n: int) -> int:
    return -(-n // 8) * 8


def headed(mark: bytes, meta: dict) -> bytes:
    """A mark, the length of the JSON text, and the text filled up to eight bytes."""
    text = json.dumps(meta, separators=(",", ":")).encode()
    return mark + struct.pack("<I", len(text)) + text.ljust(_aligned(len(text)), b"\0")


def _head(uri: str, at: int, mark: bytes, extra: int) -> tuple[dict, int, bytes]:
    """(JSON, bytes up to and with ``extra`` bytes after it, these bytes) of a header in a file."""
    start = read_range(uri, at, 8)
    demand(len(start) == 8 and start[:4] == mark, f"{uri} has no {mark.decode()} at {at}")
    length = struct.unpack("<I", start[4:])[0]
    rest = read_range(uri, at + 8, _aligned(length) + extra)
    demand(len(rest) == _aligned(length) + extra, f"{uri} is cut off in a header")
    return json.loads(rest[:length]), 8 + len(rest), rest[_aligned(length):]


@dataclass
class Piece(InputPartition):
    """A chunk: where its bytes are and which rows it has."""

    index: int
    uri: str
    offset: int
    size: int
    base: int
    count: int

    def __post_init__(self):
        self.value = self.index


def directory(uri: str) -> tuple[dict, list[Piece]]:
    """(metadata, chunks) of a file, checked: chunks are aligned, cover all rows once in order and don't overlap."""
    meta, start, _ = _head(uri, 0, FILE, 0)
    demand(meta.get("version") == 1 and meta.get("type") == "gsplat", f"version {meta.get('version')!r}, type {meta.get('type')!r}")
    n, total, listed = meta["count"], meta["allChunkBytes"], meta["chunks"]
    demand(0 <= n < 1 << 32 and (meta.get("maxSh") or 0) <= 3, f"{n} rows, degree {meta.get('maxSh')}")
    size, folder = meta.get("chunkSize") or n, uri.rpartition("/")[0]
    if not n:
        demand(not listed and not total, "an empty file has chunks")
    pieces, inline, used = [], [], 0
    for i, c in enumerate(listed):
        base = c.get("base") if c.get("base") is not None else i * size
        count = c.get("count") if c.get("count") is not None else min(size, n - base)
        demand(c["offset"] % 8 == 0 and c["bytes"] % 8 == 0 and c["bytes"] >= 16, f"chunk {i} is not aligned or too short")
        demand(base == (pieces[-1].base + pieces[-1].count if pieces else 0) and 0 < count <= n - base, f"chunk {i} does not follow the one before")
        used += c["bytes"]
        if c.get("filename") is None:
            demand(c["offset"] + c["bytes"] <= total, f"chunk {i} is beyond the file")
            inline.append((c["offset"], c["offset"] + c["bytes"]))
            pieces.append(Piece(i, uri, start + c["offset"], c["bytes"], base, count))
        else:
            demand(bool(c["filename"]) and "/" not in c["filename"], f"chunk {i} has no plain file name")
            pieces.append(Piece(i, f"{folder}/{c['filename']}", c["offset"], c["bytes"], base, count))
    demand(not n or bool(pieces) and pieces[-1].base + pieces[-1].count == n, "chunks do not cover the rows")
    inline.sort()
    demand(used <= total and all(a[1] <= b[0] for a, b in zip(inline, inline[1:])), "chunks overlap")
    return meta, pieces


def properties(piece: Piece, meta: dict) -> tuple[dict[str, dict], int]:
    """(properties by name, where their bytes start) of a chunk, checked against the file's metadata."""
    chunk, start, tail = _head(piece.uri, piece.offset, CHUNK, 8)
    payload, codes, tree = struct.unpack("<Q", tail)[0], meta.get("shCodeCount") or 0, bool(meta.get("lodTree"))
    demand(chunk.get("version") == 1 and chunk["base"] == piece.base and chunk["count"] == piece.count, f"chunk {piece.index} is not the one listed")
    demand(chunk["payloadBytes"] == payload == piece.size - start and payload % 8 == 0, f"chunk {piece.index} has another length")
    demand(chunk.get("lodTree") in (None, tree), f"chunk {piece.index} disagrees about the tree")
    found, ends = {}, []
    for p in chunk["properties"]:
        name, n = p["property"], codes if p["property"].endswith("_code") else piece.count
        demand(name in PARTS and name not in found, f"property {name}")
        demand(p["encoding"] in ENCODINGS[name] and p.get("compression") in (None, "gz"), f"{name} as {p['encoding']}, {p.get('compression')}")
        demand(p["offset"] % 8 == 0 and p["offset"] + p["bytes"] <= payload, f"{name} is not within the chunk")
        if p["encoding"] in ("r8", "r8_delta", "ln_0r8"):
            demand(None not in (p.get("min"), p.get("max")) and p["min"] <= p["max"], f"{name} has no range")
        elif p["encoding"] in ("s8", "s8_delta"):
            demand(p.get("max") is not None and p["max"] >= 0, f"{name} has no range")
        if name.endswith("_code"):
            demand(piece.base == 0 and codes > 0, "a codebook outside the first chunk")
        demand(not name.startswith("sh") or name == "sh_label" or int(name[2]) <= (meta.get("maxSh") or 0), f"{name} beyond the degree")
        found[name] = p | {"size": n * PARTS[name] * WIDTHS.get(p["encoding"], 1), "rows": n}
        ends.append((p["offset"], p["offset"] + p["bytes"]))
    ends.sort()
    demand(all(a[1] <= b[0] for a, b in zip(ends, ends[1:])), "properties overlap")
    demand(all(p in found for p in NEEDED), f"chunk {piece.index} lacks a property")
    demand(("child_start" in found) == ("child_count" in found) == tree, "tree properties disagree with the header")
    demand(("sh_label" in found) == (codes > 0) and not ("sh_label" in found and "sh1" in found), "labels disagree with the codebook")
    return found, piece.offset + start


def inflated(uri: str, start: int, p: dict) -> bytes:
    data = read_range(uri, start + p["offset"], p["bytes"])
    if p.get("compression"):
        unpack = zlib.decompressobj(-15)
        data = unpack.decompress(data, p["size"] + 1)
        demand(unpack.eof, f"{p['property']} is cut off or too long")
    demand(len(data) == p["size"], f"{p['property']} has {len(data)} bytes, not {p['size']}")
    return data


def values(p: dict, data: bytes) -> np.ndarray:
    """The numbers of a property, a row of its parts for each row of the chunk, in single precision or as whole numbers."""
    n, parts, kind = p["rows"], PARTS[p["property"]], p["encoding"]
    low, high = (np.float32(p.get(k) if p.get(k) is not None else 0) for k in ("min", "max"))
    if kind in ("u16", "u32"):
        return np.frombuffer(data, "<" + kind[0] + str(WIDTHS[kind])).astype(np.int64).reshape(n, 1)
    if kind == "oct88r8":
        return _from_octahedron(np.frombuffer(data, np.uint8).reshape(n, 3))
    if kind in ("f32", "f16", "ln_f16"):
        out = np.frombuffer(data, "<f4" if kind == "f32" else "<f2").astype(np.float32).reshape(parts, n).T
    elif kind in ("f32_lebytes", "f16_lebytes"):
        width = WIDTHS[kind]
        out = np.frombuffer(data, np.uint8).reshape(width, parts, n).transpose(2, 1, 0).copy().view(f"<f{width}")[:, :, 0].astype(np.float32)
    else:
        codes = np.frombuffer(data, np.uint8).reshape(parts, n)
        if kind.endswith("_delta"):
            codes = np.cumsum(codes, axis=1, dtype=np.uint8)
        codes = codes.T
        if kind.startswith("s8"):
            out = codes.view(np.int8).astype(np.float32) / np.float32(127) * high
        elif kind == "ln_0r8":
            with np.errstate(over="ignore"):
                out = low + (codes.astype(np.float32) - 1) * ((high - low) / np.float32(254))
            out = np.where(codes == 0, np.float32(-np.inf), out)
        else:
            out = codes.astype(np.float32) / np.float32(255) * (high - low) + low
    if kind.startswith("ln_"):
        with np.errstate(over="ignore"):
            out = np.exp(out)
    demand(bool(np.isfinite(out).all()), f"{p['property']} has a number that is not finite")
    if p["property"] in ("alpha", "scales"):
        demand(bool((out >= 0).all()), f"{p['property']} is below zero")
    if p["property"] == "orientation":
        square = (out * out).sum(axis=1, dtype=np.float32)
        out = np.column_stack([out, np.sqrt(np.maximum(0, 1 - square))]) / np.sqrt(np.maximum(1, square))[:, None]
    return out


def _from_octahedron(codes: np.ndarray) -> np.ndarray:
    """Rotations of an axis on the octahedron and an angle."""
    x, y = (codes[:, :2].astype(np.float32) / np.float32(255) * 2 - 1).T
    z = 1 - np.abs(x) - np.abs(y)
    fold = np.maximum(-z, 0)
    axis = np.stack([x - np.copysign(fold, x), y - np.copysign(fold, y), z], axis=1)
    half = codes[:, 2].astype(np.float32) / np.float32(255) * np.float32(pi / 2)
    return np.column_stack([axis * (np.sin(half) / np.linalg.norm(axis, axis=1))[:, None], np.cos(half)])


def opacity_of(alpha: np.ndarray) -> np.ndarray:
    """What an alpha stands for: beyond one it is a shape between one and five, whose kernel is wider."""
    shape = np.minimum(alpha, 2).astype(np.float32) * 4 - 3
    return np.where(alpha > 1, np.exp((shape * shape - 1) / np.float32(e)), alpha)


def alpha_of(opacity: np.ndarray) -> np.ndarray:
    """The inverse of ``opacity_of``, in half precision beyond one, and two at most."""
    over = np.maximum(opacity, 1)
    wide = np.minimum(2, 1 + 0.25 * (np.sqrt(1 + e * np.log(over)) - 1)).astype(np.float16).astype(float)
    return np.where(opacity > 1, wide, opacity)


def check_tree(base: int, total: int, starts: np.ndarray, counts: np.ndarray) -> None:
    """Children are in the file, of one parent in the chunk, and no row is its own descendant within the chunk."""
    own = np.flatnonzero(counts)
    a, b = starts[own], starts[own] + counts[own]
    demand(bool((b <= total).all()), "children beyond the rows")
    order = np.argsort(a, kind="stable")
    demand(bool((b[order][:-1] <= a[order][1:]).all()), "a child has two parents")
    n = len(starts)
    above = np.full(n + 1, n)
    low, high = np.clip(a - base, 0, n), np.clip(b - base, 0, n)
    steps = np.maximum(high - low, 0)
    above[np.repeat(low, steps) + np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)] = np.repeat(own, steps)
    for _ in range(n.bit_length() + 1):
        above = above[above]  # the ancestor twice as far up
    demand(bool((above == n).all()), "a row is below itself")


def coefficients(piece: Piece, meta: dict, found: dict[str, dict], start: int, labels: np.ndarray | None, first: Piece) -> np.ndarray:
    """Harmonics of a chunk's rows: its own, or of its labels from the codebook, which the first chunk has."""
    if labels is None:
        bands = [f"sh{k + 1}" for k in range(meta.get("maxSh") or 0)]
        demand(all(b in found for b in bands), f"chunk {piece.index} lacks harmonics")
        return np.concatenate([np.zeros((piece.count, 0)), *(values(found[b], inflated(piece.uri, start, found[b])) for b in bands)], axis=1)
    if first.index != piece.index:
        found, start = properties(first, meta)
    bands = [f"sh{k + 1}_code" for k in range(meta.get("maxSh") or 0)]
    demand(all(b in found for b in bands), "the codebook lacks a band")
    book = np.concatenate([np.zeros((meta["shCodeCount"], 0)), *(values(found[b], inflated(first.uri, start, found[b])) for b in bands)], axis=1)
    return book[labels]


class RadReader(DataSourceReader):
    """A partition for each chunk that holds rows asked for. Options: path; start and stop, ids of the first row and of
    the first row no longer wanted."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.names
        unknown = [c for c in self.names if c not in SOURCES]
        demand(not unknown, f"no columns {unknown}")
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", 1 << 32))
        self.meta, self.pieces = directory(options["path"])
        self.schema = schema

    def partitions(self) -> list[Piece]:
        return [p for p in self.pieces if p.base < self.stop and p.base + p.count > self.start]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no chunks
            return
        p, meta = partition, self.meta
        found, start = properties(p, meta)
        got: dict[str, np.ndarray] = {}

        def part(name: str) -> np.ndarray | None:
            if name not in got and name in found:
                got[name] = values(found[name], inflated(p.uri, start, found[name]))
            return got.get(name)

        def column(name: str):
            if name == "id":
                return pa.array(np.arange(p.base, p.base + p.count))
            if name == "chunk":
                return pa.array(np.full(p.count, p.index))
            if name == "sh":
                labels = part("sh_label")
                demand(labels is None or int(labels.max(initial=0)) < meta["shCodeCount"], "a label beyond the codebook")
                sh = coefficients(p, meta, found, start, None if labels is None else labels[:, 0], self.pieces[0]).astype(float)
                return pa.ListArray.from_arrays(pa.array(np.arange(p.count + 1, dtype=np.int32) * sh.shape[1]), pa.array(sh.ravel()))
            if name == "radius":
                if not meta.get("lodTree"):
                    return pa.nulls(p.count, pa.float64())
                alpha = part("alpha")[:, 0]
                return pa.array((part("scales").mean(axis=1) * np.where(alpha > 1, 1 + np.float32(2.8) * (alpha - 1), 1)).astype(float))
            source = SOURCES[name][0]
            data = part(source)
            if data is None:
                return pa.nulls(p.count, pa.int64())
            if source == "alpha":
                return pa.array(opacity_of(data[:, 0]).astype(float))
            at = {"center": "xyz", "rgb": "rgb", "scales": ("sx", "sy", "sz"), "orientation": ("qx", "qy", "qz", "qw")}.get(source, (name,)).index(name)
            return pa.array(data[:, at])

        if "child_start" in self.names or "child_count" in self.names:
            if meta.get("lodTree"):
                check_tree(p.base, meta["count"], part("child_start")[:, 0], part("child_count")[:, 0])
        types = _arrow_types(self.schema)
        batch = pa.RecordBatch.from_arrays([column(c).cast(t) for c, t in zip(self.names, types)], schema=pa.schema(list(zip(self.names, types))))
        low, high = max(self.start - p.base, 0), min(self.stop - p.base, p.count)
        for at in range(low, high, 8192):
            yield batch.slice(at, min(8192, high - at))


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32()}
    return [pa.list_(kinds[type(f.dataType.elementType)]) if isinstance(f.dataType, T.ArrayType) else kinds[type(f.dataType)] for f in schema]


def _code(x: np.ndarray, low: float, high: float, top: int = 255) -> np.ndarray:
    """Whole numbers from 0 to ``top`` over a range, halves up."""
    return np.floor(np.clip((x - low) / (high - low) * top, 0, top) + 0.5).astype(np.uint8)


def _octahedron(q: np.ndarray) -> np.ndarray:
    """Axis and angle of unit rotations in three bytes."""
    q = q * np.where(q[:, 3] < 0, -1.0, 1.0)[:, None]
    theta = 2 * np.arccos(np.clip(q[:, 3], 0, 1))
    s = np.sin(theta / 2)
    still = np.abs(s) < 1e-6
    axis = np.where(still[:, None], [1.0, 0.0, 0.0], q[:, :3] / np.where(still, 1, s)[:, None])
    axis = axis / np.abs(axis).sum(axis=1)[:, None]
    flat, below = axis[:, :2], axis[:, 2] < 0
    folded = (1 - np.abs(flat[:, ::-1])) * np.where(flat >= 0, 1.0, -1.0)
    flat = np.where(below[:, None], folded, flat)
    return np.column_stack([_code(flat[:, 0], -1, 1), _code(flat[:, 1], -1, 1), _code(theta, 0, pi)])


def _signed(sh: np.ndarray) -> bytes:
    """Harmonics as signed bytes, part by part."""
    return np.clip(np.floor(sh * (127 / SH_MAX) + 0.5), -127, 127).astype(np.int8).T.tobytes()


def encoded(columns: np.ndarray, sh: np.ndarray, base: int, ranges: dict, degree: int, labels=None, codes=None, tree=None) -> bytes:
    """A chunk of rows in the order of ``COLUMNS``. sh: their harmonics; or labels, with the codebook in the first chunk.
    tree: (child_start, child_count)."""
    n, listed, payload = len(columns), [], bytearray()

    def add(name: str, encoding: str, data: bytes, low: float | None = None, high: float | None = None) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        given = {} if high is None else {"min": low, "max": high}
        listed.append({"property": name, "encoding": encoding, "compression": "gz", **given, "offset": len(payload), "bytes": len(packed)})
        payload.extend(packed.ljust(_aligned(len(packed)), b"\0"))

    meta = ranges["meta"]
    add("center", "f32_lebytes", columns[:, :3].astype("<f4").view(np.uint8).reshape(n, 3, 4).transpose(2, 1, 0).tobytes())
    alpha = alpha_of(columns[:, 3])
    if ranges["alphaF16"]:
        add("alpha", "f16", alpha.astype("<f2").tobytes())
    else:
        add("alpha", "r8", _code(alpha, 0, 2).tobytes(), 0, 2)
    rgb = columns[:, 4:7]
    if ranges["rgbF16"]:
        add("rgb", "f16", rgb.astype(np.float32).astype("<f2").T.tobytes())
    else:
        codes_ = _code(rgb.astype(np.float32).astype(float), meta["rgbMin"], meta["rgbMax"]).T
        add("rgb", "r8_delta", np.diff(codes_, axis=1, prepend=np.zeros((3, 1), np.uint8)).tobytes(), meta["rgbMin"], meta["rgbMax"])
    with np.errstate(divide="ignore"):
        size = np.log(columns[:, 7:10]).astype(np.float32).astype(float)
    if ranges["scaleF16"]:
        add("scales", "ln_f16", size.astype("<f2").T.tobytes())
    else:
        low, high = meta["lnScaleMin"], meta["lnScaleMax"]
        add("scales", "ln_0r8", np.where(size <= -30, 0, 1 + _code(np.maximum(size, -1e30), low, high, 254)).astype(np.uint8).T.tobytes(), low, high)
    add("orientation", "oct88r8", _octahedron(columns[:, 10:14]).tobytes())
    bands = np.cumsum([0, 9, 15, 21])
    if labels is not None:
        for k in range(degree if codes is not None and base == 0 else 0):
            add(f"sh{k + 1}_code", "s8", _signed(codes[:, bands[k] : bands[k + 1]]), -SH_MAX, SH_MAX)
        kind = "u16" if len(codes) <= 1 << 16 else "u32"
        add("sh_label", kind, labels.astype("<u2" if kind == "u16" else "<u4").tobytes())
    else:
        for k in range(degree):
            add(f"sh{k + 1}", "s8", _signed(sh[:, bands[k] : bands[k + 1]]), -SH_MAX, SH_MAX)
    if tree is not None:
        add("child_count", "u16", tree[1].astype("<u2").tobytes())
        add("child_start", "u32", tree[0].astype("<u4").tobytes())
    head = {"version": 1, "base": base, "count": n, "maxSh": degree, "lodTree": tree is not None, "splatEncoding": meta, "payloadBytes": len(payload), "properties": listed}
    return headed(CHUNK, head) + struct.pack("<Q", len(payload)) + bytes(payload)


@dataclass
class Written(WriterCommitMessage):
    """(chunk, rows, bytes, staged file) of the chunks of a task."""

    chunks: list[tuple[int, int, int, str]]


class RadWriter(DataSourceArrowWriter):
    """Writes rows that carry their chunk (``__chunk``) and come in their order; see ``write_rad``."""

    def __init__(self, schema: T.StructType, options: dict):
        self.uri, self.names = options["path"], schema.names
        self.plan = json.loads(options["plan"])
        self.staging = f"{self.uri}.staging-{uuid.uuid4().hex}"
        system, path = opened(self.uri)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        book, out, held, now = None, [], [], None
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        if self.plan["codebook"]:
            uri, rows, parts = self.plan["codebook"]
            book = np.frombuffer(read_range(uri, 0, rows * parts * 8), "<f8").reshape(rows, parts)

        def flush() -> None:
            table = pa.Table.from_batches(held)
            get = lambda c: table[c].combine_chunks()
            n, degree = table.num_rows, self.plan["degree"]
            columns = np.column_stack([get(c).to_numpy(zero_copy_only=False) for c in COLUMNS]).astype(float)
            sh, labels = np.zeros((n, 0)), None
            if book is not None:
                labels = get("sh_label").to_numpy(zero_copy_only=False)
            elif degree:
                sh = get("sh").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            tree = tuple(get(c).to_numpy(zero_copy_only=False) for c in ("child_start", "child_count")) if self.plan["tree"] else None
            data = encoded(columns, sh, now * self.plan["chunk"], self.plan["ranges"], degree, labels, book, tree)
            uri = f"{self.staging}/{now}-{uuid.uuid4().hex}.radc"
            write_bytes(uri, data)
            out.append((now, n, len(data), uri))

        for batch in iterator:
            chunks = batch.column(self.names.index("__chunk")).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if now is not None and chunks[a] != now:
                    flush()
                    held = []
                now = int(chunks[a])
                held.append(batch.slice(a, b - a))
        if held:
            flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        """Give chunks their names, then publish the header; names come from the target, so that nothing is replaced."""
        found = sorted(c for m in messages if m is not None for c in m.chunks)
        plan, stem = self.plan, self.uri.rpartition("/")[2].removesuffix(".rad")
        size = plan["chunk"]
        sizes = [min(size, plan["count"] - k * size) for k in range(-(-plan["count"] // size))]
        demand([(c[0], c[1]) for c in found] == list(enumerate(sizes)), "chunks are missing or were written twice")
        folder, published = self.uri.rpartition("/")[0], []
        try:
            listed = []
            for k, n, length, staged in found:
                name = f"{stem}-{k}.radc"
                system, path = opened(f"{folder}/{name}")
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    raise FileExistsError(path)
                system.move(opened(staged)[1], path)
                published.append(path)
                listed.append({"offset": 0, "bytes": length, "base": k * size, "count": n, "filename": name})
            meta = {"version": 1, "type": "gsplat", "count": plan["count"], "maxSh": plan["degree"], "lodTree": plan["tree"], "chunkSize": size, "allChunkBytes": sum(c[2] for c in found), "chunks": listed, "splatEncoding": plan["ranges"]["meta"]}
            if plan["codebook"]:
                meta["shCodeCount"] = plan["codebook"][1]
            write_bytes(self.uri, headed(FILE, meta))
        except BaseException:
            for path in published:
                system.delete_file(path)
            raise
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """The staging folder goes, with what attempts left in it that never reported."""
        system, path = opened(self.staging)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class RadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rad"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> RadReader:
        return RadReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RadWriter:
        if overwrite:
            raise ValueError("RAD files are never overwritten; write to another name")
        return RadWriter(schema, self.options)


def read_rad(spark: SparkSession, uri: str, columns: list[str] | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows of a file: ``columns`` of ``SCHEMA`` (all), with ids from ``start`` to before ``stop``.

    Only the properties of the columns are read, and only chunks with such ids. A leaf has a child_count of 0 or null.
    """
    spark.dataSource.register(RadSource)
    reader = spark.read.format("rad")
    for k, v in (("start", start), ("stop", stop)):
        if v is not None:
            reader = reader.option(k, v)
    if columns is not None:
        kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(uri)


def write_rad(rows: DataFrame, uri: str, order: list[str], codebook: np.ndarray | None = None, chunk: int = ROWS) -> int:
    """Write rows (``COLUMNS``, and if they have them sh, sh_label, child_start and child_count) in ``order``; returns how
    many. ``order`` must tell all rows apart.

    Every ``chunk`` rows (65,536 at most) are a file beside the header, encoded by a task. With a codebook rows are written as labels and the
    first chunk has the codebook. The ranges that numbers are encoded in are of all rows. An existing file is an error.
    A file has less than 2**32 rows, so a header lists 65,536 chunks at most if they are full. An empty table makes a header only.
    """
    spark = rows.sparkSession
    demand(0 < chunk <= ROWS, f"chunks of {chunk} rows")
    spark.dataSource.register(RadSource)
    names = [c for c in (*COLUMNS, "sh", "sh_label", "child_start", "child_count") if c in rows.columns and (c != "sh" or codebook is None)]
    tree = "child_start" in names and "child_count" in names
    placed = checkpointed(ranked(rows, order, "__place").select(*names, (F.col("__place") - 1).alias("__place")))
    ends = [F.count("*").alias("n"), *(f(F.size("sh")).alias(k) for k, f in (("most", F.max), ("least", F.min)) if "sh" in names)]
    found = placed.agg(*ends).first()
    parts = codebook.shape[1] if codebook is not None else found["most"] or 0 if "sh" in names else 0
    demand(found["n"] < 1 << 32, f"{found['n']} rows")
    demand(parts in (0, 9, 24, 45) and (codebook is not None or "sh" not in names or found["least"] == found["most"]), f"{parts} harmonics, or rows of several lengths")
    plan = {"count": found["n"], "degree": {0: 0, 9: 1, 24: 2, 45: 3}[parts], "tree": tree, "ranges": rad_ranges(placed), "codebook": None, "chunk": chunk}
    system = None
    if codebook is not None:
        demand("sh_label" in names, "a codebook without labels")
        held = f"{uri}.codebook-{uuid.uuid4().hex}"
        write_bytes(held, codebook.astype("<f8").tobytes())
        plan["codebook"] = [held, *codebook.shape]
        system, path = opened(held)
    tasks = max(1, -(-found["n"] // chunk))
    out = placed.withColumn("__chunk", F.floor(F.col("__place") / chunk)).repartition(tasks, "__chunk").sortWithinPartitions("__chunk", "__place")
    out = out.withColumns({c: F.col(c).cast("double") for c in COLUMNS}).drop("__place")
    try:
        out.write.format("rad").option("plan", json.dumps(plan)).mode("append").save(uri)
    finally:
        if system is not None:
            system.delete_file(path)
    return found["n"]
