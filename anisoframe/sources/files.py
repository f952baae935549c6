"""Files by URI, in the driver for headers and in tasks for byte ranges."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as handle:
        handle.seek(start)
        return handle.read(size)


def write_bytes(uri: str, data: bytes) -> None:
    """Write beside the target and rename, so that no half-written file has its name; an existing file is an error."""
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(uri)
    with system.open_output_stream(path + ".part", compression=None) as out:
        out.write(data)
    system.move(path + ".part", path)


def ranges(spark: SparkSession, uri: str, start: int, count: int, record: int, rows: int = 1 << 20) -> DataFrame:
    """(uri, first, n, at): pieces of a file of records of one size, a row each, dealt to tasks."""
    parts = -(-count // rows) if count else 0
    first = F.col("id") * rows
    out = spark.range(0, parts, 1, max(1, min(parts, 10_000))).select(F.lit(uri).alias("uri"), first.alias("first"), F.least(F.lit(rows), F.lit(count) - first).alias("n"))
    return out.withColumn("at", F.lit(start).cast("long") + F.col("first") * record)


def sniff(head: bytes, name: str = "") -> str:
    """The format of a file by its first bytes, or else by its name."""
    for magic, kind in ((b"ply", "ply"), (b"\x1f\x8b", "spz"), (b"NGSP", "spz"), (b"RAD0", "rad"), (b"PK\x03\x04", "sog"), (b"{", "json")):
        if head.startswith(magic):
            return kind
    suffix = name.lower().rpartition(".")[2]
    if suffix in ("ply", "spz", "rad", "sog", "json"):
        return suffix
    raise ValueError(f"no known format: {name}")
