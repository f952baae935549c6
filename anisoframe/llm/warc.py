"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writer. A record is a gzip member of its own. Of records with equal payloads of at least 100 bytes that with the
smallest id holds the payload, the others revisit it. A task writes one file, under a name that no other attempt uses,
and returns the name: files of attempts that were lost are in no result.

Reader. Files are cut into byte ranges. A task looks in its range for the magic of a gzip member, takes a candidate only
if it decodes to a WARC header, and owns the records that start inside, reading beyond its end to finish the last. So a
file of any size is read by many tasks, and no index is needed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, as_bytes, checkpointed, join_hot, shuffle_width, small_batches
from .files import new_folder, opened

#: Payloads below this size are never replaced by a revisit.
REVISIT_BYTES = 100
SPLIT_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_RECORD_SHAPE = "id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, record_id string, refers_to_id string, intact boolean"


def _name(record: int | None) -> str:
    return f"<urn:x-record:{'none' if record is None else record}>"


def _number(name: str | None) -> int | None:
    """The id of a record of ours; names that other writers give have none."""
    head, _, value = (name or "").strip("<>").rpartition(":")
    return int(value) if head == "urn:x-record" and value.lstrip("-").isdigit() else None


def member(record: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    # A header is a line: control characters of a url are written as percent codes.
    clean = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(record)}", "WARC-Date: 2000-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean}"] if url is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked HTTP message; what follows no valid size is left out."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size) or int(size, 16) == 0:
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def _digest_fits(given: str, payload: bytes) -> bool | None:
    """Whether a labelled digest is the payload's; null for kinds that are not known."""
    kind, _, value = given.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    own = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse(record: bytes) -> list[dict]:
    """The records of a decoded member, usually one.

    Records of all types are returned. The payload of an HTTP response is its body, freed of chunks; of another record its
    block. payload_digest is the SHA-256 of the payload, for a revisit what the record says of it without its label.
    intact: whether the digest that the record gives fits the payload, null where that can't be told.
    """
    out = []
    while record.startswith(b"WARC/"):
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = _fields(head)
        size = fields.get("content-length", "")
        block = rest[: int(size)] if size.isdigit() else rest
        record = rest[len(block) :].lstrip(b"\r\n")
        kind, payload, stated = fields.get("warc-type", ""), block, None
        if "application/http" in fields.get("content-type", "").lower():
            http, _, payload = block.partition(b"\r\n\r\n")
            inner = _fields(http)
            stated = inner.get("content-length", "")
            if "chunked" in inner.get("transfer-encoding", "").lower():
                payload = _dechunked(payload)
        given, revisit = fields.get("warc-payload-digest", ""), kind == "revisit"
        length = int(stated) if stated and stated.isdigit() else None
        out.append({
            "id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_digest": (given.rpartition(":")[2] or None) if revisit else hashlib.sha256(payload).hexdigest(),
            "payload_bytes": length if revisit else len(payload), "refers_to": _number(fields.get("warc-refers-to")), "payload": None if revisit else payload,
            "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"), "intact": None if revisit or not given else _digest_fits(given, payload),
        })
    return out


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, size = None, 0
        for batch in batches:
            payloads = as_bytes(batch.column("payload"))
            for row, payload in zip(batch.select(["id", "url", "digest", "refers_to"]).to_pylist(), payloads):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = member(row["id"], row["url"], payload, row["digest"], row["refers_to"])
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size])], names=["file", "size"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row; returns the files (file, size).

    Null payloads are empty. Payloads below 100 bytes, and rows with a null id, are always responses; rows equal in id
    and payload are each written as the first of them is.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    first = rows.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = checkpointed(first)
    # Only what occurs twice is shuffled, apart from very common payloads.
    key = F.xxhash64("digest")
    twice, rows = Members(first.select(key.alias("key")), "key"), rows.withColumn("key", key)
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = join_hot(twice.those_in(rows, "key"), first, ["digest"], total, how="left")
    rows = twice.those_out(rows, "key").withColumn("first", F.lit(None).cast("long")).unionByName(again.drop("n"))
    refers = F.when(large & (F.col("id") > F.col("first")), F.col("first"))
    files = rows.select("id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_write(folder), "file string, size long")
    return checkpointed(files)


class _Range:
    """Bytes of a file from a place on, read as far as they are asked for."""

    def __init__(self, handle, start: int):
        self.handle, self.start, self.data = handle, start, bytearray()
        handle.seek(start)

    def grow(self) -> bool:
        more = self.handle.read(_READ)
        self.data += more
        return bool(more)

    def drop(self, to: int) -> None:
        """Forget what lies before a place of the file."""
        del self.data[: to - self.start]
        self.start = to


def members(handle, start: int, end: int) -> Iterator[bytes]:
    """The decoded WARC records whose members start in [start, end)."""
    view, at = _Range(handle, start), start
    while at < end:
        found = view.data.find(_MAGIC, at - view.start)
        if found < 0:
            at = max(at, view.start + len(view.data) - len(_MAGIC) + 1)
            view.drop(min(at, view.start + len(view.data)))
            if at >= end or not view.grow():
                return
            continue
        at = view.start + found
        if at >= end:
            return
        view.drop(at)
        unpack, record, fed, fine = zlib.decompressobj(31), bytearray(), 0, True
        try:
            while not unpack.eof and fine:
                if fed == len(view.data) and not view.grow():
                    fine = False
                    break
                part = bytes(view.data[fed : fed + (1 << 16)])
                record += unpack.decompress(part)
                fed += len(part)
                fine = len(record) < 7 or record.startswith(b"WARC/1.")
        except zlib.error:
            fine = False
        if fine and record.startswith(b"WARC/1."):
            yield bytes(record)
            at += fed - len(unpack.unused_data)
        else:
            at += 1
        view.drop(at)


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        shape = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for part in batch.to_pylist():
                system, path = opened(part["file"])
                rows, size = [], 0
                with system.open_input_file(path) as handle:
                    for record in members(handle, part["start"], part["end"]):
                        size += len(record)
                        rows += [row if payloads else row | {"payload": None} for row in parse(record)]
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    return run


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (file, size), as ``parse`` describes them, those of other writers included.

    id and refers_to are set for records of ``write_warc``; record_id and refers_to_id are the names themselves. Revisits
    have no payload of their own. Without ``payloads`` those are read but not returned. Empty files have no records.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(split_bytes).cast("long")))
    parts = files.select("file", "size", starts.alias("start")).withColumn("end", F.least("size", F.col("start") + split_bytes))
    width = shuffle_width(files.sparkSession)
    return parts.repartition(width, "file", "start").mapInArrow(_read(payloads), _RECORD_SHAPE)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of the archives at a path, for ``read_warc``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from its archive."""
    files = write_warc(pages, folder or new_folder(pages.sparkSession, "warc"))
    return read_warc(files, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
