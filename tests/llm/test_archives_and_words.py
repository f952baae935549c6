"""Archives in the standard's form, split anywhere; long pretokens against the library."""

import base64
import gzip
import hashlib
import random
import time

from anisoframe.llm import bpe, queries, warc


def record(kind, body, name, **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()] + [f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"
PAGE = b"<p>" + b"words of a page " * 30
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;x=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
SHA1 = base64.b32encode(hashlib.sha1(PAGE).digest()).decode()
RECORDS = [
    record("warcinfo", b"software: a tool\r\n", "1", Content_Type="application/warc-fields"),
    record("request", b"GET / HTTP/1.1\r\nHost: a.org\r\n\r\n", "2", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a.org/"),
    record("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + PAGE, "3", Content_Type=HTTP, WARC_Target_URI="http://a.org/", WARC_Payload_Digest=f"sha1:{SHA1}"),
    record("response", CHUNKED, "4", Content_Type=HTTP, WARC_Payload_Digest="sha1:" + "A" * 32),
    record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "5", Content_Type=HTTP, WARC_Refers_To="<urn:uuid:3>", WARC_Payload_Digest=f"sha1:{SHA1}"),
    record("metadata", b"", "6"), record("resource", b"\x1f\x8b\x08 no member", "7", Content_Type="image/png", WARC_Payload_Digest="x:y"),
]


def test_standard_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, RECORDS)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS)))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    files = warc.list_archives(spark, f"file://{tmp_path}")
    for split in (1 << 20, 97, 10):
        rows = warc.read_warc(files, split_bytes=split).collect()
        assert len(rows) == 2 * len(RECORDS)
        by = {r.record_id[10:-1]: r for r in rows}
        assert [by[str(k)].record_type for k in range(1, 8)] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource"]
        assert by["3"].payload == PAGE and by["3"].intact and by["3"].payload_digest == hashlib.sha256(PAGE).hexdigest() and by["3"].id is None
        assert by["4"].payload == b"hello world" and by["4"].intact is False
        assert by["5"].payload is None and by["5"].refers_to_id == "<urn:uuid:3>" and by["5"].payload_digest == SHA1
        assert by["6"].payload_bytes == 0 and by["7"].intact is None and by["1"].url is None


def test_control_characters_of_urls():
    found = warc.parse(gzip.decompress(warc.member(1, "http://a/\r\nX: y\x00", b"p", hashlib.sha256(b"p").hexdigest(), None)))
    assert found[0]["url"] == "http://a/%0D%0AX: y%00" and found[0]["payload"] == b"p" and found[0]["intact"]


def test_long_pretokens_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path("byte_bpe_50k.json"), random.Random(6)
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (510, 511, 512, 513, 3000)] + ["a" * 5000, "é" * 700, "=" * 4000, "ab" * 1500]
    assert [x.tolist() for x in own.encode(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(2_000_000))
    began = time.time()
    ids = next(own.encode([long]))
    assert time.time() - began < 120 and own.decode(ids.tolist()) == long
    assert ids[:200].tolist() == library.encode(long[:2000], add_special_tokens=False).ids[:200]
