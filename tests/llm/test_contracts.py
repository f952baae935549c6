"""Every query against a plain version of its contract, over hand-made rows and the smallest test tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anisoframe.llm import bpe, decontaminate, html_extract, line_dedup, quality, queries, simhash, suffix_dedup, token_planes, url_filter, warc

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINE = "the quick brown fox jumps over the lazy dog and runs on."
TEXTS = [
    (1, LINE + "\nshort one\n" + LINE), (2, None), (3, ""), (4, " \n\t "), (5, "  The QUICK brown   fox jumps over the lazy dog and runs on.\nother words of my own here"),
    (6, "a\x1cb \x85 c　d <|endoftext|> e\u0301 É don't 12३"), (7, "word " * 4000), (8, "x" * 9000), (8, "x" * 9000), (8, "same id, other text, a few more words"),
    (None, "a row without an id but with words"), (9, "ÄÖÜ ß été " * 90 + "#*$%&|<>" * 3), (10, "UPPER CASE!! " * 60),
    (11, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(60))),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Hand-made and test rows, with columns whose names clash with those the operators make."""
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    rows = made.unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100))
    return rows.withColumns({c: F.lit(1) for c in ("spans", "fp", "row", "found", "kept", "removed", "id", "component_id")}).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def pages(spark):
    made = [(1001, None, None), (1002, "no host", ""), (1003, "HTTP://WWW.Casino-Win.EXAMPLE.org/a?b=/fr/", "<p>" + "same payload " * 20), (1004, "x://a.org/fr/z#q", "<p>" + "same payload " * 20), (None, "https://h", "tiny"), (1005, "https://h:8/p", "tiny"), (1005, "ftp://b.net?x", "é" * 60)]
    return spark.createDataFrame(made, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet")).withColumns({c: F.lit(1) for c in ("id", "text", "found", "size", "first")})


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(df, want):
    assert ordered(map(tuple, df.collect())) == ordered(want)


def test_lines(docs, rows):
    first = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            key = " ".join(line.casefold().split())
            if len(key.split()) >= 5:
                place = (i is None, i or 0, no)
                first[key] = min(first.get(key, place), place)
    got = line_dedup.remove_repeated_lines(docs)
    assert "removed_" in got.columns and got.count() == len(rows)
    seen = Counter()
    for r in got.select("doc_id", "text", "removed_").collect():
        seen[r.doc_id] += 1
        if r.text is None or Counter(i for i, _ in rows)[r.doc_id] > 1:
            continue
        original = dict(rows)[r.doc_id]
        gone = {original[s.start : s.end] for s in r["removed_"] or []}
        keep = []
        for no, line in enumerate(original.split("\n")):
            key = " ".join(line.casefold().split())
            if len(key.split()) < 5 or first[key] == (r.doc_id is None, r.doc_id or 0, no):
                keep.append(line)
            else:
                assert line in gone
        assert r.text == "\n".join(keep)
    assert seen == Counter(i for i, _ in rows)


def test_decontamination(spark, docs, rows):
    made = [(1, " ".join(f"w{i}" for i in range(20, 36))), (1, " ".join(f"w{i}" for i in range(20, 36))), (2, "QUICK, brown fox!"), (3, None), (4, " .. "), (10, "word " * 13), (5, "Ääß nowhere")]
    items = spark.createDataFrame(made, "item_id long, text string").unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("item_id", F.col("item_id") + 50))
    windows = []
    for item, text in items.collect():
        w = WORD.findall(lower(text or ""))
        windows += [(str(item), tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12) if w else 0)]
    want = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        places = {}
        for k in range(len(w)):
            places.setdefault(w[k], []).append(k)
        for item, window in windows:
            for k in places.get(window[0], []):
                if tuple(w[k : k + len(window)]) == window:
                    found.add(item)
                    hit[k : k + len(window)] = [True] * len(window)
        n = sum(hit)
        want.append((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    assert any(x[5] for x in want)
    same(decontaminate.measure(docs, items), want)
    same(decontaminate.measure(docs, items, block=200), want)  # in many blocks
    same(decontaminate.measure(docs, items.where("false")), [(i, n, 0, 0, hashlib.sha256(b"").hexdigest(), False) for i, n, *_ in want])
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    for r in decontaminate.removal_spans(docs.where("doc_id = 1"), items).collect():
        assert [TEXTS[0][1][s.start : s.end] for s in r.spans] == ["quick brown fox"] * 2


def test_quality(spark, docs, rows):
    want = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    got = quality.judged(docs, labels)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)
    assert got.where("base_failed AND kept").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    none = quality.judged(docs, labels.where("false"))
    assert none.where("kept <> (NOT base_failed)").count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    taught, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.judged(docs, taught).where("NOT base_failed").join(held, "doc_id")
    share = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.1


def test_pages(pages):
    same(html_extract.extract(pages.where("page_id > 1000")).select("page_id", "text"), [(1001, ""), (1002, ""), (1003, ("same payload " * 20).strip()), (1004, ("same payload " * 20).strip()), (1005, "tiny"), (1005, "é" * 60)])
    page = """<html><head><title>t</title></head><body><header>top</header><div class="cookie-notice">We use cookies.</div>
    <nav><a>Home</a></nav><aside>side, bar. here.</aside><main><article><h1>Head &amp; line</h1><p>One <b>bold</b>&nbsp;word, and more text. Yes!<p>Two<br>lines
    <ul><li>first<li>second</ul><form><p>Name? Mail? Send, please.</p></form><script>if (a<b) "</p>"</script><p>Last.</p>
    <section id="comments"><p>Great, great, great article! Thanks.</p></section></article></main><footer>&copy; me</footer></body>"""
    assert html_extract.main_text(page) == "Head & line\nOne bold word, and more text. Yes!\nTwo lines\nfirst\nsecond\nLast."
    assert html_extract.main_text("<div class=ad>Buy, now!</div><div><p>Plain text, without an article. Really.</p><p>More.</p></div>") == "Plain text, without an article. Really.\nMore."


def test_urls(pages):
    got = {r.page_id: r for r in url_filter.judged(pages).where("page_id > 1000").collect()}
    assert got[1001][1:] == ("", "", None, "allow") and got[1002][1:] == ("", "", None, "allow")
    assert got[1003][1:] == ("www.casino-win.example.org", "/a", None, "block")
    assert got[1004][1:] == ("a.org", "/fr/z", "org/fr/", "allow")
    cases = {"http://x.example.net/en/1": ("example.net/en/", "allow"), "http://example.net/de/": ("net/", "block"), "http://a.example.com/de/": ("example.com/de/", "block"), "http://notexample.com/de/": (None, "allow"), "http://net/": ("net/", "block"), "http://net": (None, "allow")}
    for url, want in cases.items():
        assert url_filter.judge(url)[2:] == want
    assert url_filter.MODEL.segment("cheappillsonline") == ["cheap", "pills", "online"]


@pytest.mark.parametrize("split", [1 << 20, 3000])
def test_warc(pages, split, tmp_path):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    want = []
    for i, p in rows:
        again = len(p) >= 100 and i is not None and i != first[p]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    files = warc.write_warc(pages, f"file://{tmp_path}/a")
    got = warc.read_warc(files, split_bytes=split)
    same(got.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to"), want)
    listed = warc.list_archives(pages.sparkSession, f"file://{tmp_path}/a")
    assert warc.read_warc(listed).where("payload IS NOT NULL").count() == sum(x[3] == "response" for x in want)


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, want = Tokenizer.from_file(path), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe.measure(docs, path), want)
    back = docs.select("text", bpe.decoder(path)(bpe.encoder(path)("text")).alias("back"))
    assert back.where("coalesce(text, '') <> back").count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes(docs, rows, bits, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, want, start = Tokenizer.from_file(path), {}, 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    got = token_planes.round_trip(docs, path, bits=bits).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert list(found) == sorted(found, key=lambda i: (i is not None, i or 0))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_planes_access(tmp_path):
    import numpy as np
    from pyarrow import fs

    local, rng = fs.LocalFileSystem(), np.random.default_rng(1)
    rows = [rng.integers(0, 2**32, n, np.uint32) for n in (5, 0, 70, 64, 1, 200, 3)]
    for bits in (False, True):
        out = token_planes.Writer(local.open_output_stream(f"{tmp_path}/x"), block=32, bits=bits)
        for i, ids in enumerate(rows):
            out.add(i, ids)
        out.close()
        with local.open_input_file(f"{tmp_path}/x") as handle:
            for first in range(len(rows)):
                got = list(token_planes.Reader(handle).documents(first))
                assert [i for i, _ in got] == list(range(first, len(rows)))
                assert all((a == b).all() for (_, a), b in zip(got, rows[first:]))


def test_empty_tables(spark, docs, pages):
    none, no_pages = docs.where("false"), pages.where("false")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    words, byte = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    for df in (line_dedup.remove_repeated_lines(none), decontaminate.measure(none, items), quality.judged(none, labels), html_extract.extract(no_pages), url_filter.judged(no_pages), warc.round_trip(no_pages), bpe.measure(none, byte), token_planes.round_trip(none, words)):
        assert df.count() == 0


def test_stages_take_hand_made_rows(docs):
    """Every stage keeps its columns, and its decisions are those of its operator."""
    session = docs.sparkSession
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("spans"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(session, plain, SF)
        assert out.columns == plain.columns, name
        out.count()
    assert simhash.keep_one(plain).count() == simhash.near_duplicates(plain).select("root").distinct().count()
    cut = {(r.doc_id, r.n_chars) for r in suffix_dedup.remove_repeats(plain).collect()}
    assert (8, 0) in cut and (3, 0) in cut


def five_words(text):
    words = lower(text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kept = {r.doc_id for r in quality.judged(docs, labels).where("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    sets = {i: five_words(t) for i, t in rows.items()}
    label = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    rows = {i: rows[i].encode() for i in set(label.values())}
    starts = Counter(d[o : o + 200] for d in rows.values() for o in range(len(d) - 199))
    for i, d in rows.items():
        gone = set()
        for o in range(len(d) - 199):
            if starts[d[o : o + 200]] > 1:
                gone.update(range(o, o + 200))
        rows[i] = bytes(c for k, c in enumerate(d) if k not in gone).decode("utf-8", "ignore")
    left = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    clean = {r.doc_id for r in decontaminate.measure(left, items).where("NOT contaminated").collect()}
    assert {r.doc_id for r in got.collect()} == clean
    same(got, [tuple(r) for r in bpe.measure(left, queries.tokenizer_path("byte_bpe_50k.json")).collect() if r.doc_id in clean])
