"""Line dedup against the full rule (of equal lines only the first stays, however few words it has), and op1_line_dedup
against its own: sentences of three words or more, in runs of repeated ones of twenty words or more."""

import re

from pyspark.sql import functions as F

from anisoframe.llm import line_dedup, queries

ROWS = [
    (1, "All rights reserved.\n\none\ntwo words\nkept once\none"), (2, "all  rights RESERVED.\n \n\nother line"), (3, None), (4, "\n\n"),
    (5, "一行没有空格的中文文本\nOne"), (6, "一行没有空格的中文文本\nlast"), (7, "Two Words"),
]
LONG = "The first sentence has exactly nine words in it. No! A second one follows here with some more words. And a third one ends it."
SENTENCES = [
    (11, LONG), (12, f"Own start here. {LONG.upper()} own end\nall rights are reserved. "), (13, f"cut {LONG[4:]}"), (13, f"cut {LONG[4:]}"), (14, "all rights are reserved."),
    (None, LONG), (None, LONG + " Another tail."), (15, None), (16, ""), (17, "word. " * 90), (18, "three words here. " * 40), (19, "x" * 70_000 + " y z. " + LONG),
]


def table(spark, tmp_path, made):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    spark.createDataFrame(made, "doc_id long, text string").unionByName(real).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_short_lines(spark, tmp_path):
    docs = table(spark, tmp_path, ROWS)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    seen, want = set(), {}
    for i, text in rows:
        keep = []
        for line in (text or "").split("\n"):
            key = " ".join(line.casefold().split())
            if not key or key not in seen:
                keep.append(line)
            seen.add(key)
        want[i] = (None if text is None else "\n".join(keep), len((text or "").split("\n")) - len(keep))
    got = {r.doc_id: (r.text, len(r.removed)) for r in line_dedup.remove_repeated_lines(docs, min_words=1).collect()}
    assert got == want
    assert got[2] == (" \n\nother line", 1) and got[6] == ("last", 1) and got[7] == ("", 1)


def plain(rows):
    """Every text without the runs; rows equal in id and text are one document."""
    documents = sorted({(i is None, i or 0, t or "") for i, t in rows})
    cut = [[(a, b, tuple(t[a:b].casefold().split())) for a, b in spans(t)] for *_, t in documents]
    first, out = {}, {}
    order = sorted(range(len(documents)), key=lambda k: documents[k][:2])
    for k in order:
        for a, _, w in cut[k]:
            first.setdefault(w, set()).add(documents[k][:2])
    seen = set()
    for k in order:
        runs, run = [], []
        for a, b, w in cut[k]:
            if len(w) < 3:
                continue
            if w in seen:
                run.append((a, b, len(w)))
            else:
                runs, run = [*runs, run], []
            seen.add(w)
        gone = [(a, b) for r in [*runs, run] if sum(x[2] for x in r) >= 20 for a, b, _ in r]
        text, at = "", 0
        for a, b in gone:
            text, at = text + documents[k][2][at:a], b
        out[documents[k]] = (text + documents[k][2][at:], sum(b - a for a, b in gone), len(gone))
    return out


def spans(text):
    at, out = 0, []
    for m in re.finditer(r"\n|[.!?…]+[\"')\]»”’]*\s+|[。！？]+\s*", text):
        out.append((at, m.end()))
        at = m.end()
    return [*out, (at, len(text))]


def test_sentences(spark, tmp_path):
    docs = table(spark, tmp_path, SENTENCES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows)
    got = queries.op1_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    # Of the rows without id, and of those of equal id, which text comes first is decided by its hash.
    tied = {None, 13}
    assert sorted((r.doc_id, r.text or "", r.n_removed, r.n_units) for r in got if r.doc_id not in tied) == sorted((i, *want[(False, i, t or "")]) for i, t in rows if i not in tied)
    by = {r.doc_id: r for r in got}
    assert by[12].text == "Own start here. NO! own end\nall rights are reserved. " and by[14].n_removed == 0 and by[15].text is None
    assert by[11].n_removed == 0 and by[17].n_removed == 0 and by[18].text == "three words here. " and by[19].text == "x" * 70_000 + " y z. No! "
    assert [r.text for r in got if r.doc_id is None and r.n_units == 3] != []
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.removed)
    assert queries.line_dedup.remove_repeated_lines(docs.where("false"), sentences=True, run_words=20).count() == 0
