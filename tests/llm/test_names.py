"""Documents whose own columns have the names that operators use: nothing clashes, also with null ids and empty tables."""

import pytest
from pyspark.sql import functions as F

from anisoframe.llm import bpe, collocations, decontaminate, line_dedup, quality, quality_gam, queries, shingle_join, simhash, suffix_dedup, token_planes

SF = "/root/testdata/sf0.001"
NAMES = (
    "__id __mark __spans __value __word __set __found __n __u __v id mark spans removed root fp fp_of best_id best_mark row rows dedup_id dedup_mark dedup_packed dedup_of dedup_cuts "
    "cut_id cut_mark cut_value set_word set_bits found key n n2 u v s h best first last part file value word count at c total kinds wanted score kept prefix sketch ITEMS Words"
).split()


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 50 != 7, F.col("doc_id")))
    docs = docs.unionByName(docs.where("doc_id IN (3, 4) OR doc_id IS NULL"))
    more = docs.withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})
    return docs.checkpoint(), more.checkpoint(), spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def stages(labels, benchmark):
    return {
        "lines": lambda d: line_dedup.remove_repeated_lines(d, min_words=3, sentences=True, run_words=20).drop("removed", "removed_"), "simhash": simhash.keep_one, "near": shingle_join.keep_one,
        "strings": suffix_dedup.remove_repeats, "quality": lambda d: quality.keep_good(d, labels), "benchmark": lambda d: decontaminate.clean(d, benchmark),
    }


def results(labels, benchmark):
    path = queries.tokenizer_path
    return {
        "op2": simhash.near_duplicates, "op4": lambda d: decontaminate.measure(d, benchmark), "op5": lambda d: quality.judged(d, labels), "op6": suffix_dedup.measure,
        "op9": lambda d: bpe.measure(d, path("byte_bpe_50k.json")), "op10": lambda d: token_planes.round_trip(d, path("word_bpe_49k.json")), "op11": collocations.collocations,
        "op12": lambda d: quality_gam.scores(d, labels),
    }


def same(a, b, columns):
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


@pytest.mark.parametrize("name", ["lines", "simhash", "near", "strings", "quality", "benchmark"])
def test_stages(tables, name):
    docs, more, *others = tables
    stage = stages(*others)[name]
    got = stage(more)
    assert set(NAMES) - {"removed"} <= set(got.columns) and same(got, stage(docs), ["doc_id", "text"])
    assert not got.where(" OR ".join(f"`{n}` <> {k}" for k, n in enumerate(NAMES) if n in got.columns and n != "removed")).count()
    assert stage(more.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op9", "op10", "op11", "op12"])
def test_results(tables, name):
    docs, more, *others = tables
    find = results(*others)[name]
    want = find(docs)
    columns = [c for c in want.columns if c != "root"]
    got = find(more)
    assert got.columns == want.columns and same(got, want, columns)
    assert find(more.limit(0)).collect() == []
