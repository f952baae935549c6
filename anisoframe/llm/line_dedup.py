"""Substring dedup by hashing lines, or the sentences of lines.

Every unit is normalised (case and white space) and digested to 128 bits; digests are grouped over the corpus, and of
equal units only the first, by id and then by place in the text, stays. A unit may be made to go only in a run: units
that follow each other in a text, are all repeated, and have enough words together. So a passage that was copied into
another line is found, and a short phrase that everyone uses stays. The spans that go keep their offsets in the original
text.

Digests are counted first, with partial sums before the shuffle. A bit set of those that repeat keeps nearly all other
units from being shuffled again; what passes is written once and used for both the grouped minimum and the join. Digests
with more than a thousandth of these rows meet their first place by broadcast, so a line that stands in a third of all
documents is no hot spot. Texts without a repeat aren't shuffled.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, Members, checkpointed, fresh, join_hot, small_batches, struct
from .files import new_folder

#: Lines of fewer words are left alone where a caller names no other number; 1 exempts blank lines only.
MIN_WORDS = 5
_UNIT = struct(no=LONG, start=LONG, end=LONG, words=LONG, high=LONG, low=LONG)
_END = re.compile(r"[.!?…]+[\"')\]»”’]*\s+|[。！？]+\s*|\n")


def _cut(text: str, sentences: bool) -> list[tuple[int, int]]:
    """Spans of the units: lines without their line break, or sentences with what follows them up to the next."""
    if not sentences:
        ends = accumulate(len(x) + 1 for x in text.split("\n"))
        return [(e - len(x) - 1, e - 1) for x, e in zip(text.split("\n"), ends)]
    cuts = [0, *(m.end() for m in _END.finditer(text))]
    return list(zip(cuts, [*cuts[1:], len(text)]))


def units_of(text: str | None, min_words: int = MIN_WORDS, sentences: bool = False) -> list[tuple[int, ...]]:
    """The units of a text that have enough words: number (among these for sentences, among all for lines), character
    offsets, words, and a digest of what is said."""
    out, text, k = [], text or "", 0
    for no, (start, end) in enumerate(_cut(text, sentences)):
        words = text[start:end].casefold().split()
        if words and len(words) >= min_words:
            digest = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
            out.append((k if sentences else no, start, end, len(words), *np.frombuffer(digest, ">i8").tolist()))
            k += 1
    return out


def _units(text_col: str, min_words: int, sentences: bool) -> Column:
    names = [f.name for f in _UNIT]

    def look(texts: pa.Array) -> pa.Array:
        found = [units_of(t, min_words, sentences) for t in texts.to_pylist()]
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, len(names))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=names))

    return F.arrow_udf(look, T.ArrayType(_UNIT))(text_col)


def in_runs(spans: list[dict], run_words: int) -> list[dict]:
    """The spans, ascending, that stand in runs of following units with at least ``run_words`` words."""
    out, run = [], []
    for s in [*spans, None]:
        if run and (s is None or s["no"] != run[-1]["no"] + 1):
            if sum(x["words"] for x in run) >= run_words:
                out += run
            run = []
        run.append(s)
    return out


def without(text: str, spans: list[dict], sentences: bool) -> str:
    """The text without the spans; a line goes with its line break."""
    gone = {s["start"] for s in spans}
    if not gone:
        return text
    return ("" if sentences else "\n").join(text[a:b] for a, b in _cut(text, sentences) if a not in gone)


def _applied(sentences: bool, run_words: int, kind: T.DataType):
    spans_type = T.ArrayType(T.StructType([T.StructField(c, LONG) for c in ("no", "start", "end", "words")] + [T.StructField("first_id", kind), T.StructField("first_no", LONG)]))

    def look(texts: pa.Array, spans: pa.Array) -> pa.Array:
        gone = [in_runs(s, run_words) if s else [] for s in spans.to_pylist()]
        kept = [t if t is None else without(t, g, sentences) for t, g in zip(texts.to_pylist(), gone)]
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, spans.type)], names=["text", "spans"])

    return F.arrow_udf(look, T.StructType([T.StructField("text", STRING), T.StructField("spans", spans_type)])), spans_type


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, sentences: bool = False) -> DataFrame:
    """(id, mark, spans): the units of each text, of ``min_words`` or more, that stand earlier in the corpus, with where the first one stands.

    mark: xxhash64 of the text; rows equal in id and text are one document here. Null ids rank last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.explode(_units(text_col, min_words, sentences)).alias("u")).select("id", "mark", "u.*")
    again = checkpointed(rows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1"))
    folder = new_folder(spark, "units")
    Members(again, "low").those_in(rows, "low").write.parquet(folder)
    rows = spark.read.parquet(folder)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "no")
    first = rows.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n"))
    first = checkpointed(first.where("first <> last").select("high", "low", "first", "n"))
    met = join_hot(rows, first, ["high", "low"], rows.count())
    span = F.struct("no", "start", "end", "words", F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no"))
    return met.where(rank != F.col("first")).groupBy("id", "mark").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: str = "removed", min_words: int = MIN_WORDS, sentences: bool = False, run_words: int = 0
) -> DataFrame:
    """``docs`` with repeated units taken out of the text, and a column of the removed spans at their original offsets.

    sentences: units are the sentences of lines, not lines. Units of fewer than ``min_words`` words are left alone; with
    1, every one that isn't blank counts. run_words: only runs of repeated units with so many words together go; among
    sentences those too short to count don't break a run.

    A null text stays null, an empty one empty; ids that are null rank last; of rows equal in id and text all keep what
    one would; a text of any length is read whole. An empty table gives an empty result. The column of spans is named anew
    if ``docs`` has it, and is empty where nothing goes.
    """
    spans = fresh(spans, docs.columns)
    mark, of, own, cuts = (fresh(c, [*docs.columns, spans]) for c in ("dedup_mark", "dedup_id", "dedup_of", "dedup_cuts"))
    found = checkpointed(repeated_units(docs, id_col, text_col, min_words, sentences).select(F.col("id").alias(of), F.col("mark").alias(own), F.col("spans").alias(cuts)))
    apply, kind = _applied(sentences, run_words, docs.schema[id_col].dataType)
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    among = Members(found.select(own).distinct(), own)
    plain = among.those_out(marked, mark).drop(mark).withColumn(spans, F.array().cast(kind))
    on = F.col(id_col).eqNullSafe(F.col(of)) & (F.col(mark) == F.col(own))
    held = among.those_in(marked, mark).join(found, on, "left").withColumn(mark, apply(F.col(text_col), F.col(cuts)))
    held = held.withColumns({text_col: F.col(mark)["text"], spans: F.col(mark)["spans"]}).select(*docs.columns, spans)
    return plain.unionByName(held)
