"""Quality rules judged by an isolation forest.

Rule statistics of a text (repeats, symbols, capitals, word lengths and so on) are read by random trees: each splits a
small sample at random values of random statistics, and a document that is set apart after few splits is an anomaly. As the
method has it, each of ``TREES`` trees draws ``SIZE`` rows, of all labelled good ones and few bad ones. All labelled rows are
then scored; the threshold is the one that best tells the bad rows from the good ones while it rejects at most
``FALSE_REJECTS`` of the good. Texts are counted where they are, and only counts are joined with labels; every document is
judged by itself, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BOOL, DOUBLE, LONG, as_bytes, fresh, small_batches, struct, turn
from .files import stored

#: Trees of the forest, and rows that a tree draws.
TREES, SIZE = 100, 128
FALSE_REJECTS = 0.004
#: Scores of labelled rows are counted in so many steps between 0 and 1.
STEPS = 1 << 16
#: Share of bad rows among those that trees are grown on.
BAD_SHARE = 0.03
_SPACE = bytes([32, *range(9, 14)])
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    top = len(known)
    if top < 1 << 21:
        key = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:
        key = np.unique(ids[:-2] * top + ids[1:-1], return_inverse=True)[1] * top + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = np.zeros(len(key), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The five counts of the contract, then lines, capitals, marks '!' and digits."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    spaces = len(text) - len(text.translate(None, _SPACE))
    return (
        len(words), len(text.translate(None, _CONTINUED)) - spaces, len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeat_words(words), len(lines), len(text) - len(text.translate(None, _UPPER)),
        text.count(b"!"), len(text) - len(text.translate(None, b"0123456789")),
    )


_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))


def features(counts: np.ndarray) -> np.ndarray:
    """What trees split on, a row for each row of statistics: by how much a text goes beyond what each rule allows."""
    words, chars, symbols, dup, again, lines, capitals, shouts, digits = counts.T.astype(float)
    per, over = np.maximum(words, 1), lambda x, limit: np.maximum(0, x - limit)
    mean = chars / per
    return np.stack([
        over(mean, 10) + over(3, mean), np.log1p(10 * symbols / per), over(dup / np.maximum(lines, 1), 0.3), over(again / per, 0.3),
        over(capitals / np.maximum(chars, 1), 0.1), np.log1p(10 * shouts / per), over(digits / np.maximum(chars, 1), 0.15),
    ], axis=1)


def _normal(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a search that fails among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


class IsolationForest:
    """Trees as arrays: split column (-1 in a leaf), split value, children, and path length of leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = SIZE, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.size, self.trees = min(size, len(rows)), []
        depth = int(np.ceil(np.log2(max(2, self.size))))
        for _ in range(trees):
            nodes: list[list[float]] = []
            self._grow(rows[rng.choice(len(rows), self.size, replace=False)], 0, depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, rows: np.ndarray, at: int, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if at == depth or len(rows) < 2 or not len(open_):
            nodes.append([-1, 0, 0, 0, at + float(_normal(len(rows)))])
            return me
        k = int(rng.choice(open_))
        value = float(rng.uniform(low[k], high[k]))
        nodes.append([k, value, 0, 0, 0])
        left = self._grow(rows[rows[:, k] < value], at + 1, depth, rng, nodes)
        right = self._grow(rows[rows[:, k] >= value], at + 1, depth, rng, nodes)
        nodes[me][2:4] = left, right
        return me

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; 1 is set apart at once."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in self.trees:
            node, walk = np.zeros(len(rows), np.int64), every
            while len(walk):
                at = tree[node[walk]]
                inner = at[:, 0] >= 0
                walk, at = walk[inner], at[inner]
                left = rows[walk, at[:, 0].astype(np.int64)] < at[:, 1]
                node[walk] = np.where(left, at[:, 2], at[:, 3]).astype(np.int64)
            total += tree[node, 4]
        return 2 ** (-total / max(1, len(self.trees)) / max(1e-9, float(_normal(self.size))))


class Judge:
    """A forest and its threshold; without a forest there are no anomalies."""

    def __init__(self, forest: IsolationForest | None = None, threshold: float = np.inf):
        self.forest, self.threshold = forest, threshold

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(counts):
            return np.zeros(len(counts))
        return self.forest.score(features(counts))

    def anomalous(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = self.scores(counts)
        return scores, scores >= self.threshold


def _table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(b) for b in as_bytes(texts)], np.int64).reshape(-1, 9)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) of every row: the statistics of its text, those of no words for null."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.arrow_udf(_counts, _LONGS)(text_col).alias("counts"))


def _counts(texts: pa.Array) -> pa.Array:
    turn("quality")
    return pa.array(_table(texts).tolist(), pa.list_(pa.int64()))


def scored(judge: Judge):
    """A function of a column of counts to scores."""

    def look(counts: pa.Array) -> pa.Array:
        turn("quality")
        return pa.array(judge.scores(np.asarray(counts.flatten()).reshape(-1, 9)))

    return F.arrow_udf(look, DOUBLE)


def fit(every: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 17) -> Judge:
    """A judge from all labelled rows of ``every`` (``counted``); without good and bad ones it finds no anomalies.

    Trees draw from all good rows, and from bad ones as many as ``BAD_SHARE`` of these: the driver gets about as many rows as
    they draw, by a hash of their id, and the counts of scores. Rows with null id or label, and rows that fail the base rules
    anyway, teach nothing.
    """
    given = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good")).dropna()
    given = given.groupBy("id").agg(F.max("good").alias("good"))
    rows = every.join(given, "id").groupBy("id").agg(F.max("good").alias("good"), F.min("counts").alias("counts"))
    rows = stored(rows.where(~_failed("counts")))
    n = {r.good: r.n for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Judge()
    bad = min(n[False], max(1, int(BAD_SHARE * n[True])))
    drawn = min(1, TREES * SIZE / (n[True] + bad))  # of the good, and of as many bad
    low = lambda share: F.lit(True) if share >= 1 else F.xxhash64(F.lit(seed), "id") < int((share - 0.5) * 2**64)
    few = rows.where((F.col("good") & low(drawn)) | (~F.col("good") & low(drawn * bad / n[False]))).select("counts").collect()  # about ``TREES * SIZE``
    forest = IsolationForest(features(np.array(sorted(r["counts"] for r in few), np.int64).reshape(-1, 9)), seed=seed)
    step = F.floor(scored(Judge(forest))("counts") * STEPS).alias("step")
    tally = rows.select("good", step).groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("step").collect()  # ``STEPS`` + 1 at most
    at = np.array([r.step for r in tally])
    caught, wrong = (np.append(np.cumsum([r[c] for r in tally][::-1])[::-1], 0) / n[c == "good"] for c in ("bad", "good"))
    gain = np.where(wrong <= FALSE_REJECTS, caught - wrong, -1)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))  # never the first, behind which all the good are
    # Between the lowest step rejected and the end of the one below.
    return Judge(forest, (at[best] + at[best - 1] + 1) / 2 / STEPS if best < len(at) else np.inf)


def _failed(counts: str) -> Column:
    """``base_failed`` of a column of counts."""
    words, again = F.col(counts)[0], F.col(counts)[4]
    return (words < 50) | (100 * again > 50 * words)


_LONGS = T.ArrayType(LONG)
JUDGED = struct(n_words=LONG, word_chars=LONG, n_symbols=LONG, n_dup_lines=LONG, n_repeat_words=LONG, base_failed=BOOL, score=DOUBLE, kept=BOOL)


def verdict(judge: Judge):
    """A function of a text column to (counts, base_failed, score, kept). A null text has no words and fails."""

    def look(texts: pa.Array) -> pa.Array:
        turn("quality")
        counts = _table(texts)
        failed = base_failed(counts)
        score, odd = judge.anomalous(counts)
        columns = [*(counts[:, k] for k in range(5)), failed, score, ~failed & ~odd]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=[*_COUNTS, "base_failed", "score", "kept"])

    return F.arrow_udf(look, JUDGED)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, score) of every row.

    A null or empty text has no words and fails the base rules. Texts of any length are read whole, once: their counts are
    written and read again. Repeated rows and ids stay rows, each judged by its own text; of the texts of a labelled id that
    is repeated the one with the smallest counts teaches, so that a run is like the next. Other columns are not read; an
    empty table gives an empty result, and without labels of both kinds only the base rules decide.
    """
    every = stored(counted(docs, id_col, text_col))
    judge = fit(every, labels, id_col)
    rows = every.select("id", "counts", _failed("counts").alias("failed"), scored(judge)("counts").alias("score"))
    kept = ~F.col("failed") & (F.col("score") < F.lit(float(judge.threshold)))
    return rows.select(F.col("id").alias(id_col), *(F.col("counts")[k].alias(c) for k, c in enumerate(_COUNTS)), F.col("failed").alias("base_failed"), kept.alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected. Texts are read twice, since only their counts are shuffled."""
    name = fresh("row", docs.columns)
    judge = fit(counted(docs, id_col, text_col), labels, id_col)
    rows = docs.withColumn(name, verdict(judge)(text_col))
    return rows.where(F.col(name)["kept"]).select(*docs.columns)
