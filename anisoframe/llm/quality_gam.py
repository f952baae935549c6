"""Quality scores of an additive model with pairwise interactions.

Statistics of a whole text are put into bins; the model is a table of one number for each bin of each statistic, and one for
each pair of bins of a few pairs of statistics. A score is the logistic of the sum of what is looked up: additions over
arrays of bins, nothing else. The tables are learnt by boosting in turn: each round takes every statistic once, fits a
shallow tree of its bins to what is still unexplained, and adds a small part of it to the table; then the pairs whose
quarters explain most of the rest are boosted likewise. Learning is on a bounded sample of labelled rows (``SAMPLE``) in the
driver, which gets their bins' counts, never their texts; documents are scored one by one, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, as_bytes, small_batches, struct

#: Labelled rows that the model is learnt from, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: A document is predicted to be good at this score or above.
GOOD = 0.3
#: One row in ``FOLDS`` is held out: those whose id's crc32 it divides.
FOLDS = 5
BINS, PAIR_BINS, PAIRS = 64, 16, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 250, 150, 0.08, 4
#: What is added to a leaf's second derivatives, and the rows that a leaf needs.
CALM, LEAST = 1.0, 8

_UPPER, _CONTINUED, _SPACES = bytes(range(65, 91)), bytes(range(128, 192)), bytes([32, *range(9, 14)])
_SYMBOLS, _DIGITS = b"#*$%&|<>@^~_=+\\{}[]", b"0123456789"
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
NAMES = (
    "words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeats_in_a_row", "capital_words", "symbols", "symbol_words",
    "shouts", "bars", "digits", "capitals", "letters", "stops", "commas", "words_a_line", "repeated_lines", "entropy", "shout_words", "repeated_triples",
)


def statistics(text: bytes) -> list[float]:
    """The numbers of ``NAMES`` of a text; an empty one, and one without words, has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    share = counts / n
    solid = len(text) - sum(map(text.count, (bytes([c]) for c in _SPACES)))
    of = lambda marks: len(text) - len(text.translate(None, marks))
    chars = len(text.translate(None, _CONTINUED + _SPACES))
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:] if len(known) < 1 << 21 else ids
    shouted = sum(map(bytes.isupper, words))
    return [
        float(np.log1p(n)), chars / n, float((sizes > 20).mean()), float((sizes < 3).mean()), len(known) / n, float(share.max()),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, sum(w[:1].isupper() for w in words) / n, of(_SYMBOLS) / solid,
        sum(w.translate(None, _LETTERS + _DIGITS + b".,;:!?'\"()-") != b"" for w in words) / n, text.count(b"!") / n, text.count(b"|") / n,
        of(_DIGITS) / solid, of(_UPPER) / solid, of(_LETTERS) / solid, text.count(b".") / n, text.count(b",") / n, n / len(lines),
        1 - len(set(lines)) / len(lines), float(-(share * np.log(share)).sum()) / max(1.0, float(np.log(n))), shouted / n,
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
    ]


def table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(b) for b in as_bytes(texts)], float).reshape(-1, len(NAMES))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Values at which bins begin: quantiles of the distinct values, so that a common value takes one bin only."""
    own = np.unique(values)
    return own[1:] if len(own) <= bins else np.unique(np.quantile(own, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values of a tree over ordered bins with sums of derivatives g and h and rows n, cut where it gains most."""
    G, H, N = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    parts = [(0, len(g))]
    score = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + CALM)
    while len(parts) < leaves:
        best = (1e-12, None, 0)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            at = at[(N[at] - N[a] >= LEAST) & (N[b] - N[at] >= LEAST)]
            if len(at):
                gain = score(a, at) + score(at, b) - score(a, b)
                top = int(gain.argmax())
                if gain[top] > best[0]:
                    best = (float(gain[top]), k, int(at[top]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + CALM)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of a square of bins into four quarters."""
    G, H, N = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h, n))
    out, best = np.zeros(g.shape), (0.0, None)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not a.size:
        return 0.0, out

    def four(S):
        q = S[a, b]
        return np.stack([q, S[a, -1] - q, S[-1, b] - q, S[-1, -1] - S[a, -1] - S[-1, b] + q])

    qg, qh, qn = four(G), four(H), four(N)
    # Quarters of few rows say nothing.
    gain = np.where(qn >= LEAST, qg**2 / (qh + CALM), 0).sum(axis=0) - G[-1, -1] ** 2 / (H[-1, -1] + CALM)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    best = float(gain[i, j])
    value = np.where(qn[:, i, j] >= LEAST, -qg[:, i, j] / (qh[:, i, j] + CALM), 0)
    x, y = int(a[i, j]), int(b[i, j])
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = value
    return best, out


@dataclass
class Model:
    """Tables of bins. Without rows of both labels every score is ``prior``."""

    prior: float = 0.5
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(rows), self.prior)
        total = np.full(len(rows), self.base)
        for k, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, rows[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], rows[:, k], side="right") for k in {x for i, j, _ in self.pairs for x in (i, j)}}
        for i, j, values in self.pairs:
            total += values[coarse[i], coarse[j]]
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(rows: np.ndarray, good: np.ndarray) -> Model:
    """The model of rows of statistics and whether each is good. Equal input gives an equal model."""
    if not len(rows) or good.all() or not good.any():
        return Model(prior=0.5 if not len(rows) else float((good.sum() + 1) / (len(good) + 2)))
    m = Model(base=float(np.log(good.mean() / (1 - good.mean()))))
    m.cuts, m.pair_cuts = ([_cuts(rows[:, k], bins) for k in range(rows.shape[1])] for bins in (BINS, PAIR_BINS))
    at = [np.searchsorted(c, rows[:, k], side="right") for k, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    total = np.full(len(rows), m.base)
    held = [np.bincount(b, minlength=len(t)) for b, t in zip(at, m.tables)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(total)
        return p - good, p * (1 - p)

    for _ in range(ROUNDS):
        for k, (bins, values) in enumerate(zip(at, m.tables)):
            if len(values) < 2:
                continue
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins, g, len(values)), np.bincount(bins, h, len(values)), held[k])
            values += step
            total += step[bins]
    at = [np.searchsorted(c, rows[:, k], side="right") for k, c in enumerate(m.pair_cuts)]

    def squares(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        shape = (len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1)
        flat = at[i] * shape[1] + at[j]
        return tuple(np.bincount(flat, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(g))))

    g, h = slopes()
    gains = sorted(((-_quarters(*squares(i, j, g, h))[0], i, j) for i in range(len(at)) for j in range(i)))
    m.pairs = [(i, j, np.zeros((len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in m.pairs:
            step = RATE * _quarters(*squares(i, j, *slopes()))[1]
            values += step
            total += step[at[i], at[j]]
    return m


def held_out(id_col: str | Column) -> Column:
    """Whether a row is never learnt from; of an id that is null too."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows that are not held out.

    Null ids and labels teach nothing, nor do ids that have as many labels of one kind as of the other; of a repeated id's
    texts that with the smallest statistics teaches.
    """
    small_batches(docs.sparkSession)
    given = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("double").alias("good")).dropna().where(~held_out("id"))
    given = given.groupBy("id").agg(F.avg("good").alias("good")).where(F.col("good") != 0.5).orderBy(F.xxhash64("id"), "id").limit(sample)
    known = {r["id"]: r["good"] > 0.5 for r in given.collect()}  # bounded by ``sample``
    if not known:
        return Model()
    ids = docs.sparkSession.createDataFrame([(k,) for k in known], T.StructType([T.StructField("id", docs.schema[id_col].dataType)]))
    look = F.arrow_udf(lambda texts: pa.array(table(texts).tolist(), pa.list_(pa.float64())), T.ArrayType(DOUBLE))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.select("id", look("text").alias("s")).groupBy("id").agg(F.min("s").alias("s")).collect()  # a row for each id
    rows.sort(key=lambda r: str(r["id"]))
    return learn(np.array([r["s"] for r in rows], float).reshape(-1, len(NAMES)), np.array([known[r["id"]] for r in rows], bool))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every row: how likely its text is good, from its text alone.

    A null text is an empty one and gets the score of a text without words. Texts of any length are read whole. Equal texts
    get equal scores, repeated rows and ids stay rows. Other columns are not read. Without labels of both kinds the score
    is the same for all rows (a half without any); an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    look = F.arrow_udf(lambda texts: pa.StructArray.from_arrays([pa.array(model.score(table(texts)))], names=["score"]), struct(score=DOUBLE))
    rows = docs.select(id_col, held_out(id_col).alias("h"), look(text_col).alias("s"))
    return rows.select(F.col(id_col), F.col("h").alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= GOOD).cast("int").alias("predicted"))
