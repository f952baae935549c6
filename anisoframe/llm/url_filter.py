"""URL filter: rules for hosts and paths, and a naive Bayes verdict over segmented words.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins. Where no rule fits,
host and path are cut into words, run-together names by Viterbi over unigram probabilities, and multinomial naive Bayes
weighs the words.

The model is fitted on the pages that are given. Words of all pages' texts and urls are counted (a grouped sum); the
``VOCABULARY`` most frequent make the unigram model, together with the seed words below. A url is taken for a bad one
while fitting if its host, segmented, has a seed word of a bad category. Words of host and path are then counted by class
over all urls, again as grouped sums, and those counts are the Bayes model's: so words that go along with bad names, and
stand in no list, are learned from the data. What goes to tasks is two tables of at most ``VOCABULARY`` words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STRING, small_batches, struct

# Rules as (verdict, host, path), and seed words by category.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD_WORDS = """
casino poker roulette blackjack jackpot slots lottery gambling betting bets wager bingo
viagra cialis pills pharmacy steroids painkillers
porn xxx adult sex sexy nude escort webcam hentai erotic
spam malware phishing virus trojan botnet spyware adware
ads adserver tracker clickbait popunder banners
warez keygen crack torrent pirate
payday ponzi scam giveaway sweepstakes
"""
PLAIN_WORDS = """
about album archive article bank blog book bookstore books buy cheap city club coffee community company contact course
culture data developer digital docs education energy family film food football forum free gallery garden global government
green guide health help history home hotel house index info insurance jobs journal kitchen language learning library life
local magazine mail market math media medical mobile museum music national nature network news office online open page park
people photo podcast post press privacy products public recipes research restaurant review school science search service
shop site social society software sports store stories street student support team tech theatre times tools tour trade train
transport travel university video water weather web wiki world www
"""
#: Most frequent words that the models keep.
VOCABULARY = 100_000
#: Share of all words that the seed words are taken to have, in the segmentation and for either class.
SEEDS = 0.5
#: Smoothing of the classes' counts, how often a word must be seen to say anything, and words that a class has in common with all.
ALPHA, SEEN, LIKE_ALL = 0.02, 3, 10
#: Log odds that a url is bad before its words are read; the share of seed names in the data isn't that of bad ones.
PRIOR = math.log(0.1 / 0.9)
_TOKEN = re.compile(r"[a-z]+")
LETTER = math.log(26)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where no ``://`` is."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def rule_for(host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def site_name(host: str) -> str:
    """The host without its port and top-level domain, which are no words of a name."""
    labels = host.split(":")[0].split(".")
    return ".".join(labels[:-1]) if len(labels) > 1 else host


class Unigrams:
    """Word probabilities, and the most probable words of run-together letters."""

    def __init__(self, counts: Mapping[str, float], kinds: int | None = None):
        """kinds: different words that were seen, if not all are among the counts. So many of all observations were of a
        new word, which is how likely another one is to be new; its letters are as likely as any."""
        total, kinds = sum(counts.values()), len(counts) if kinds is None else kinds
        self.log = {w: math.log(c / (total + kinds + 1)) for w, c in counts.items()}
        self.unknown = math.log((kinds + 1) / (total + kinds + 1))
        self.longest = max(map(len, counts), default=0)

    def cost(self, word: str) -> float:
        """Log probability of a word; one that is not known costs more with every letter."""
        known = self.log.get(word)
        return self.unknown - LETTER * len(word) if known is None else known

    def segment(self, run: str) -> list[str]:
        """The most probable words, of runs of any length in linear time; of equals that with the longest last words."""
        best, back = [0.0], [0]
        open_, begun = -math.inf, 0  # the best that ends here inside a word that is not known, and where that begins
        for end in range(1, len(run) + 1):
            if best[end - 1] + self.unknown > open_:
                open_, begun = best[end - 1] + self.unknown, end - 1
            open_ -= LETTER
            top, start = open_, begun
            for s in range(max(0, end - self.longest), end):
                known = self.log.get(run[s:end])
                if known is not None and best[s] + known > top:
                    top, start = best[s] + known, s
            best.append(top)
            back.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]

    def tokens(self, name: str) -> list[str]:
        """Words of a host or path: runs of letters, segmented."""
        return [w for run in _TOKEN.findall(name.lower()) for w in ([run] if run in self.log else self.segment(run))]


class HostModel:
    """Unigrams and multinomial naive Bayes weights."""

    def __init__(self, words: Mapping[str, int], bad: Mapping[str, int], fine: Mapping[str, int]):
        """words: counts for the segmentation; bad, fine: counts of words in urls of either class."""
        bad_seeds, plain = BAD_WORDS.split(), PLAIN_WORDS.split()
        self.seeds = frozenset(bad_seeds)
        own = max(1.0, SEEDS * sum(words.values()) / len([*bad_seeds, *plain]))
        self.unigrams = Unigrams(dict(words) | {w: max(own, words.get(w, 0)) for w in (*bad_seeds, *plain)})
        # A class's shares are halfway between those of its counts and even ones over its seeds; plain words speak for none.
        learned = {w for w in (*bad, *fine) if len(w) > 1 and bad.get(w, 0) + fine.get(w, 0) >= SEEN}
        known = learned | set(bad_seeds) | set(plain)
        count = lambda c, w: c.get(w, 0) if w in learned else 0
        total = sum(count(bad, w) + count(fine, w) for w in learned) or 1
        # A class with few words is taken to be like all urls, so that words that all of them have say nothing.
        sums = [sum(c.get(w, 0) for w in learned) + LIKE_ALL + ALPHA * len(known) for c in (bad, fine)]
        even = SEEDS / len([*bad_seeds, *plain])

        def share(k: int, w: str, seeds: set[str]) -> float:
            all_ = 0 if w in self.seeds else (count(bad, w) + count(fine, w)) / total  # seed words define their class
            own = count((bad, fine)[k], w) + LIKE_ALL * all_ + ALPHA
            return (1 - SEEDS) * own / sums[k] + even * (w in seeds)

        both, plain = {*bad_seeds, *plain}, set(plain)
        self.weight = {w: math.log(share(0, w, both)) - math.log(share(1, w, plain)) for w in known}
        self.prior = PRIOR
        self.host = lru_cache(maxsize=50_000)(self._host)

    def __reduce__(self):
        return _restored, ({k: v for k, v in self.__dict__.items() if k != "host"},)

    def segment(self, run: str) -> list[str]:
        return self.unigrams.segment(run)

    def _host(self, host: str) -> tuple[tuple[str, ...], float]:
        words = tuple(self.unigrams.tokens(site_name(host)))
        return words, sum(self.weight.get(w, 0.0) for w in words)

    def seeded(self, host: str) -> bool:
        """Whether the host's name has a seed word of a bad category."""
        return not self.seeds.isdisjoint(self.host(host)[0])

    def score(self, host: str, path: str) -> float:
        """Log odds that a url is to be blocked; words that the model does not know say nothing."""
        return self.prior + self.host(host)[1] + sum(self.weight.get(w, 0.0) for w in self.unigrams.tokens(path))


def _restored(state: dict) -> HostModel:
    model = HostModel.__new__(HostModel)
    model.__dict__.update(state)
    model.host = lru_cache(maxsize=50_000)(model._host)
    return model


#: The model of the seed words alone, for urls without a corpus.
MODEL = HostModel({}, {}, {})


def judge(url: str | None, model: HostModel = MODEL) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict) of one url; an empty host is allowed."""
    host, path = split_url(url)
    found = rule_for(host, path)
    if found:
        return host, path, *found
    return host, path, None, "block" if host and model.score(host, path) > 0 else "allow"


def _top(words: DataFrame, count: str) -> DataFrame:
    """The ``VOCABULARY`` most frequent words."""
    return words.orderBy(F.desc(count), "word").limit(VOCABULARY)


def _words(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word")


def fit(pages: DataFrame, url_col: str = "url", text_col: str | None = "html") -> HostModel:
    """A model of all pages: two grouped counts, of which the most frequent words come to the driver.

    Null urls and texts have no words. Repeated rows count as often as they stand there. Without a text column, or with
    an empty table, the unigrams are those of the urls and the seeds, or the seeds alone.
    """
    small_batches(pages.sparkSession)
    texts = [F.col(url_col)] if text_col is None else [F.col(url_col), F.col(text_col)]
    counted = pages.select(_words(F.concat_ws(" ", *texts))).where("length(word) BETWEEN 2 AND 32").groupBy("word").agg(F.count("*").alias("n"))
    words = {r.word: r.n for r in _top(counted, "n").collect()}
    first = HostModel(words, {}, {})

    def look(urls: pa.Array) -> pa.Array:
        rows = []
        for url in urls.to_pylist():
            host, path = split_url(url)
            rows.append({"bad": bool(host) and first.seeded(host), "words": [*first.host(host)[0], *first.unigrams.tokens(path)] if host else []})
        return pa.array(rows, pa.struct([("bad", pa.bool_()), ("words", pa.list_(pa.string()))]))

    rows = pages.select(F.arrow_udf(look, struct(bad=T.BooleanType(), words=T.ArrayType(STRING)))(url_col).alias("u"))
    seen = rows.select("u.bad", F.explode("u.words").alias("word"))
    counted = seen.groupBy("word").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("fine"))
    found = _top(counted.withColumn("n", F.col("bad") + F.col("fine")), "n").collect()
    return HostModel(words, {r.word: r.bad for r in found if r.bad}, {r.word: r.fine for r in found if r.fine})


_RESULT = ("host", "path", "rule", "verdict")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html", model: HostModel | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row, by a model of these pages unless one is given.

    A null url, or one without ``://``, has empty parts and is allowed. Rows of equal id or url stay rows and are judged
    alike; urls of any length are read whole. Other columns are not read, and an empty table gives an empty result.
    """
    model = fit(pages, url_col, text_col if text_col in pages.columns else None) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def look(urls: pa.Array) -> pa.Array:
        columns = list(zip(*(judge(u, shared.value) for u in urls.to_pylist()))) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=_RESULT)

    found = F.arrow_udf(look, struct(host=STRING, path=STRING, rule=STRING, verdict=STRING))(url_col)
    return pages.select(id_col, found.alias("found")).select(id_col, *(f"found.{c}" for c in _RESULT))
