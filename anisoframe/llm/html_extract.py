"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each under the path of tags that leads to it. Length and punctuation are summed per
path; a path's ratios are those sums per block. The ratios of the blocks, in page order, are smoothed with a Gaussian,
fused with the share of text outside links and with what names say into one score, averaged over each path, and cut at a
threshold: paths above it are content, and their blocks content nodes. The article is the element that holds their score:
the best ``article`` or ``main`` element, or else the innermost one that has nearly all of it.

The article's text is all of its blocks but for those of page furniture. Elements whose tag or name is plain about that
(menus, forms, comments, adverts) go. Where a name only hints at it ("notice", "post-header") the path's score decides:
such an element goes if its path is below the threshold. Other short blocks, such as headings, stay with the content
around them, since the text of an article is to be whole.

A page is read in one pass, in time that is linear in its length: each element knows its parent, and sums over elements go
from the last one to the first.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, STRING, small_batches, struct

# Element names of HTML and words that name page furniture in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
FURNITURE_TAGS = frozenset("nav aside footer form button select dialog menu head svg canvas object audio video".split())
FURNITURE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar form".split())
#: Names that say plainly what an element is, alone or with others of either list ("cookie-notice").
PLAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs "
    "footer sidebar aside comment comments commentlist disqus respond cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription share sharing pagination pager masthead toolbar login signup".split()
)
#: Names that hint at it.
HINT_WORDS = frozenset(
    "banner promo promotion header notice notices discussion reply replies social related recommended widget search "
    "disclaimer".split()
)
#: What a name may add to a plain word ("site-footer", "comment-list"); other additions make it another name.
EXTRA_WORDS = frozenset("site page main top bottom left right list area section block box bar wrapper container inner outer slot unit form links item".split())
STRUCTURE = frozenset("html body div section main article table tbody tr td center".split())
_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?<![^\s\"'])(?:hidden(?=[\s/]|$)|hidden\s*=|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_PART = re.compile(r"[a-z]+")
_MARKS = dict.fromkeys(map(ord, ".,;:!?…。，、；：！？"))
SMOOTH = 1
#: Paths count as content from this share of the standard deviation of all scores.
THRESHOLD = 0.8
#: An element holds the article if it has this share of all content.
NEARLY = 0.9
NONE, HINT, PLAIN = 0, 1, 2


def furniture(tag: str, attributes: str, inside_article: bool) -> int:
    """Whether tag and names make an element furniture: plainly, by a hint, or not."""
    if tag in FURNITURE_TAGS or tag == "header" and not inside_article:
        return PLAIN
    if not attributes or tag in ("html", "body", "article", "main"):
        return NONE
    if _HIDDEN.search(attributes):
        return PLAIN
    found = NONE
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if m[1].lower() == "role":
                found = max(found, PLAIN if name in FURNITURE_ROLES else NONE)
                continue
            parts = _PART.findall(name)
            if not parts:
                continue
            plain, hint = sum(p in PLAIN_WORDS for p in parts), sum(p in HINT_WORDS for p in parts)
            if plain and plain + hint + sum(p in EXTRA_WORDS for p in parts) == len(parts):
                return PLAIN
            if hint and parts[-1] in HINT_WORDS or plain and parts[-1] in PLAIN_WORDS and parts[0] not in ("no", "has", "with", "without"):
                found = max(found, HINT)
    return found


class Page:
    """Blocks of text in page order, with the innermost block element of each; elements with parent, tag and path."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.element: list[int] = []
        self.links: list[float] = []
        self.parent, self.tag, self.path, self.suspect = [0], [""], [0], [NONE]
        self.paths: dict[tuple[int, str], int] = {(0, ""): 0}
        self._stack, self._open, self._held, self._begun, self._linked = [0], Counter(), [], None, 0
        self._read(page)

    def _flush(self) -> None:
        if self._held:
            text = " ".join(html.unescape("".join(self._held)).split())
            if text and self._begun is not None:
                self.texts.append(text)
                self.element.append(self._begun)
                self.links.append(min(1.0, self._linked / len(text)))
            self._held.clear()
            self._begun, self._linked = None, 0

    def _add(self, text: str) -> None:
        if text:
            if self._begun is None and not text.isspace():
                self._begun = self._stack[-1]
            if self._open["a"]:
                self._linked += len(text)
            self._held.append(text)

    def _close(self, to: int) -> None:
        gone = self._stack[to:]
        if any(self.tag[e] not in INLINE for e in gone):
            self._flush()
        self._open.subtract(self.tag[e] for e in gone)
        del self._stack[to:]

    def _close_first(self, wanted: set[str], scope: set[str] | None) -> None:
        """Close the innermost open element of the wanted tags, unless one that bounds it comes first."""
        if any(self._open[t] > 0 for t in wanted):
            for i in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[i]]
                if tag in wanted:
                    self._close(i)
                    return
                if tag in scope if scope is not None else tag not in INLINE:
                    return

    def _begin(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P:
            self._close_first({"p"}, None)
        if tag in SAME:
            self._close_first(SAME[tag], SCOPE[tag])
        if tag in VOID or tag in INLINE and attributes.rstrip().endswith("/"):
            return
        above = self._stack[-1]
        suspect = furniture(tag, attributes, self._open["article"] > 0 or self._open["main"] > 0)
        if suspect and tag in INLINE:
            self._flush()
        self.parent.append(above)
        self.tag.append(tag)
        self.suspect.append(max(suspect, self.suspect[above]))
        self.path.append(self.path[above] if tag in INLINE else self.paths.setdefault((self.path[above], tag), len(self.paths)))
        self._stack.append(len(self.tag) - 1)
        self._open[tag] += 1

    def _tag_end(self, page: str, at: int) -> int:
        """Where the tag that is read at ``at`` ends: the next > outside quotes; a quote that is never closed is none."""
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            close = page.find(page[at], at + 1) if not self._unclosed[page[at]] else -1
            if close < 0:
                self._unclosed[page[at]] = True
            at = max(at, close) + 1

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        self._unclosed = {'"': False, "'": False}
        low = None
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self._add(page[at:])
                break
            self._add(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                at = size if end < 0 else end + 3
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
                continue
            closing = page.startswith("/", start + 1)
            name = _OPEN.match(page, start + 1 + closing)
            if name is None:
                self._add("<")
                at = start + 1
                continue
            end = self._tag_end(page, name.end())
            if end < 0:  # no tag ends from here on: the rest is text
                self._add(page[start:])
                break
            at, tag = end + 1, name[0].lower()
            if closing:
                if self._open[tag] > 0:
                    i = len(self._stack) - 1
                    while self.tag[self._stack[i]] != tag:
                        i -= 1
                    self._close(i)
                elif tag not in INLINE:
                    self._flush()
            elif tag in ("br", "img"):
                self._add(" ")
            elif tag in RAW:
                low = page.lower() if low is None else low
                # Lower case may be longer than the page; then the tag is looked for as it is written.
                low = page if len(low) != size else low
                found = low.find(f"</{tag}", at)
                end = page.find(">", found) if found >= 0 else -1
                at = size if end < 0 else end + 1
            elif tag != "wbr":
                self._begin(tag, page[name.end() : end])
        self._flush()

    def path_scores(self) -> np.ndarray:
        """A score for each block: that of its path, from smoothed length and punctuation ratios, links and names."""
        n = len(self.texts)
        if not n:
            return np.zeros(0)
        suspect = np.array([self.suspect[e] for e in self.element])
        path = np.array([self.path[e] for e in self.element])
        # Elements whose names only hint at furniture form paths of their own.
        path = np.unique(path * 3 + suspect, return_inverse=True)[1]
        raw = np.array([(len(t), len(t) - len(t.translate(_MARKS))) for t in self.texts], float)
        count = np.bincount(path)
        ratio = np.stack([(np.bincount(path, r) / count)[path] for r in raw.T], axis=1)
        ratio[suspect == PLAIN] = 0
        reach = np.arange(-2 * SMOOTH, 2 * SMOOTH + 1)
        kernel = np.exp(-(reach**2) / (2 * SMOOTH**2))
        kernel /= kernel.sum()
        smooth = np.stack([np.convolve(np.pad(r, 2 * SMOOTH), kernel, "valid") for r in ratio.T], axis=1)
        score = smooth[:, 0] * (1 + smooth[:, 1]) * (1 - np.array(self.links))
        score[suspect == PLAIN] = 0
        return (np.bincount(path, score) / count)[path]

    def main_text(self) -> str:
        """The article, a block to a line; empty where no block has a score."""
        score = self.path_scores()
        if not score.any():
            return ""
        content = score >= min(THRESHOLD * score.std(), score.max())
        total = np.zeros(len(self.tag))
        np.add.at(total, self.element, np.where(content, score, 0))
        total = total.tolist()
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        named = [e for e, t in enumerate(self.tag) if t in ("article", "main") and total[e] > 0]
        best = max(named, key=lambda e: (total[e], e)) if named else 0
        # Within a main element, or without one, go down while one element has nearly all that counts.
        inner: dict[int, int] = {}
        for e in range(1, len(total)):
            up = self.parent[e]
            if self.tag[e] in STRUCTURE and total[e] > total[inner.get(up, e)] * (up in inner):
                inner[up] = e
        while self.tag[best] != "article" and best in inner and total[inner[best]] >= NEARLY * total[best]:
            if named and self.tag[best] == "main" and self.tag[inner[best]] != "article":
                break
            best = inner[best]
        inside = [False] * len(total)
        for e in range(len(total)):
            inside[e] = e == best or e > 0 and inside[self.parent[e]]
        # What stands above the article says nothing about its blocks.
        outer = self.suspect[best] if best else NONE
        keep = [inside[e] and (self.suspect[e] != PLAIN or outer == PLAIN) and (self.suspect[e] != HINT or outer == HINT or c) for e, c in zip(self.element, content.tolist())]
        return "\n".join(t for t, k in zip(self.texts, keep) if k)


def main_text(page: str | None) -> str:
    """The article of a page, a block to a line; a page without text has an empty one."""
    return Page(page or "").main_text()


@F.arrow_udf(struct(text=STRING, n_chars=LONG))
def _extract(pages: pa.Array) -> pa.Array:
    texts = [main_text(p) for p in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; a page at a time, without a shuffle.

    A null or empty page has an empty text. Broken markup is read as far as it goes: tags left open or closed twice, and
    quotes, comments and raw elements that never end, do no harm. Repeated rows and ids stay rows. Pages of any length are
    read whole, in time linear in it. Of elements with equal scores the innermost is the article. Other columns are not
    read, and an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    return pages.select(id_col, url_col, _extract(html_col).alias("found")).select(id_col, url_col, "found.text", "found.n_chars")
