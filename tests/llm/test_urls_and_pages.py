"""Url models against all splits and on hosts that they have not seen; pages with labelled text and hostile markup."""

import math
import random
import time

import pytest

from anisoframe.llm import html_extract, url_filter

HELD_OUT_BAD = ["luckypokerroom.com", "my-best-slots.io", "onlinebettingtips.net.au", "hotwebcam-girls.tv", "discountviagra.biz", "warezcity.to", "sexystories.xyz", "www.spamtools.co", "adserver12.info", "virusdownload.cc"]
HELD_OUT_FINE = ["cityhistorymuseum.org.uk", "open-data-science.io", "localweathernews.com", "schoolbooks.fr", "www.greenenergyjournal.com", "trainsandtravel.ch", "essexuniversity.ac.uk", "mathforum.jp", "foodrecipes.it", "x.y"]


def best_split(model, run):
    """The least cost of all ways to cut a run."""
    if not run:
        return 0.0
    return max(sum(model.cost(w) for w in words) for words in splits(run))


def splits(run):
    for mask in range(1 << (len(run) - 1)):
        out, at = [], 0
        for k in range(1, len(run)):
            if mask >> (k - 1) & 1:
                out.append(run[at:k])
                at = k
        yield [*out, run[at:]]


def test_segmentation_against_all_splits():
    rng = random.Random(2)
    model = url_filter.Unigrams({"a": 5, "ab": 9, "bab": 3, "abba": 4, "cab": 2, "b": 1})
    for _ in range(60):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11)))
        words = model.segment(run)
        assert "".join(words) == run
        assert math.isclose(sum(map(model.cost, words)), best_split(model, run))
    began = time.time()
    assert "".join(model.segment("abcd" * 50_000)) == "abcd" * 50_000 and time.time() - began < 20


def test_runs_of_any_length():
    run = "".join(["free", "casino", "online", "poker"] * 8)
    assert len(run) > 64 and url_filter.MODEL.segment(run) == ["free", "casino", "online", "poker"] * 8
    assert url_filter.judge(f"http://{run}.com/a")[3] == "block" and url_filter.judge("http://" + "pills" * 12 + ".com/")[3] == "block"


def test_held_out_hosts(spark):
    model = url_filter.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    bad, fine = ([h for h in hosts if url_filter.judge(f"http://{h}/index", model)[3] == "block"] for hosts in (HELD_OUT_BAD, HELD_OUT_FINE))
    assert len(bad) >= 9 and len(fine) <= 1, (bad, fine)


def test_words_are_learned_from_the_pages(spark):
    """A word that goes along with bad names, and is in no list, blocks a host by itself."""
    bad = [(i, f"http://casino-zork{'' if i % 2 else i}.com/p", "", 1) for i in range(40)]
    fine = [(100 + i, f"http://news-blart.com/{i}", None, 1) for i in range(60)]
    pages = spark.createDataFrame([*bad, *fine, (None, None, None, 1), (5, "", "", 1)], "page_id long, url string, html string, verdict int")
    model = url_filter.fit(pages)
    assert [url_filter.judge(u, model)[3] for u in ("http://zork.com/", "http://blart.com/", "http://frob.com/")] == ["block", "allow", "allow"]
    assert url_filter.judged(pages).count() == 102 and url_filter.judged(pages.where("false")).count() == 0
    assert url_filter.judged(pages.drop("html")).where("verdict = 'block'").count() == 40


CASES = [
    ('<article><div class="article-header"><h1>Title</h1></div><p>Some text, and more of it. Yes.</p></article>', "Title\nSome text, and more of it. Yes."),
    ('<article><p>Some text, and more of it. Yes.</p><section id="discussion"><p>We discuss, at length, what was found. So it is.</p></section></article>', "Some text, and more of it. Yes.\nWe discuss, at length, what was found. So it is."),
    ('<article><p>Some text, and more of it. Yes.</p><p class="related-work">Others did, as well, this and that. See there.</p></article>', "Some text, and more of it. Yes.\nOthers did, as well, this and that. See there."),
    ('<div class="content no-sidebar"><h2>Short</h2><p>Words, many of them, here. And here.</p><p>Even more words, in a row, here. And there.</p></div>', "Short\nWords, many of them, here. And here.\nEven more words, in a row, here. And there."),
    ('<main><div class="cookie-notice">We use cookies, sir. Accept.</div><p aria-hidden="false">Words, many of them, here. And here.</p><div class="comment-list"><p>I think, well, no. Never.</p></div></main>', "Words, many of them, here. And here."),
    ('<nav><a>Home</a></nav><div><p>First, some words. Then more.<p>Second, other words. Then less.</div><footer>(c) me, 2020. All rights.</footer>', "First, some words. Then more.\nSecond, other words. Then less."),
    ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<article>a &lt;b&gt; &amp; c&nbsp;d</article>", "a <b> & c d"), ("<p>1 < 2, 3 <4. <", "1 < 2, 3 <4. <"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_labelled_pages(page, text):
    assert html_extract.main_text(page) == text


def test_path_sums():
    """The ratios of a path are its sums over its blocks: all blocks of a path have one score."""
    page = html_extract.Page("<div><p>a, b. c</p><p>dd</p><ul><li>e!</li><li>ffff ff.</li></ul></div><div><p>g</p></div>")
    score = page.path_scores()
    paths = [page.path[e] for e in page.element]
    assert page.texts == ["a, b. c", "dd", "e!", "ffff ff.", "g"] and paths == [paths[0]] * 2 + [paths[2]] * 2 + [paths[0]]
    assert len(set(score[[0, 1, 4]])) == 1 and len(set(score[2:4])) == 1
    length, marks = [(7 + 2 + 1) / 3, (2 + 8) / 2], [2 / 3, 2 / 2]
    want, kernel = [], [math.exp(-(d * d) / 2) for d in range(-2, 3)]
    order = [0, 0, 1, 1, 0]
    for i in range(5):
        near = [(kernel[d + 2] / sum(kernel), order[i + d]) for d in range(-2, 3) if 0 <= i + d < 5]
        want.append(sum(k * length[p] for k, p in near) * (1 + sum(k * marks[p] for k, p in near)))
    assert math.isclose(score[0], (want[0] + want[1] + want[4]) / 3) and math.isclose(score[2], (want[2] + want[3]) / 2)


@pytest.mark.parametrize("page", [
    "<" + "a" * 1_000_000, "<div>" * 200_000 + "text", "<b>" * 150_000 + "<div>" * 50_000, "<p title=\"" * 100_000, "<!--" * 250_000, "<script>" * 125_000,
    "<a '" * 250_000, "</x>" * 250_000, "<p>x" + "<div></p>" * 100_000, "&amp" * 250_000, "<li><b>" * 140_000, "<" * 1_000_000, "<p " + "x" * 1_000_000 + ">a",
])
def test_hostile_pages(page):
    began = time.time()
    html_extract.main_text(page)
    assert time.time() - began < 15
