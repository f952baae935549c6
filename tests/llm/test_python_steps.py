"""Steps of the pipeline take as few Python workers as they can: workers stay for the session, each with its memory."""

import pytest

from anisoframe.llm import quality, suffix_dedup


def stacked(plan):
    """Python steps that read from another one without a shuffle between them."""
    found, path = [], []
    for line in plan.splitlines():
        text = line.lstrip(" :+-*")
        depth = len(line) - len(text)
        name = text[text.index(")") + 2 :] if text.startswith("(") else text
        path = [(d, above) for d, above in path if d < depth]
        if "EmptyRelation" in (above for _, above in path):  # what is shown below did not run
            continue
        if "Exchange" in name.split(" ")[0]:
            path = []
        elif name.startswith("EmptyRelation"):
            path.append((depth, "EmptyRelation"))
        elif name.startswith(("MapInArrow", "ArrowEvalPython")):
            found += [text] * bool(path)
            path.append((depth, name))
    return found


@pytest.mark.parametrize("kinds", [suffix_dedup.KINDS, 1])
def test_repeated_strings_stack_no_python_steps(spark, kinds, monkeypatch):
    """Nor where few rows are left, which joins by broadcast would bring to the texts."""
    assert stacked("MapInArrow a\n+- *(2) Project\n   +- ArrowEvalPython b")
    assert not stacked("MapInArrow a\n+- Exchange x\n   +- ArrowEvalPython b")
    monkeypatch.setattr(suffix_dedup.repeat_spans, "__defaults__", (*suffix_dedup.repeat_spans.__defaults__[:2], kinds, None))
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(i, f"{i} {text} {i}") for i in range(4)] + [(9, "no repeats here")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: len(r.text) < 50 for r in out.collect()} == dict.fromkeys([0, 1, 2, 3, 9], True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Final Plan" in plan and plan.count("MapInArrow") > 3 and not stacked(plan)


def test_labelled_rows_take_no_workers_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words here " * 30 + "!" * (i % 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)] + [(1, None), (None, 1), (99, 1)], "doc_id int, quality int")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert quality.judged(docs, labels).count() == 40 and quality.judged(docs, labels.limit(0)).count() == 40
