import random

import pytest

from codequarry.llm import truncation as tr

WHOLE = ["yes", "No.", "**Yes**", "**No**!", "yes 👍", "Yes (see the loop)", "<think>\nOkay.\n</think>\n\nno", "No. It only prints the value.", "Yes.\n\n```\nf(1)\n```", '{"reason": "It is so.", "answer": "yes"}', "<think>\n返回值符合要求。\n</think>\n\n是", "Yes, he said \"it works\".", "no: see (a) and [b].", "", "   ", None, "Final answer: yes"]
CUT = {
    "<think>\nOkay, let me": "open", "<think>\nOkay.\n</think>": "no_verdict", "<think>\nOkay.\n</think>\n\n": "no_verdict", "<think>\nOkay.\n</thi": "open", "**Ye": "open", "No. It only prints the va": "word", "No. It only prints the value,": "sentence", "Yes. In line 3, e.g.": "sentence",
    "Yes.\n\n```\nf(1": "open", '{"reason": "It is so.", "ans': "open", "No. It only prints the (value": "open", 'Yes, he said "it': "open", "No. It only prints the va [cut]": "note", "No. It only prints… (more)": "note", "No. It only prints the…": "note", "No. It only prints\ufffd": "character",
    "No. There are points:\n1. a\n2.": "sentence", "Yes. The name is `foo": "open",
}


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert tr.ending(text) is None


@pytest.mark.parametrize("text,why", CUT.items())
def test_cut(text, why):
    assert tr.ending(text) == why


def _sentence(rng):
    return " ".join(rng.choice(["the", "value", "of", "a", "list", "is", "never", "more", "than", '"one"', "über"]) for _ in range(rng.randint(5, 12))).capitalize() + "."


def _texts(measure, limit, n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = "No. " + " ".join(_sentence(rng) for _ in range(rng.randint(1, 9)))
        out.append((t, measure(t) > limit))
        if out[-1][1]:
            while measure(t) > limit:
                t = t[:-1]
            out[-1] = (t, True)
    return out


MEASURES = {
    "characters": len, "utf8_bytes": lambda t: len(t.encode()), "json_utf8": lambda t: len(t.encode()) + t.count('"'), "html_quotes": lambda t: len(t) + 5 * t.count('"'),
}


@pytest.mark.parametrize("measure", MEASURES)
def test_limits(spark, measure):
    rows = [(i, "limited", t) for i, (t, _) in enumerate(_texts(MEASURES[measure], 240, 600, 3))] + [(i, "free", t) for i, (t, _) in enumerate(_texts(len, 10**9, 600, 4))]
    df = spark.createDataFrame(rows, "id long, src string, text string")
    got = {r.src: (r.measure, r.max_length) for r in tr.storage_limits(df, ["src"]).collect()}
    assert got == {"limited": (measure, 240)}


def test_operator(spark):
    made = _texts(len, 200, 400, 5)
    rows = [(i, "a", t, "x") for i, (t, _) in enumerate(made)] + [(1000 + i, "b", t, "x") for i, t in enumerate(WHOLE)] + [(2000 + i, "b", t, "x") for i, t in enumerate(CUT)] + [(3000, None, "No. It on", "x"), (3000, None, "No. It on", "x")]
    rows += [(4000, "b", "No. It gives 5... So it is.", "x"), (4001, "b", "No. It gives 7...", "x"), (4002, "b", "No. It giv...", "x")]
    df = spark.createDataFrame(rows, "id long, src string, text string, reason string")
    got = [r.id for r in tr.truncated(df, ["id"], ["src"]).collect()]
    assert len(got) == len(set(got)) + 1 and got.count(3000) == 2
    shown = {i for i, (t, cut) in enumerate(made) if cut and tr.ending(t)}  # a cut behind a full stop can't be seen
    assert {i for i in got if i < 1000} == shown and len(shown) >= 0.85 * sum(cut for _, cut in made)
    assert {i for i in got if i >= 1000} == {2000 + i for i in range(len(CUT))} | {3000, 4002}
    rates = {r.src: (r.n_texts, r.n_truncated, r.max_length) for r in tr.truncation_rates(df, ["id"], ["src"]).collect()}
    assert rates["a"] == (400, len(shown), 200) and rates["b"][1] == len(CUT) + 1
    assert tr.truncated(df.limit(0), ["id"], ["src"]).count() == 0
