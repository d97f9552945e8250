import random

from codequarry.llm import leaks


def _brute(docs, items, n=12):
    grams = {}
    for k, t in items:
        w = leaks.normal_words(t or "")
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for d, t in docs:
        w = leaks.normal_words(t or "")
        for i in range(len(w) - n + 1):
            out |= {(d, k) for k in grams.get(tuple(w[i : i + n]), ())}
    return out


def _made(seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "I", "of", "the", "ключ", "étage", "ﬁne", "x1", "42"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    phrase = " ".join(rng.choice(vocabulary) for _ in range(11))
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) + (" " + phrase if i % 3 == 0 else "")) for i in range(120)] + [(500, "a I a I a I a I a I a I"), (501, None), (502, "")]
    docs = []
    for d in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            t = leaks.normal_words(rng.choice(items)[1] or "x")
            a = rng.randrange(len(t))
            n = rng.choice([5, 10, 11, 12, 13, 20, 50])
            at = rng.randint(0, len(w))
            w[at:at] = t[a : a + n]
        sep = rng.choice([" ", ", ", "\n", " - ", "\u200b \u00ad"])
        docs.append((d, sep.join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return docs + [(900, None), (901, ""), (902, "x " * 300_000 + (items[1][1] or ""))], items


def test_brute_force(spark):
    docs, items = _made()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    want = _brute(docs, items)
    for size in (16_000_000, 2_000):  # at once, and in blocks of items
        found = leaks.leaks(d, i, block_bytes=size)
        got = {(r.doc_id, r.item_id) for r in found.filter("run_words >= 12").collect()}
        assert got == want and len(want) > 50
    summary = {r.item_id: r.n_documents for r in leaks.leaked_items(found.filter("run_words >= 12")).collect()}
    assert summary == {k: len({a for a, b in want if b == k}) for k in {b for _, b in want}}
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_edits():
    words = [f"word{i}" for i in range(30)]
    index = leaks.ItemIndex([("k", " ".join(words))], 12, 1)
    changed = words[:6] + ["other"] + words[7:13]
    (found,) = index.verified([leaks.normal_bytes("x y " + " ".join(changed) + " z")])
    (item, run, aligned, first, last), = found
    assert (item, run, aligned) == (0, 6, 11) and (first, last) == (2, 14)


def test_words():
    assert leaks.normal_words("Ａ\u00adb-C_d é²\u200bx") == ["ab", "c", "d", "é2x"]
    for t in ("Plain, ASCII text_here 42!", "", "Ünïcode ﬁ"):
        assert leaks.normal_bytes(t).decode() == " ".join(leaks.normal_words(t))
