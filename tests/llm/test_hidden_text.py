import pytest

from codequarry.llm import hidden_text, langid, lexers
from codequarry.llm.prose import comment_lines, is_sentence, literal_text, mend, paragraphs

MODEL = langid.LanguageModel({})
SENTENCES = {
    "en": "Returns the first value that is still free, unless the caller asked for another one.",
    "de": "Gibt den ersten Wert zurück, der noch frei ist, wenn nichts anderes verlangt wurde.",
    "fr": "Renvoie la première valeur qui est encore libre, sauf si l'appelant en a demandé une autre.",
    "es": "Devuelve el primer valor que todavía está libre, salvo que se haya pedido otro.",
    "pt": "Devolve o primeiro valor que ainda não está ocupado, a não ser que outro seja pedido.",
    "pl": "Zwraca pierwszą wartość, która jest jeszcze wolna, chyba że poproszono o inną.",
    "ru": "Возвращает первое значение, которое ещё свободно, если не запрошено другое.",
    "zh": "返回第一个仍然空闲的值，除非调用者要求另一个值。",
    "ja": "まだ空いている最初の値を返します。ただし別の値が指定された場合を除きます。",
}
FRAMES = {
    "Python": '# {0}\nx = 1\n', "Java": "class A {{\n  /**\n   * {0}\n   * @param x the value\n   */\n  int f() {{ return 1; }}\n}}\n", "Lua": "--[[\n{0}\n]]\nlocal x = 1\n", "Ruby": "=begin\n{0}\n=end\nx = 1\n",
    "Go": "package a\n\n// {0}\nvar x = 1\n", "C": 'void f(void) {{ g("{0}"); }}\n', "JavaScript": 'throw new Error("{0}");\n', "PHP": "<?php\n# {0}\n$x = 1;\n",
}


def _found(text, language):
    return {x["nl_lang"] for x in hidden_text.analyse(text, language, MODEL) if x["n_sentences"]}


@pytest.mark.parametrize("language", FRAMES)
@pytest.mark.parametrize("nl", SENTENCES)
def test_every_pair(language, nl):
    assert _found(FRAMES[language].format(SENTENCES[nl]), language) == {nl}


@pytest.mark.parametrize("nl", ["de", "fr", "es", "pt", "pl", "ru"])
def test_damage(nl):
    import unicodedata

    s = SENTENCES[nl]
    broken = s.encode().decode("cp1252", "replace") if nl != "ru" else "".join(chr(b) for b in s.encode())
    bare = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    escaped = "".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in s)
    for text in ("".join(chr(b) if b < 128 or b > 159 else bytes([b]).decode("cp1252", "ignore") or chr(b) for b in s.encode()), bare if nl != "ru" else s, escaped, unicodedata.normalize("NFD", s), s.upper(), broken if nl == "ru" else s):
        assert _found(f'f("{text}")\n', "Python") == {nl}, text


def test_wrapped_and_mixed():
    en, de = SENTENCES["en"], SENTENCES["de"]
    half = len(en.split()) // 2
    wrapped = f"# {' '.join(en.split()[:half])}\n# {' '.join(en.split()[half:])}\nx = 1\n"
    assert _found(wrapped, "Python") == {"en"}
    assert _found(f"# {en} {de}\n", "Python") == {"en", "de"}
    assert _found(f"# {en[:-1]} {de}\n", "Python") == {"en", "de"}  # without a full stop between them


@pytest.mark.parametrize(
    "text",
    ["# pylint: disable=invalid-name, too-many-lines, fixme\n", "x = 'SELECT id, best FROM ribbon WHERE day = ? ORDER BY id'\n", "# for item in values: if item > 3: return item\n", "x = '/var/lib/route/route.dat'\n", "# :param xs: the weighted value of all\n", "x = '^[a-z]+(cursor|bucket)?'\n", "# five words are too few\n", "# @return int\n", "x = 'https://api.example.com/v1/the/path/of/all/things'\n", "#!/usr/bin/env python3\n", "# ----------------\n", "# x = the_value + 1\n", "# 短い文です。\n", ""],
)
def test_no_sentences(text):
    assert _found(text, "Python") == set()


def test_helpers():
    assert mend("dÃ©jÃ\xa0 vu") == "déjà vu" and mend("déjà vu") == "déjà vu"
    assert comment_lines("/**\n * a\n */") == ["", "a", ""] and literal_text(r'"aé\n\x41"') == "aé\nA" and literal_text(r"r'a\n'") == r"a\n"
    assert paragraphs(["Does it", "all.", "", "@param x the one", "  and more", "Then this."]) == ["Does it all.", "Then this."]
    assert is_sentence("Walks through all entries of it") and not is_sentence("Walks through all of it")


def test_segments_are_optimal():
    words = "the value of all 值的总和 und die der das nicht wird the and of to".split()
    tags = MODEL.segment(words)

    def worth(t):
        i = dict(zip(langid.NL_LANGUAGES, range(9)))
        return sum(MODEL.word(w)[i[x]] for w, x in zip(words, t)) - langid.SWITCH * sum(a != b for a, b in zip(t, t[1:]))

    import random

    rng = random.Random(1)
    best = worth(tags)
    for _ in range(3000):  # no change of a stretch improves it
        a, b = sorted(rng.sample(range(len(words) + 1), 2))
        other = tags[:a] + [rng.choice(langid.NL_LANGUAGES)] * (b - a) + tags[b:]
        assert worth(other) <= best + 1e-9
    assert MODEL.segment([]) == []


def test_operator(spark):
    de, en = SENTENCES["de"], SENTENCES["en"]
    rows = [(1, f"# {de}\n", "Python", "x"), (1, f"# {de}\n", "Python", "x"), (2, None, "Python", "x"), (3, "", "Python", "x"), (4, f"# {en}\n", None, "x"), (5, f"# {en}\nx = (\n", "Python", "x"), (6, "x" * 200_000, "C", "x")]
    df = spark.createDataFrame(rows, "file_id long, content string, language string, nl_lang string")
    got = sorted((r.file_id, r.nl_lang, r.n_sentences, r.parses) for r in hidden_text.nl_spans(df, MODEL).collect())
    assert got == [(1, "de", 1, True), (1, "de", 1, True), (5, "en", 1, False)]
    share = hidden_text.nl_spans(df, MODEL).filter("file_id = 1").first()
    assert share.nl_bytes == len(de.encode()) and share.share == pytest.approx(len(de.encode()) / (len(de.encode()) + 3))
    texts = hidden_text.nl_texts(df, MODEL).filter("file_id = 5").first()
    assert (texts.kind, texts.start_byte, texts.nl_lang, texts.text) == ("comment", 0, "en", en)
    assert hidden_text.nl_spans(df.limit(0), MODEL).count() == 0
    docs = spark.createDataFrame([(i, s, k) for i, (k, s) in enumerate(SENTENCES.items())] + [(None, "x", "en"), (99, None, "de"), (98, "y", None)], "doc_id long, text string, lang string")
    fitted = langid.fit(docs)
    assert all(set(fitted.segment(SENTENCES[k].split())) == {k} for k in langid.ALPHABETIC) and langid.fit(docs.limit(0)).logs


def test_lexers_keep_places():
    for language, frame in FRAMES.items():
        text = frame.format(SENTENCES["ru"])
        lexed = lexers.lex(text, language)
        assert lexed.error is None and all(text[a:b] for a, b in lexed.comments + lexed.strings)


@pytest.mark.parametrize("literal,lang", [('"你好世界"', "zh"), ('"Hallo"', "de"), ('"Fehler"', "de"), ('"Привет"', "ru"), ('"x"', None), ('"%d"', None), ('"UTF-8"', None), ('"a_b"', None), ('"qxzvk"', None)])
def test_short_literals(spark, literal, lang):
    """Literals count by what their words look like, not by their length; the share is of the file's bytes."""
    docs = spark.createDataFrame([(1, "Hallo und guten Tag, hier ist ein Fehler in der Welt. Hallo Fehler.", "de"), (2, "hello and good day, here is an error in the world of numbers", "en")], "doc_id long, text string, lang string")
    text = f"x = {literal}\n"
    files = spark.createDataFrame([(1, text, "Python")], "file_id long, content string, language string")
    got = [(r.nl_lang, r.nl_bytes, r.share) for r in hidden_text.nl_spans(files, langid.fit(docs)).collect()]
    size = len(literal.strip('"').encode())
    assert got == ([(lang, size, size / len(text.encode()))] if lang else [])
