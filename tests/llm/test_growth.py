"""The time that reading a file takes grows in proportion to its length, whatever stands in it: no file stops a task."""

import time

import pytest

from codequarry.llm import docpairs, grammar, hidden_text, langid, lexers

UNITS = [" ", "\n", "a ", '"', "'", "`", "/*", "# a\n", "// a b\n", "--[[", "=begin\n", '"""', "`${", "%w(", "<<A\n", "<<<A\n", "(", "()", "[", "{", "}", "* ", "a * ", "struct a ", "if ", "end ", "def f(\n", "function f(", "int f(a) ", "@A(\n", "elseif ", "#define a\n", "x = ", " ", "漢", "The cat sat on the mat. "]
BEGINS = {"PHP": "<?php ", "Go": "package a\n"}
MODEL = langid.LanguageModel({})


def _read(text, language):
    lexed = lexers.lex(text, language)
    grammar.findings(text, language, lexed)
    docpairs.pairs_of(text, language, lexed)
    hidden_text.analyse(text, language, MODEL, lexed)


def _seconds(text, language):
    began = time.process_time()
    _read(text, language)
    return time.process_time() - began


@pytest.mark.parametrize("language", lexers.LANGUAGES)
def test_runs(language):
    begin = BEGINS.get(language, "")
    _read(begin + "a = 1\n", language)  # compiles the grammars
    slow = []
    for unit in UNITS:
        for before, after in (("", ""), ("(", ")")):
            def text(n):
                return begin + before + unit * (n // len(unit)) + after

            small = _seconds(text(2_000), language)
            large = _seconds(text(20_000), language)
            if large > 0.2 + 25 * small:
                slow.append((unit, before, small, large))
    assert not slow


@pytest.mark.parametrize("language", [x for x in lexers.LANGUAGES if x != "Python"])
@pytest.mark.parametrize("n", [1_000, 10_000, 100_000])
def test_token_runs(language, n):
    """The grammars themselves, over runs of each token and each two of the commonest."""
    ok = grammar._grammar(language)
    letters = sorted(set(lexers.KEYWORDS[language].values()) | set(lexers._OPS[language]) | set("ins()[]{},;:~"))
    units = letters + [a + b for a in "i([" for b in letters]
    for unit in units if n < 10_000 else letters:
        began = time.process_time()
        ok(unit * (n // len(unit)))
        assert time.process_time() - began < 0.2 + 2e-5 * n, unit


@pytest.mark.parametrize("language,opens,closes", [("C", "(", ")"), ("Java", "A<", ">"), ("Lua", "do ", "end "), ("Ruby", "begin\n", "end\n"), ("JavaScript", "[", "]"), ("Go", "{", "}"), ("PHP", "{", "}")])
def test_nesting(language, opens, closes):
    for n in (1_000, 10_000, 100_000):
        began = time.process_time()
        grammar.parses(BEGINS.get(language, "") + opens * n + closes * n, language)
        assert time.process_time() - began < 0.5 + 3e-5 * n


@pytest.mark.parametrize("language", lexers.LANGUAGES)
def test_long_files(language):
    """Ordinary code, many times over."""
    from test_docpairs import CASES

    begin = BEGINS.get(language, "")
    code = CASES[language][0][0].format("Counts how often the mark shows up in the list.").removeprefix("<?php\n").removeprefix("package a\n")
    small, large = (min(_seconds(begin + code * n, language) for _ in range(2)) for n in (20, 400))
    assert large < 0.3 + 45 * small
