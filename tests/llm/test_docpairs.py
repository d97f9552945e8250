import pytest

from codequarry.llm import docpairs

SAID = "Counts how often the mark shows up in the list."
CASES = {
    "Python": [
        ('def f(x):\n    """{0}\n\n    Args:\n        x: the list\n    """\n    return 1\n', ("f", 0)), ("# {0}\n@cached\n@other(\n    a=1,\n)\nasync def g(x):\n    return 1\n", ("g", 5)), ("class A:\n    # {0}\n    def h(self):\n        pass\n", ("h", 2)),
        ("def f():\n    # about {0}\n    r'''{0}'''\n", ("f", 0)), ("# {0}\n\ndef f():\n    pass\n", None), ("def f():\n    x = 1\n    '''{0}'''\n", None), ("x = 1  # {0}\ndef f():\n    pass\n", None), ("def f():\n    def inner():\n        '''{0}'''\n    return inner\n", ("inner", 1)),
    ],
    "JavaScript": [
        ("/**\n * {0}\n * @param x the list\n */\nexport async function f(x) {{\n  return 1;\n}}\n", ("f", 4)), ("// {0}\nconst f = async (x) => {{ return 1; }};\n", ("f", 1)), ("// {0}\nmodule.exports.f = function (x) {{ return 1; }};\n", ("f", 1)),
        ("class A {{\n  // {0}\n  static f(x) {{ return 1; }}\n}}\n", ("f", 2)), ("// {0}\nif (x) {{ y(); }}\n", None), ("const o = {{\n  /* {0} */\n  f: x => x + 1,\n}};\n", ("f", 2)),
    ],
    "Java": [
        ("class A {{\n  /** {0} */\n  @Override\n  @A(x = 1)\n  public <T> List<T> f(T x, int... y) throws E {{\n    return null;\n  }}\n}}\n", ("f", 4)), ("// {0}\nclass A {{ }}\n", None), ("class A {{\n  void g() {{\n    // {0}\n    while (x) {{ }}\n  }}\n}}\n", None)
    ],
    "C": [("/* {0} */\nstatic const char *\nf(const char *x, int (*g)(int))\n{{\n  return x;\n}}\n", ("f", 2)), ("// {0}\nint f(int x);\n", None), ("// {0}\nstruct s {{ int a; }};\n", None)],
    "Go": [("package a\n\n// {0}\n//\n// Example\n// f(1)\nfunc (t *T) F(x ...int) (int, error) {{\n\treturn 1, nil\n}}\n", ("F", 6)), ("package a\n\n// {0}\nvar f = func(x int) int {{\n\treturn 1\n}}\n", ("f", 3)), ("package a\n\n// {0}\ntype T struct {{\n}}\n", None)],
    "PHP": [("<?php\n/**\n * {0}\n * @return int\n */\nfunction &f(array $x = [1, 2]): ?int\n{{\n  return 1;\n}}\n", ("f", 5)), ("<?php\nclass A {{\n  # {0}\n  #[Pure]\n  abstract protected static function g($x) {{ }}\n}}\n", ("g", 4))],
    "Ruby": [("# {0}\n# @param x [Integer] the list\ndef self.f?(x)\n  if x then 1 else 2 end\nend\n", ("f?", 2)), ("=begin\n{0}\n=end\ndef f\nend\n", ("f", 3)), ("class A\n  # {0}\n  private def g(x) = x + 1\nend\n", ("g", 2))],
    "Lua": [("--- {0}\n-- @param x the list\nlocal function f(x)\n  if x then return 1 end\nend\n", ("f", 2)), ("--[[\n{0}\n]]\nfunction M.a:f(x)\nend\n", ("f", 3)), ("-- {0}\nM.f = function(x) return 1 end\n", ("f", 1))],
}


@pytest.mark.parametrize("language", CASES)
def test_found(language):
    for text, want in CASES[language]:
        text = text.format(SAID)
        for t in (text, text.replace("\n", "\r\n")):
            got = [(p["name"], p["name_row"]) for p in docpairs.pairs_of(t, language)]
            assert got == ([want] if want else []), t
            if want:
                assert docpairs.pairs_of(t, language)[0]["description"].startswith(SAID)


@pytest.mark.parametrize("doc", ["TODO", "Some function.", "todo: write the docs of this one later", "No documentation yet for this one here", "early_sum_of_all(xs, 3)", "if early > 1: return early sum of all", "Early sum of all once.", "pylint: disable=invalid-name, too-many-locals, fixme, all", "@param a the value of all the others\n# @return int", "---------------------", "短い文です", "four words are few", ""])
def test_no_documentation(doc):
    assert docpairs.pairs_of(f"# {doc}\ndef early_sum_of_all_once(a):\n    return a\n", "Python") == []


@pytest.mark.parametrize("doc", ["Counts how often a mark occurs.", "返回第一个仍然空闲的值的位置。", "Zählt, wie oft die Marke vorkommt.", "@brief Counts how often a mark occurs.", "Возвращает первое значение из списка всех."])
def test_documentation(doc):
    assert len(docpairs.pairs_of(f"# {doc}\n# noqa\ndef f(a):\n    return a\n", "Python")) == 1


def test_bodies():
    for language, text, last in (
        ("Python", "def f(\n    a,\n):\n    '''Counts how often a mark occurs.'''\n    if a:\n        return 1\n\n    return 2\n\n\nx = 1\n", "return 2"), ("Ruby", "# Counts how often a mark occurs.\ndef f(a)\n  a.each do |x|\n    puts x if x\n  end\n  while a do b end\n  case a when 1 then 2 end\nend\nx = 1\n", "end"),
        ("Lua", "-- Counts how often a mark occurs.\nfunction f(a)\n  for i = 1, 2 do\n    if a then b() elseif c then d() end\n  end\n  repeat x() until y\nend\nlocal z = 1\n", "end"), ("Java", "class A {\n  // Counts how often a mark occurs.\n  int f() { if (a) { b(\"}\"); } return 1; }\n  int z;\n}\n", "}"),
    ):
        code = docpairs.pairs_of(text, language)[0]["code"]
        assert code.endswith(last) and "z" not in code and "x = 1" not in code


def test_operator(spark):
    good = CASES["Python"][0][0].format(SAID)
    rows = [(1, good, "Python", "x"), (1, good, "Python", "x"), (2, good + "(", "Python", "x"), (3, None, "Python", "x"), (4, "", "Python", "x"), (5, good, None, "x"), (6, "# x\n" * 50_000, "Python", "x")]
    df = spark.createDataFrame(rows, "file_id long, content string, language string, name string")
    got = docpairs.documented_functions(df)
    assert sorted((r.file_id, r.parses, r.name, r.name_row, r.doc_kind) for r in got.collect()) == [(1, True, "f", 0, "docstring"), (1, True, "f", 0, "docstring"), (2, False, "f", 0, "docstring")]
    assert docpairs.documented_functions(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "doc",
    [
        "Navigates the tree to a node below.", "Name of the host that answers first.", "Native calls are counted by their kind.", "Nach dem Lesen wird die Datei geschlossen.", "Na podstawie wartości liczy sumę elementów.", "Nonexistent keys are skipped while reading.",
        "None of the keys may be empty afterwards.", "Hackers of old called this a bucket.", "Stubborn locks are freed after a minute.", "Write the text to the given stream.", "Insert a comment before the given node.", "No comments are kept in the output.",
        "Suppresses all warnings of the given parser.", "Suppress all warnings of the given parser.", "Emacsen of any age read this format.", "Blackened pixels are counted in each row.", "Black pixels are counted in each row.",
        "for each node (in order) it counts the marks", "returns the first of the values (or the last)", "from the list of names, the longest is kept;",
    ],
)
def test_sentences_that_begin_like_notes_or_code(doc):
    for text, language in ((f"# {doc}\ndef f(a):\n    return a\n", "Python"), (f"// {doc}\nfunction f(a) {{ return a; }}\n", "JavaScript")):
        assert [p["description"] for p in docpairs.pairs_of(text, language)] == [doc]


@pytest.mark.parametrize("doc", ["N/A", "none at all for this function here", "Stub, to be written later on: no documentation yet", "Missing documentation for method early_sum_of_all_once", "Write the docs for this function here please", "Description of this function goes here", "isort: skip the file that is here", "black: off for all of the file", "suppress(unused) in all of the file", "for (i = 0; i < the size of all things; i += 1)", "FIXME this breaks on lists of two items"])
def test_notes_and_code(doc):
    assert docpairs.pairs_of(f"# {doc}\ndef early_sum_of_all_once(a):\n    return a\n", "Python") == []
