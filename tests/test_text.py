import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codequarry.functions import text as T


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("lang,given_,want", [("Python", "# foo", "foo"), ("Python", "##foo", "foo"), ("Python", "#####", ""), ("Python", "# foo ", "foo "), ("Lua", "---- foo", "foo"), ("Lua", "---------", ""), ("C", "// foo", "foo"), ("C", "//////", "")])
def test_single_line(spark, lang, given_, want):
    assert _one(spark, T.clean_single_line_comment(F.col("c"), F.col("l")), c=given_, l=lang) == want


@pytest.mark.parametrize("lang,given_,want", [("Python", '"""doc\n"""', "doc"), ("Python", 'r"""doc"""', 'r"""doc'), ("Lua", "--[[\nfoo\n--]]", "foo"), ("Ruby", "=begin\nfoo\n=end", "foo"), ("Ruby", "=begin\nfoo", "=begin\nfoo"), ("C", "/**\n * foo\n *\n * bar\n */", "foo\nbar"), ("COBOL", "x", None)])
def test_multi_line(spark, lang, given_, want):
    assert _one(spark, T.clean_multi_line_comment(F.col("c"), F.col("l")), c=given_, l=lang) == want


@pytest.mark.parametrize("given_,want", [("@brief foo", "foo"), ("\\brief foo", "foo"), ("!\n\\brief foo", "foo"), ("foo @brief", "foo @brief"), ("@briefly", "ly"), ("", "")])
def test_brief(spark, given_, want):
    assert _one(spark, T.clean_brief(F.col("c")), c=given_) == want


C1 = "Adds two numbers.\n@param a first\nReturns: sum\n- a: first\nresult: x\nNotes here"


@pytest.mark.parametrize(
    "lang,name,given_,want",
    [
        ("Java", "sumOf", C1, "Adds two numbers.\nNotes here"), ("Java", "add", C1, "Notes here"), ("Java", "", C1, ""), ("Java", "zz", "Keep\n- Example:\nDropped", "Keep"), ("Java", "zz", "@description X", ""),
        ("Java", "zz", "@brief X", "@brief X"), ("C#", "x", "<summary>\n Foo \n</summary>\nx", "Foo"), ("C#", "x", "</summary> x <summary> y", ""), ("Python", "x", "Do it.\n\nArgs:\n x: y", "Do it."),
        ("Go", "x", "Foo does.\n- item", "Foo does."), ("Go", "x", "Foo\n-\nbar", "Foo\n-\nbar"), ("Julia", "x", "anything", None), ("Rust", "x", "  a ", "a"),
    ],
)
def test_query(spark, lang, name, given_, want):
    assert _one(spark, T.comment_to_query(F.col("c"), F.col("l"), F.col("i")), c=given_, l=lang, i=name) == want


@pytest.mark.parametrize("path", ["a.py", "x/y.tar.gz", ".bashrc", "..x", "a/.x.py", "noext", "dir.d/file", "a.", "", "...", "A.PY", "x/.a"])
def test_extension(spark, path):
    assert _one(spark, T.extension(F.col("p")), p=path) == os.path.splitext(path)[1]


@pytest.mark.parametrize("name,want", [("fooBar", ["foo", "Bar"]), ("FooBar", ["Foo", "Bar"]), ("foo_Bar", ["foo", "Bar"]), ("HTTPServer2", ["HTTP", "Server", "2"]), ("foo-1", ["foo", "1"]), ("йцукен", ["йцукен"])])
def test_camel(spark, name, want):
    assert _one(spark, T.split_camel(F.col("c")), c=name) == want


def test_analyzer(spark):
    df = spark.createDataFrame([("A b c",), ("",), (None,)], "t string").withColumn("w", T.words_v1(F.col("t")))
    rows = [r[0] for r in df.select(T.grams(F.col("w"))).collect()]
    assert rows[0] == ["a", "b", "c", "a b", "b c", "a b c"] and rows[1] == [] and rows[2] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\t\x0b\x0c\x1c\x85 é", max_size=12), min_size=20, max_size=20))
def test_lines_and_strip_as_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines(F.col("t")).alias("l"), T.strip(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.l == r.t.splitlines() and r.s == r.t.strip()


@pytest.mark.parametrize("answer,want", [("x</think> Yes", 1), ("</think>nothing", 0), ("yes", -1), ("</think>maybe", -1), ("a</think>no</think>yes", 0), (None, -1)])
def test_label(spark, answer, want):
    assert _one(spark, T.answer_to_label(F.col("a")), a=answer) == want


def test_byte_slice(spark):
    df = spark.createDataFrame([("йaб", 2, 5), ("йaб", 1, 3), (None, 0, 1)], "c string, a int, b int").select(T.byte_slice(F.col("c"), F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == ["aб", None, None]
