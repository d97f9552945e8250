from pyspark.sql import functions as F

from codequarry.operators import gate, pairs, spans

TEXT = "  // a\n  // b\n\n  // c\n// d\n// e\n"
PLACES = [(2, 6, 0, 2), (9, 13, 1, 2), (17, 21, 3, 2), (22, 26, 4, 0), (27, 31, 5, 0)]


def _groups(spark, text, places, strict, least=1):
    files = spark.createDataFrame([(1, text)], "file_id long, content string")
    c = spark.createDataFrame([(1, str(i), a, b, r, r, col) for i, (a, b, r, col) in enumerate(places)], "file_id long, id string, start_byte int, end_byte int, start_row int, end_row int, start_col int")
    c = c.join(files, "file_id").withColumn("line_start", spans.at_line_start(F.col("content"), F.col("start_byte"), F.col("start_col"), strict))
    return sorted((r.start_byte, r.end_byte) for r in spans.group_lines(c, "file_id", least).collect())


def test_grouping(spark):
    assert _groups(spark, TEXT, PLACES, True) == [(2, 13), (17, 21), (22, 26), (27, 31)]
    assert _groups(spark, TEXT, PLACES, True, 2) == [(2, 13)]
    assert _groups(spark, TEXT, PLACES, False) == [(2, 13), (17, 31)]
    assert _groups(spark, "x = 1  // t\n  // u\n", [(7, 11, 0, 7), (14, 18, 1, 2)], False) == [(7, 11), (14, 18)]


def test_grouping_in_bytes(spark):
    text = "/*й*/\n" + TEXT
    assert _groups(spark, text, [(a + 7, b + 7, r + 1, c) for a, b, r, c in PLACES], True) == [(9, 20), (24, 28), (29, 33), (34, 38)]


def test_join_comments(spark):
    c = spark.createDataFrame([(1, "up", 0, 5, 3, 3), (1, "in0", 20, 25, 4, 4), (1, "in3", 30, 35, 7, 7), (1, "in4", 40, 45, 8, 8), (2, "none", 0, 5, 3, 3)], "file_id long, id string, start_byte int, end_byte int, start_row int, end_row int")
    f = spark.createDataFrame([(1, "f", 10, 100, 4), (1, "g", 15, 90, 4), (1, "far", 110, 120, 5), (2, "same", 50, 60, 3)], "file_id long, id string, start_byte int, end_byte int, start_row int")
    got = {(r.comment_id, r.function_id) for r in spans.join_comments(c, f).collect()}
    assert got == {("up", "f"), ("up", "g"), ("in0", "f"), ("in0", "g"), ("in3", "f"), ("in3", "g"), ("in0", "far")}


def test_strip_spans(spark):
    df = spark.createDataFrame([("a/*й*/b//c\nd", [(1, 7), (8, 11)]), ("abc", []), ("abc", None), ("abcd", [(2, 3), (1, 3)])], "c string, s array<struct<start_byte:int,end_byte:int>>")
    assert [r[0] for r in df.select(spans.strip_spans(F.col("c"), F.col("s"))).collect()] == ["ab\nd", "abc", "abc", "ad"]


def test_gate(spark):
    rows = [
        ("Python", "a.py", 1_000_000, 10_000, 10_000, "UTF-8", None), ("Python", "a.py", 1_000_001, 10_001, 1, "utf-8", "too_long_file"), ("Python", "a.py", 1, 10_001, 1, "utf-8", "too_many_rows"), ("Python", "a.py", 1, 1, 10_001, "utf-8", "too_long_line"),
        ("Python", "a.py", 1, 1, 1, "latin-1", "bad_encoding"), ("C++", "a.cc", 1, 1, 1, "utf-8", "not_implemented"), ("Python", "a.PY", 1, 1, 1, "utf-8", "not_implemented"), ("Kotlin", "a.kt", 1, 1, 1, "utf-8", "not_implemented"),
        (None, "a.py", 1, 1, 1, "utf-8", "not_implemented"), ("C", "a.h", None, None, None, "utf-8", None), ("C", "a.h", 1, 1, 1, None, "bad_encoding"),
    ]
    df = spark.createDataFrame(rows, "l string, p string, b long, n long, m long, e string, want string")
    c = F.col
    for r in df.withColumn("got", gate.gate_status(c("l"), c("p"), c("b"), c("n"), c("m"), c("e"))).collect():
        assert r.got == r.want, r


def test_headers(spark):
    cols = "file_id long, repo_name string, lang string, path string, comment string, query string, snippet string, scope string, identifier string, type string, comment_id string, snippet_id string"
    rows = [(1, "r", "C", "a.h", "c", "q", "decl", "", n, "function_definition", "c1", f"s{n}") for n in ("one", "gone")] + [(2, "r", "C", p, "c", "q", "decl", "", "two", "function_definition", "c1", p) for p in ("b.h", "c.h")]
    p = spark.createDataFrame([*rows, (3, "r", "C", "x.c", "c", "q", "body", "", "other", "function_definition", "c1", "sx")], cols)
    b = spark.createDataFrame([("r", "one", 1, "first", "b1"), ("r", "one", 2, "last", "b2"), ("r", "two", 1, "x", "b3"), ("s", "gone", 1, "x", "b4")], "repo_name string, name string, place int, snippet string, snippet_id string")
    assert sorted((r.identifier, r.snippet, r.snippet_id) for r in pairs.resolve_headers(p, b).collect()) == [("one", "last", "b2"), ("other", "body", "sx")]
