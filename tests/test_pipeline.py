import json

import pytest
from pyspark.sql import functions as F

from codequarry.operators import pairs
from codequarry.operators.annotate import judge_pairs, overlap_judge, put_back, top_pairs
from codequarry.operators.parse import parse, parse_files
from codequarry.plans import registry
from codequarry.sources import benchmarks, jsonl
from codequarry.streaming.batches import read_stream, stream_batches

PY = '''import os

# Adds two numbers.
# Args: none
def add(a, b):
    """Inner doc."""
    return a + b  # sum

class Foo:
    # Does it.
    def run(self):
        x = "# no comment"
        return x
'''


def _file(path, language, content):
    return {"path": path, "language": language, "content": content, "length_bytes": len(content.encode()), "num_lines": content.count("\n") + 1, "max_line_length": max(map(len, content.split("\n"))), "src_encoding": "UTF-8"}


def _repos(tmp_path, *files):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"repo_name": "r", "files": list(files)}) + "\nnot json\n")
    return str(tmp_path / "in")


def test_mining(spark, tmp_path):
    src = _repos(tmp_path, _file("a.py", "Python", PY), _file("b.kt", "Kotlin", "fun x() {}"), _file("c.py", "Python", ""))
    files = jsonl.read_repos(spark, src)
    parsed = parse_files(files)
    assert {r.path: r.status for r in parsed.select("path", "status").collect()} == {"a.py": "success", "b.kt": "not_implemented", "c.py": "success"}
    got = {(r.identifier, r["query"]): r.snippet for r in pairs.accepted(pairs.mine_pairs(parsed, strict=False)).collect()}
    assert set(got) == {("add", "Adds two numbers."), ("add", "Inner doc."), ("run", "Does it.")}
    assert "# sum" not in got["add", "Inner doc."] and "return a + b" in got["add", "Inner doc."] and '"# no comment"' in got["run", "Does it."]
    out = str(tmp_path / "out")
    jsonl.write_jsonl(jsonl.nest_repos(parsed), out)
    with pytest.raises(Exception, match="already exists"):
        jsonl.write_jsonl(parsed, out)
    again = jsonl.read_repos(spark, out, parsed=True)
    assert again.count() == 3 and again.filter("size(snippets) > 0").count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.read_jsonl(spark, str(tmp_path / "nothing*"), jsonl.REPO)


@pytest.mark.parametrize(
    "language,text,names,comments",
    [
        ("C", "/* a */\nstatic int f(int x) {\n  if (x) { return 1; }\n  return 0; // b\n}\nstruct s { int a; };\n", ["f", "s"], 2),
        ("Java", "class A {\n  /** d */\n  public int f(int x) {\n    String s = \"// no\";\n    return 1;\n  }\n}\n", ["A", "f"], 1),
        ("JavaScript", "// c\nfunction f(a) { return a; }\nclass B {\n  g() { if (x) { y(); } }\n}\n", ["f", "B", "g"], 1),
        ("Go", "package a\n\n// F does.\nfunc F(x int) int {\n\treturn x\n}\n\ntype T struct {\n\ta int\n}\n", ["F", "T"], 1),
        ("Ruby", "# c\nclass A\n  def f(x)\n    if x\n      1\n    end\n  end\nend\n", ["A", "f"], 1),
        ("Lua", "-- c\nlocal function f(x)\n  if x then\n    return 1\n  end\nend\n", ["f"], 1),
        ("PHP", "<?php\n// c\nfunction f($x) {\n  return 1;\n}\n", ["f"], 1),
        ("Rust", "/// c\nfn f(x: i32) -> i32 {\n  x\n}\nstruct S { a: i32 }\n", ["f", "S"], 1),
        ("Python", "", [], 0),
    ],
)
def test_parse(language, text, names, comments):
    s, c = parse(text, language)
    assert [x["identifier"] for x in s] == names and len(c) == comments
    for x in s:
        piece = text.encode()[x["start_byte"] : x["end_byte"]].decode()
        assert piece.startswith(text.split("\n")[x["start_point"][0]][x["start_point"][1] :][:10].rstrip("\n")) and (piece.endswith("}") or piece.endswith("end"))


def test_annotation(spark):
    p = spark.createDataFrame([(1, "add numbers", [("a", "def add numbers", 1.0), ("b", "zzz", 0.5), ("c", "add", 0.1)]), (2, None, [("a", None, 1.0)]), (3, "x", [])], "id int, question string, candidates array<struct<id:string,text:string,score:double>>")
    answers = judge_pairs(top_pairs(p, 2), overlap_judge)
    got = {(r.id1, r["rank"]): r.answer for r in put_back(p.withColumnRenamed("id", "id1"), answers, 2, ["id1"]).collect()}
    assert got == {(1, 1): "yes", (1, 2): "no", (1, 3): None, (2, 1): None} or got == {(1, 1): "yes", (1, 2): "no", (1, 3): None, (2, 1): "yes"}


def test_benchmarks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"def f(): pass": 0, "def g(): pass": 1}))
    (tmp_path / "q.json").write_text(json.dumps([{"doc": "call g", "code": "def g(): pass", "label": 1, "retrieval_idx": 1}]))
    q, c = benchmarks.cosqa(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))
    assert c.count() == 2 and benchmarks.check_gold(q, c).count() == 0
    repo = {"python": [{"repo": "r", "needles": [{"query": "find", "global_start_byte": 1, "global_end_byte": 3}], "functions": {"a.py": [{"start_byte": 2, "end_byte": 4, "global_start_byte": 1, "global_end_byte": 3}]}, "content": {"a.py": "йab"}}]}
    (tmp_path / "r.json").write_text(json.dumps(repo, ensure_ascii=False))
    q, c = benchmarks.repoqa(spark, str(tmp_path / "r.json"))
    assert q.first().label == "1_3" and (c.first().id, c.first().text) == ("1_3", "ab")
    (tmp_path / "csn" / "go").mkdir(parents=True)
    (tmp_path / "csn" / "go" / "x.jsonl").write_text(json.dumps({"partition": "test", "docstring_tokens": ["a", "b"], "code_tokens": ["f"], "url": "u"}) + "\n")
    q, c = benchmarks.csn_original(spark, str(tmp_path / "csn"))
    assert (q.first().question, q.first().lang, c.first().id) == ("a b", "go", "u")


def test_registry(spark):
    assert registry.compose("tf-idf--custom-analyzer", k=3).options == {"analyzer": "v2"}
    with pytest.raises(KeyError):
        registry.compose("none")
    with pytest.raises(TypeError):
        registry.compose("hashed-words", size=1)
    assert registry.str2bool("Yes") and not registry.str2bool("0")
    q = spark.createDataFrame([(1, "sort the list")], "query int, question string")
    c = spark.createDataFrame([(1, "sort the list of things"), (2, "open a file"), (3, None)], "id int, text string")
    for name in ("hashed-words", "tf-idf--default-analyzer"):
        assert registry.predict(registry.compose(name, k=1), q, c).first().doc == 1


def test_stream(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for f in range(3):
        (tmp_path / "s" / f"{f}.json").write_text("".join(json.dumps({"k": 10 * f + i}) + "\n" for i in range(10)))
    rows = read_stream(spark, str(tmp_path / "s"), "k long", 1)
    stream_batches(rows, "k", 4, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r.k for r in got.collect()) == list(range(30)) and got.filter(F.col("place") >= 4).count() == 0


def test_corrupt_lines(spark, tmp_path):
    """Lines that are no JSON are never lost in silence."""
    src = _repos(tmp_path, _file("a.py", "Python", PY))
    assert [r.line for r in jsonl.corrupt_lines(spark, src, jsonl.REPO).collect()] == ["not json"]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, src, jsonl.REPO).collect()


def test_replace(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    with pytest.raises(Exception):
        jsonl.replace_jsonl(spark, str(tmp_path / "d"), lambda df: df.withColumn("x", F.raise_error(F.lit("no"))), "x INT")
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    jsonl.replace_jsonl(spark, str(tmp_path / "d"), lambda df: df.filter("x > 1"), "x INT")
    assert [r.x for r in spark.read.json(str(tmp_path / "d")).collect()] == [2] and not (tmp_path / "d.old").exists()


def test_answers_missing(spark):
    p = spark.createDataFrame([(1, "q", [("a", "t", 1.0), ("b", "u", 0.5)])], "k int, question string, candidates array<struct<id:string,text:string,score:double>>")
    answers = spark.createDataFrame([("q", "t", "yes")], "question string, text string, answer string")
    assert [(r["rank"], r.answer) for r in put_back(p, answers, 1, ["k"]).orderBy("rank").collect()] == [(1, "yes"), (2, None)]
    with pytest.raises(Exception, match="no answer"):
        put_back(p, answers, 2, ["k"]).collect()
