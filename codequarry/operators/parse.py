"""Source files to spans: comments by their style, snippets by declaration patterns and matching ends.

There is no grammar library here. Comments and literals are found by one regular expression per style; declarations by patterns over the code
with comments and literals blanked; their ends by brackets, indentation or ``end``. Spans are UTF-8 byte offsets; points are 0-based [row, byte column].
Ids are hashes of file, kind and place, so that a second run gives the same.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .gate import with_status
from .languages import BY_NAME

_DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_LONG = r'"""[\s\S]*?"""'
_SLASHES = r"(?P<one>//[^\n]*)|(?P<many>/\*[\s\S]*?\*/)"
#: By style: group one is a comment of a line, many a block comment; anything else that matches is a literal.
STYLES = {
    "cpp": rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|`(?:[^`\\]|\\[\s\S])*`",
    "java": rf"{_SLASHES}|{_LONG}|{_DOUBLE}|'(?:[^'\\\n]|\\.)'",
    "scala": rf"{_SLASHES}|{_LONG}|{_DOUBLE}",
    "py": rf"(?P<one>\#[^\n]*)|(?P<many>(?:(?<=\n)|\A|(?<=[ \t:;]))(?:[rRuU]?(?:{_LONG}|'''[\s\S]*?''')))|{_LONG}|'''[\s\S]*?'''|{_DOUBLE}|{_SINGLE}",
    "julia": rf"(?P<many>{_LONG}|{_DOUBLE})|(?P<one>\#[^\n]*)",
    "lua": rf"(?P<many>--\[\[[\s\S]*?\]\])|(?P<one>--[^\n]*)|{_DOUBLE}|{_SINGLE}|\[\[[\s\S]*?\]\]",
    "ruby": rf"(?P<many>^=begin\b[\s\S]*?^=end\b[^\n]*)|(?P<one>\#(?!\{{)[^\n]*)|{_DOUBLE}|{_SINGLE}",
    "r": rf"(?P<one>\#[^\n]*)|{_DOUBLE}|{_SINGLE}",
}
_STYLES = {k: re.compile(v, re.M) for k, v in STYLES.items()}
_N = r"(?P<name>[^\W\d]\w*)"
_ARGS = r"\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)"
_NO = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|sizeof|match)\b)"
#: By language: (kind, pattern, how it ends). The pattern ends where the body begins: brace, indent or end.
DECLARATIONS = {
    "C": [("struct_specifier", rf"\bstruct[ \t]+{_N}\s*\{{", "brace"), ("function_definition", rf"^(?:\w++[ \t*\n]++)+?{_NO}{_N}\s*+{_ARGS}\s*+\{{", "brace")],
    "C++": [("class_specifier", rf"\bclass[ \t]+{_N}[^;{{}}()]*\{{", "brace"), ("function_definition", rf"^[ \t]*+(?:[\w:<>,~]++[ \t*&\n]++)+?{_NO}(?:\w+::)?{_N}\s*+{_ARGS}[^;{{}}()]*+\{{", "brace"), ("namespace_definition", rf"\bnamespace[ \t]*{_N}?\s*\{{", "brace")],
    "C#": [("class_declaration", rf"\bclass[ \t]+{_N}[^;{{}}]*\{{", "brace"), ("namespace_declaration", rf"\bnamespace[ \t]+(?P<name>[\w.]+)\s*\{{", "brace"), ("method_declaration", rf"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)*[\w<>\[\],.?]+\s+{_NO}{_N}\s*(?:<[^<>]*>)?\s*{_ARGS}\s*\{{", "brace")],
    "CSS": [("rule_set", r"(?P<name>[^{};@]+)\{", "brace")],
    "Go": [("function_declaration", rf"^func[ \t]+{_N}\s*(?:\[[^\]]*\])?{_ARGS}[^\n{{]*\{{", "brace"), ("type_declaration", rf"^type[ \t]+{_N}[^\n{{]*\{{", "brace")],
    "Java": [("class_declaration", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*class[ \t]+{_N}[^;{{}}]*\{{", "brace"), ("method_declaration", rf"^[ \t]*(?:@\w+(?:{_ARGS})?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^<>]*>\s*)?[\w.<>,?\[\]]+\s+{_NO}{_N}\s*{_ARGS}[^;{{}}()]*\{{", "brace")],
    "JavaScript": [("class_declaration", rf"\bclass[ \t]+{_N}[^;{{}}()]*\{{", "brace"), ("function_declaration", rf"\b(?:async[ \t]+)?function[ \t]*\*?[ \t]*{_N}\s*{_ARGS}\s*\{{", "brace"), ("method_definition", rf"^[ \t]*(?:(?:static|async|get|set)[ \t]+)*\*?{_NO}(?!function\b){_N}[ \t]*{_ARGS}\s*\{{", "brace")],
    "Julia": [("struct_definition", rf"^[ \t]*(?:mutable[ \t]+)?struct[ \t]+{_N}", "end"), ("function_definition", rf"^[ \t]*function[ \t]+(?:\w+\.)?{_N}", "end")],
    "Lua": [("function_declaration", rf"^[ \t]*(?:local[ \t]+)?function[ \t]+(?:\w+[.:])*{_N}[ \t]*{_ARGS}", "end")],
    "PHP": [("class_declaration", rf"\bclass[ \t]+{_N}[^;{{}}()]*\{{", "brace"), ("function_definition", rf"^[ \t]*function[ \t]+&?{_N}\s*{_ARGS}[^;{{}}()]*\{{", "brace"), ("method_declaration", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)+function[ \t]+&?{_N}\s*{_ARGS}[^;{{}}()]*\{{", "brace")],
    "Python": [("function_definition", rf"^[ \t]*(?P<at>(?:async[ \t]+)?def[ \t]+{_N})", "indent"), ("class_definition", rf"^[ \t]*(?P<at>class[ \t]+{_N})", "indent")],
    "R": [("binary_operator", rf"^[ \t]*{_N}[ \t]*(?:<-|=)[ \t]*function[ \t]*{_ARGS}\s*\{{", "brace")],
    "Ruby": [("class", rf"^[ \t]*(?P<at>class[ \t]+(?:\w+::)*{_N})", "end"), ("method", r"^[ \t]*(?P<at>def[ \t]+(?P<name>[^\W\d]\w*[?!=]?)(?![.\w]))", "end")],
    "Rust": [("struct_item", rf"\bstruct[ \t]+{_N}[^;{{}}]*\{{", "brace"), ("function_item", rf"\bfn[ \t]+{_N}\s*(?:<[^{{}}]*?>)?\s*{_ARGS}[^;{{}}]*\{{", "brace"), ("impl_item", rf"^[ \t]*impl\b(?:<[^{{}}]*?>)?[ \t]*(?:[\w:<>,' ]+?[ \t]+for[ \t]+)?{_N}[^;{{}}]*\{{", "brace")],
    "Scala": [("class_definition", rf"\bclass[ \t]+{_N}[^;{{}}\n]*\{{", "brace"), ("function_definition", rf"\bdef[ \t]+{_N}[^={{}}\n]*=?[ \t]*\{{", "brace")],
}
DECLARATIONS["TypeScript"] = DECLARATIONS["JavaScript"]
_DECLARATIONS = {k: [(kind, re.compile(p, re.M), how) for kind, p, how in v] for k, v in DECLARATIONS.items()}
_OPENERS = re.compile(r"(?<![.\w:])(?:(?P<open>def|class|module|begin|case|function|struct|do|then|repeat|macro|let|quote|try)|(?P<line>if|unless|while|until|for)|(?P<close>end|until))\b(?![?!:])")


def _end(code: str, start: int, behind: int, how: str, language: str) -> int:
    """Where the declaration that begins at ``start`` and whose header ends at ``behind`` ends."""
    if how == "brace":
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, behind - 1):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end()
        return len(code)
    if how == "indent":
        column = start - (code.rfind("\n", 0, start) + 1)
        end = code.find("\n", behind)
        end = len(code) if end < 0 else end
        depth = 0
        for m in re.compile(r"[^\n]*(?:\n|\Z)").finditer(code, code.rfind("\n", 0, start) + 1):
            line = m[0]
            if m.start() > start and depth <= 0 and line.strip() and len(line) - len(line.lstrip()) <= column:
                break
            depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
            if line.strip():
                end = m.start() + len(line.rstrip())
            if m.end() >= len(code):
                break
        return end
    depth = 0
    words = {"Lua": ("function", "do", "then", "repeat"), "Ruby": ("def", "class", "module", "begin", "case", "do"), "Julia": ("function", "struct", "begin", "do", "macro", "let", "quote", "try", "module")}[language]
    for m in _OPENERS.finditer(code, start):
        w = m[0]
        before = code[code.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        if w == "end" or w == "until" and language == "Lua":
            depth -= 1
        elif w in words and not (w == "then" and re.search(r"\belseif\b", before)) and not (w == "do" and language == "Ruby" and re.match(r"(?:while|until|for)\b", before)):
            depth += 1
        elif m["line"] and language != "Lua" and (not before or before[-1] in "=(,"):
            depth += 1
        if depth <= 0:
            return m.end()
    return len(code)


def parse(text: str, language: str) -> tuple[list[dict], list[dict]]:
    """(snippets, comments) of a file, by place. A block literal counts as a comment in Python where it is a statement of its own, and in Julia everywhere."""
    style = BY_NAME[language].comments
    breaks = [m.end() for m in re.finditer("\n", text)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    bytes_before = None if text.isascii() else np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
    whole = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def byte(i: int) -> int:
        return i if bytes_before is None else int(bytes_before[i])

    def point(i: int) -> list[int]:
        row = bisect_right(breaks, i)
        return [row, byte(i) - byte(breaks[row - 1] if row else 0)]

    def last_before(i: int) -> str:
        """The last character before i that isn't blank."""
        while i and text[i - 1].isspace():
            i -= 1
        return text[i - 1] if i else ""

    def span(kind: str, a: int, b: int) -> dict:
        key = hashlib.sha256(f"{kind}\0{a}\0{b}\0{whole}".encode()).hexdigest()
        return {"id": key[:32], "start_byte": byte(a), "end_byte": byte(b), "start_point": point(a), "end_point": point(b)}

    comments, blank, at = [], [], 0
    for m in _STYLES[style].finditer(text):
        kind = m.lastgroup
        if style == "py" and kind == "many":
            before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            after = text[m.end() : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
            kind = "many" if not before.strip() and not after.split("#")[0].strip() and last_before(m.start()) not in ("(", ",", "[", "{", "=", "+", "\\") else None
        if kind:
            many = kind == "many"
            comments.append(span("comment", m.start(), m.end()) | {"is_multi_line": many})
        blank += text[at : m.start()], re.sub(r"[^\n]", " ", m[0])
        at = m.end()
    code = "".join([*blank, text[at:]])
    found: dict[int, tuple[str, str, int, int]] = {}
    for kind, p, how in _DECLARATIONS.get(language, []):
        for m in p.finditer(code):
            start = m.start("at") if "at" in m.groupdict() else m.start() + len(m[0]) - len(m[0].lstrip())
            if start not in found:
                found[start] = (kind, (m["name"] or "").strip(), m.end(), _end(code, start, m.end(), how, language))
    snippets, around = [], []
    for start in sorted(found):
        kind, name, head, end = found[start]
        while around and around[-1][0] <= start:
            around.pop()
        scope = "".join(h for _, h in around) if BY_NAME[language].scoped else ""
        snippets.append(span(kind, start, end) | {"scope": scope, "type": kind, "identifier": name})
        around.append((end, text[text.rfind("\n", 0, start) + 1 : head] + "\n"))
    return snippets, comments


_SPAN = "start_byte:int, end_byte:int, start_point:array<int>, end_point:array<int>"
PARSED = f"snippets array<struct<id:string, scope:string, type:string, identifier:string, {_SPAN}>>, comments array<struct<id:string, is_multi_line:boolean, {_SPAN}>>, failed string"


def parse_files(files: DataFrame, seconds: float = 20.0) -> DataFrame:
    """The files with status, snippets and comments. Files that the gate holds back, and those that fail, have empty lists and say why in status; others say success.

    Sizes are taken as given. A null content counts as an empty file. A file that takes longer than ``seconds`` is given up as TimeoutError.
    """
    gated = with_status(files.drop("snippets", "comments"))

    @F.pandas_udf(PARSED.replace(" array", ": array").replace("failed string", "failed: string").join(["struct<", ">"]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import signal
        import threading

        timed = threading.current_thread() is threading.main_thread()

        def late(*_: object) -> None:
            raise TimeoutError

        if timed:
            signal.signal(signal.SIGALRM, late)
        for texts, langs in parts:
            rows = []
            for t, lang in zip(texts, langs):
                try:
                    if timed:
                        signal.setitimer(signal.ITIMER_REAL, seconds)
                    rows.append((*parse(t, lang), None) if t is not None else ([], [], None))
                except Exception as e:  # noqa: BLE001 - any failure becomes the file's status
                    rows.append(([], [], type(e).__name__))
                finally:
                    if timed:
                        signal.setitimer(signal.ITIMER_REAL, 0)
            yield pd.DataFrame(rows, columns=["snippets", "comments", "failed"])

    # one pass: files that the gate holds back go to the parser as null
    read = gated.select("*", F.explode(F.array(run(F.when(F.col("status").isNull(), F.coalesce("content", F.lit(""))), "language"))).alias("_p"))
    return read.withColumn("status", F.coalesce("status", "_p.failed", F.lit("success"))).withColumn("snippets", F.col("_p.snippets")).withColumn("comments", F.col("_p.comments")).drop("_p")
