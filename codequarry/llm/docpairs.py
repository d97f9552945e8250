"""Problem 5: functions and methods of source files, each with its documentation.

Signatures are found by regular expressions over the code with comments and literals blanked out; bodies end where their indentation, or
the stack of brackets or ``end`` keywords, says so; the comment that ends on the row above (or a Python string that opens the body) is
the documentation.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .grammar import is_valid
from .lexers import LANGUAGES, Lexed, lex
from .once import once_each
from .prose import _CJK, Rows, comment_lines, comment_runs, literal_text, paragraphs, words

_ID = r"[^\W\d]\w*+"
# What is no name of a function although a parenthesis follows it.
_CONTROL = r"(?:if|for|while|switch|catch|return|else|do|function|sizeof|synchronized|new|throw|foreach|elseif|match|await|with|super|this|try|using|lock|not|and|or|typeof|delete|void|in|of|case|defer|go|select|range|echo|print|isset|empty|unset|array|list|exit|die|declare|use)\b"
_NAME = r"(?P<name>[^\W\d][\w$]*+|[$][\w$]*+)"
_FN = r"(?:async[ \t]++)?function\b[ \t]*+(?:\*[ \t]*+)?"
_ARROW = r"(?:async[ \t]++)?(?:[\w$]++[ \t]*+=>\s*+|(?=\())"
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|readonly)[ \t]++)*+"
# Signatures: (head, tails). The head ends at the parenthesis of the parameters, or where nothing follows that matters. Behind the parenthesis that
# closes them, one of the tails has to match; where it ends, the body begins (brace languages: with the brace).
SIGNATURES: dict[str, list[tuple[str, str | None]]] = {
    "Python": [(rf"^[ \t]*+(?:async[ \t]++)?def[ \t]++(?P<name>{_ID})[ \t]*+(?:\[[^\]\n]*+\])?[ \t]*+(?=\()", "")],
    "Ruby": [(rf"^[ \t]*+(?:(?:private|public|protected|module_function|private_class_method)[ \t]++)?def[ \t]++(?:(?:self|{_ID})\.)?(?P<name>{_ID}[?!=]?|[-+*/<=>!%\[\]~^&|]++)", None), (rf"^[ \t]*+define_method[ \t]*+\(?[ \t]*+:(?P<name>{_ID}[?!=]?)\)?[ \t]++(?=do\b|\{{)", None)],
    "Lua": [(rf"^[ \t]*+(?:local[ \t]++)?function[ \t]++(?:{_ID}[.:])*(?P<name>{_ID})[ \t]*+(?=\()", None), (rf"^[ \t]*+(?:local[ \t]++)?(?:{_ID}\.)*(?P<name>{_ID})[ \t]*+=[ \t]*+function\b", None)],
    "Go": [
        (rf"^[ \t]*+func[ \t]++(?P<name>{_ID})[ \t]*+(?:\[[^\]\n]*+\])?[ \t]*+(?=\()", r"(?:(?:interface|struct)[ ]?\{\}|[^{}\n;])*+\{"),
        (rf"^[ \t]*+(?:var[ \t]++)?(?P<name>{_ID})[ \t]*+:?=[ \t]*+func[ \t]*+(?=\()", r"(?:(?:interface|struct)[ ]?\{\}|[^{}\n;])*+\{"),
    ],
    "JavaScript": [
        (rf"^[ \t]*+(?:export[ \t]++(?:default[ \t]++)?)?{_FN}{_NAME}\s*+(?=\()", r"\s*+\{"),
        (rf"^[ \t]*+(?:export[ \t]++)?(?:(?:const|let|var)[ \t]++|(?:[\w$]++\.)*){_NAME}[ \t]*+=[ \t]*+(?:{_FN}[\w$]*+\s*+(?=\()|{_ARROW})", r"\s*+\{|[ \t]*+=>\s*+"),
        (rf"^[ \t]*+(?:(?:static|async|get|set)[ \t]++)*[*#]?(?!{_CONTROL}){_NAME}[ \t]*+(?=\()", r"[ \t\r\n]*+\{"),
        (rf"^[ \t]*+{_NAME}[ \t]*+:[ \t]*+(?:{_FN}[\w$]*+\s*+(?=\()|{_ARROW})", r"\s*+\{|[ \t]*+=>\s*+"),
    ],
    "PHP": [
        (rf"^[ \t]*+{_MODIFIERS}function\s*+&?\s*+(?P<name>{_ID})\s*+(?=\()", r"\s*+(?::\s*+[?\w\\|&() ]++)?\s*+\{"),
        (rf"^[ \t]*+(?:\$this->|self::|static::)?\$?(?P<name>{_ID})[ \t]*+=[ \t]*+(?:static[ \t]++)?(?:function\s*+&?|fn)\s*+(?=\()", r"\s*+(?:use\s*+\([^()]*+\)\s*+)?(?::\s*+[?\w\\|&() ]++)?\s*+(?:\{|=>)"),
    ],
}
_SIGNATURES = {k: [(re.compile(x, re.M), re.compile(y) if y is not None else None) for x, y in v] for k, v in SIGNATURES.items()}
_RECEIVER = re.compile(r"^[ \t]*+func[ \t]*+(?=\()", re.M)
_METHOD = re.compile(rf"[ \t]*+(?P<name>{_ID})[ \t]*+(?:\[[^\]\n]*+\])?[ \t]*+(?=\()")
# C and Java have no word for functions: any name, parenthesis and brace, and what stands before it since the last statement.
_CALL = {"C": re.compile(rf"\b(?!{_CONTROL})(?P<name>{_ID})\s*+(?=\()"), "Java": re.compile(rf"(?<![\w$.@])(?!{_CONTROL})(?P<name>[^\W\d][\w$]*+)\s*+(?=\()")}
_BODY = {"C": re.compile(r"\s*+(?:__attribute__\s*+\(\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\)\s*+)*+\{"), "Java": re.compile(r"\s*+(?:\[\s*+\]\s*+)*+(?:throws\s++[\w$.,\s]++)?\{")}
_BACKWARDS = re.compile(r"[\w\s*]*+")
_JAVA_HEAD = re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s++)*+\s*+(?:(?!(?:class|record|enum|interface|new|return|throw|else|case)\b)[\w$.]++(?:\s*+\[\s*+\])*+\s++)?")
_JUNK = re.compile(r"[ \t\r\n\f),]*+")  # what may be left of an annotation with braces in it
_ANNOTATION = re.compile(r"@[\w$.]++\s*+(\()?")
_RUBY = re.compile(r"(?P<n>\n)|(?<![.\w:@$])(?:(?P<o>def|class|module|begin|case|do)\b(?![?!:])|(?P<c>if|unless|while|until|for)\b(?![?!:])|(?P<e>end)\b(?![?!:=]))|(?P<x>\w++[?!]?|\S)")
_RUBY_DEF = re.compile(r"def[ \t]++[\w.?!]++[ \t]*+")
_RUBY_BEFORE = frozenset(("", "=", "(", ";", ",", "|", "&", "{", "[", "then", "do", "else"))
_LUA = re.compile(r"\b(?:(?P<o>function|if|repeat|while|for)|(?P<d>do)|(?P<e>end|until))\b")
_NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IS = re.compile(r"[ \t]*+=(?!=)")
_BRACKET = re.compile(r"[(\[{]|[)\]}]")
_LINES = re.compile(r"^([ \t]*+)(\S?)[^\n]*+(?:\n|\Z)", re.M)
_BLANKS = re.compile(r"[ \t]*+")
_DIRECTIVES = re.compile(r"^[ \t]*+#(?:[^\\\n]++|\\\r?\n|\\)*+", re.M)


def blanked(text: str, lexed: Lexed) -> str:
    """The text with comments and string literals replaced by blanks of the same length; line breaks stay."""
    out, at = [], 0
    for a, b in sorted([*lexed.comments, *lexed.strings]):
        if a < at:
            continue
        out += text[at:a], re.sub(r"[^\r\n]", " ", text[a:b]) if "\n" in text[a:b] or "\r" in text[a:b] else " " * (b - a)
        at = b
    return "".join([*out, text[at:]])


class Code:
    """The text without comments and literals, and where its brackets and blocks close: found once for the whole text."""

    def __init__(self, text: str, language: str, lexed: Lexed):
        self.language = language
        self.text = blanked(text, lexed)
        if language == "C":
            self.text = _DIRECTIVES.sub(lambda m: re.sub(r"[^\r\n]", " ", m[0]), self.text)

    @cached_property
    def closing(self) -> dict[int, int]:
        """Behind what closes it, for each bracket."""
        out, stack = {}, []
        for m in _BRACKET.finditer(self.text):
            if m[0] in "([{":
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.end()
        return out

    @cached_property
    def opening(self) -> dict[int, int]:
        return {b - 1: a for a, b in self.closing.items()}

    def closes(self, begin: int) -> int:
        return self.closing.get(begin, len(self.text))

    @cached_property
    def colons(self) -> list[int]:
        return [m.start() for m in re.finditer(":", self.text)]

    @cached_property
    def stops(self) -> list[int]:
        """Where statements and blocks end or begin."""
        return [m.end() for m in re.finditer("[;{}]", self.text)]

    @cached_property
    def ends(self) -> dict[int, int]:
        """Behind the word that ends it, for each word that opens a block (Ruby, Lua)."""
        out: dict[int, int] = {}
        stack: list[list] = []  # where, does its ``do`` come yet
        if self.language == "Lua":
            for m in _LUA.finditer(self.text):
                if m["o"]:
                    stack.append([m.start(), m["o"] in ("while", "for")])
                elif m["d"]:
                    if stack and stack[-1][1]:
                        stack[-1][1] = False
                    else:
                        stack.append([m.start(), False])
                elif stack:
                    out[stack.pop()[0]] = m.end()
            return out
        before = ""
        for m in _RUBY.finditer(self.text):
            if m["n"]:
                before = ""
                if stack:
                    stack[-1][1] = False
                continue
            if m["e"]:
                if stack:
                    out[stack.pop()[0]] = m.end()
            elif m["c"]:
                if before in _RUBY_BEFORE:
                    stack.append([m.start(), m["c"] in ("while", "until", "for")])
            elif m["o"] == "do" and stack and stack[-1][1]:
                stack[-1][1] = False
            elif m["o"] and not (m["o"] == "def" and self.endless(m.start())):
                stack.append([m.start(), False])
            before = m[0]
        return out

    def endless(self, at: int) -> bool:
        """Is the Ruby definition that begins here one without an end?"""
        m = _RUBY_DEF.match(self.text, at)
        if not m:
            return False
        behind = self.closes(m.end()) if self.text[m.end() : m.end() + 1] == "(" else m.end()
        return bool(_IS.match(self.text, behind))

    def indented(self, start: int, line_end: int) -> int:
        """The end of the Python body whose header begins at ``start`` and ends on the line that ends at ``line_end``."""
        depth = len(_BLANKS.match(self.text, start)[0].expandtabs(8))
        end = line_end
        for m in _LINES.finditer(self.text, line_end):
            if m[2] and m[2] != "\r":
                if len(m[1].expandtabs(8)) <= depth:
                    break
                end = m.end()
            if m.end() == len(self.text):
                break
        return end


def _headed(code: Code) -> Iterator[tuple[re.Match, int, int]]:
    """(match with the name, where the first line begins, the brace of the body) of each function of C or Java."""
    text, language = code.text, code.language
    for m in _CALL[language].finditer(text):
        body = _BODY[language].match(text, code.closes(m.end()))
        if not body:
            continue
        i = bisect_right(code.stops, m.start())
        region = code.stops[i - 1] if i else 0
        if language == "C":
            begin = m.start() - _BACKWARDS.match(text[region : m.start()][::-1]).end()
            if begin > 0 and text[begin - 1] != "\n":
                begin = text.find("\n", begin, m.start()) + 1
                if not begin:
                    continue
            head = text[begin : m.start()]
            gap = max((x.end() for x in re.finditer(r"\n[ \t\r]*+\n", head)), default=0)  # what stands above an empty line isn't of it
            begin, head = begin + gap, head[gap:]
            if not re.search(r"\w", head) or re.match(rf"\s*+{_CONTROL}", head):
                continue
            yield m, begin + len(head) - len(head.lstrip()), body.end() - 1
            continue
        begin = at = _JUNK.match(text, region).end()
        while note := _ANNOTATION.match(text, at, m.start()):
            at = _JUNK.match(text, code.closes(note.end() - 1) if note[1] else note.end()).end()
        if _JAVA_HEAD.fullmatch(_without_angles(text[at : m.start()])):
            yield m, begin, body.end() - 1


def _without_angles(x: str) -> str:
    """Java without its type arguments."""
    if "<" not in x:
        return x
    depth, out = 0, []
    for p in re.split("([<>])", x):
        depth += (p == "<") - (p == ">")
        if not depth and p != ">":
            out.append(p)
    return "".join(out)


def functions_of(text: str, language: str, lexed: Lexed | None = None, code: Code | None = None) -> Iterator[tuple[str, int, int, int, Callable[[], int]]]:
    """(name, where the name is, where its first line begins, where the header ends, a call that tells where the body ends) of each named function, by place."""
    lexed = lexed or lex(text, language)
    code = code or Code(text, language, lexed)
    plain = code.text
    found: dict[int, tuple] = {}
    if language in _CALL:
        for m, start, brace in _headed(code):
            found[m.start("name")] = (m["name"], m.start("name"), start, brace + 1, partial(code.closes, brace))
    for head, tail in _SIGNATURES.get(language, []):
        for m in head.finditer(plain):
            if m.start("name") in found:
                continue
            start = m.start()
            behind = m.end()
            if plain[behind : behind + 1] == "(" and tail is not None:
                behind = code.closes(behind)
                if not (t := tail.match(plain, behind)):
                    continue
                behind = t.end()
            if (got := _body(code, m, start, behind)) is not None:
                found[m.start("name")] = (m["name"], m.start("name"), start, *got)
    if language == "Go":
        tail = _SIGNATURES["Go"][0][1]
        for r in _RECEIVER.finditer(plain):
            m = _METHOD.match(plain, code.closes(r.end()))
            if m and (t := tail.match(plain, code.closes(m.end()))):
                found[m.start("name")] = (m["name"], m.start("name"), r.start(), t.end(), partial(code.closes, t.end() - 1))
    for at in sorted(found):
        yield found[at]


def _body(code: Code, m: re.Match, start: int, behind: int) -> tuple[int, Callable[[], int]] | None:
    """(where the header ends, a call that tells where the body ends) of a function whose signature ends at ``behind``."""
    plain = code.text
    if code.language == "Python":
        i = bisect_left(code.colons, behind)
        if i == len(code.colons):
            return None
        colon = code.colons[i]
        return colon + 1, partial(code.indented, start, plain.find("\n", colon) + 1 or len(plain))
    if code.language in ("Ruby", "Lua"):
        word = re.compile(r"\b(?:def|define_method|function)\b").search(plain, start)
        if code.language == "Ruby":
            if plain.startswith("def", word.start()) and code.endless(word.start()):
                return m.end(), partial(int, plain.find("\n", m.end()) + 1 or len(plain))
            if word[0] == "define_method" and plain[m.end()] == "{":
                return m.end(), partial(code.closes, m.end())
        opener = m.end() if word[0] == "define_method" else word.start()
        return m.end(), lambda: code.ends.get(opener, len(plain))
    if plain[behind - 1] == "{":
        return behind, partial(code.closes, behind - 1)
    if plain[behind : behind + 1] and plain[behind] in "{([":
        return behind + 1, partial(code.closes, behind)
    at = re.compile(r"[;\n]").search(plain, behind)
    return behind, partial(int, at.end() if at else len(plain))


# Words of notes that stand in for missing text: at the start of any description; where nothing but filler follows them.
_NOTE = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|lorem ipsum|auto-?generated|generated by)(?![^\W\d_])")
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:hack|n/?a|none|dummy|stub|placeholder|no (?:docs?|documentation|descriptions?|comments?)|(?:add|write|insert|put|missing|needs?)\b.{0,20}\b(?:docs?|documentation|description|docstring|comment|text)|description (?:goes )?here|document(?:ation)? (?:goes |to be |will be )|to be (?:done|written|documented)|coming soon|not documented|undocumented|see above|same as above|fill (?:me|this) in|description of\b.{0,20}(?:function|method))(?![^\W\d_])"
)
_FILLER = frozenset("a an the to no not goes this that it one here there yet now later soon on is be will for of so far at all and or in please only just needed necessary available provided added written done item function method class module procedure routine doc docs docstring documentation description comment comments text stub placeholder dummy none todo fixme tbd".split())


def _stands_in(description: str, name: str) -> bool:
    """Is the description, but for filler and the function's name, a note that stands in for missing text?"""
    if _NOTE.match(description):
        return True
    m = _PLACEHOLDER.match(description)
    own = _FILLER | {x.lower() for x in _NAMES.findall(name)} | {name.lower()}
    return bool(m) and {x.lower() for x in re.findall(r"[^\W\d_]+", description[m.end() :])} <= own


def description_of(lines: list[str]) -> str:
    """The describing text of cleaned comment lines: what stands before tags, sections and code."""
    return "\n".join(paragraphs(lines, description=True))


def is_real(description: str, name: str, least_words: int = 5, least_chars: int = 10) -> bool:
    """Does the description say something: enough words (Chinese, Japanese: characters) that neither repeat the name nor stand in for missing text?"""
    if _stands_in(description, name):
        return False
    if len(_CJK.findall(description)) >= least_chars:
        return True
    own = words(description)
    names = [t for t in description.split() if "_" in t]
    if len(own) + len(names) < least_words:
        return False
    parts = {x.lower() for x in _NAMES.findall(name)}
    said = {y.lower() for x in own + names for y in (_NAMES.findall(x) if x.isascii() else [x])}
    rest = said - parts - {"a", "an", "the", "this", "function", "method", "for", "to", "is", "of", "it", "does", "s"}
    return len(rest) >= 2


def pairs_of(text: str, language: str, lexed: Lexed | None = None) -> list[dict]:
    """The functions with real documentation: name, name_row, start_row, end_row, code, description, kind."""
    lexed = lexed or lex(text, language)
    rows, code = Rows(text, "\n"), Code(text, language, lexed)
    row = rows.of
    by_end: dict[int, tuple[int, int]] = {}
    for a, b in comment_runs(text, lexed):
        if rows.first(row(a)) >= a and _TO_END.match(text, b):
            by_end[row(b - (text[b - 1 : b] == "\n"))] = (a, b)
    strings = dict(lexed.strings) if language == "Python" else {}
    out = []
    for name, at, start, head, ends in functions_of(text, language, lexed, code):
        top = row(start)
        if language in ("Python", "Java", "JavaScript", "PHP"):
            while top and (above := _decorates(text, code, rows, top - 1)) is not None:
                top = above
        docs = []
        if top - 1 in by_end:
            a, b = by_end[top - 1]
            docs.append(("comment", a, description_of(comment_lines(text[a:b]))))
        if language == "Python":
            a = _TO_STRING.match(text, head).end()
            if a in strings and not re.match(r"[bBfF]|[rR][bBfF]", text[a : a + 2]):
                docs.append(("docstring", a, description_of(_dedented(literal_text(text[a : strings[a]])))))
        for kind, a, said in docs:
            if is_real(said, name):
                b = strings[a] if kind == "docstring" else by_end[top - 1][1]
                end = ends()
                out.append({"name": name, "name_row": row(at), "start_row": top, "end_row": row(max(at, end - 1)), "doc_kind": kind, "doc_row": row(a), "description": said, "documentation": text[a:b], "code": text[rows.start(row(start)) : end].rstrip()})
                break
    return out


_TO_END = re.compile(r"[ \t\f\v\r]*+(?:\n|\Z)")
_TO_STRING = re.compile(r"(?:[ \t]*+(?:#[^\n]*+)?\r?\n)*+[ \t]*+")


def _dedented(text: str) -> list[str]:
    lines = re.split(r"\r\n|[\n\r]", text)
    depth = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return [lines[0].strip(), *(x[depth:] for x in lines[1:])]


def _decorates(text: str, code: Code, rows: Rows, i: int) -> int | None:
    """The row at which the decorator or annotation that ends on row i begins; None if there is none."""
    begin = rows.first(i)
    end = rows.ends[i] if i < len(rows.ends) else len(text)
    mark = "#[" if code.language == "PHP" else "@"
    if text.startswith(mark, begin) and (mark != "@" or text[begin + 1 : begin + 2].isalpha() or text[begin + 1 : begin + 2] == "_"):
        return i
    last = len(code.text[begin:end].rstrip()) + begin - 1
    if last >= begin and code.text[last] in ")]" and (at := code.opening.get(last)) is not None:
        j = rows.of(at)
        if j < i and text.startswith(mark, rows.first(j)):
            return j
    return None


_PAIR = T.StructType(
    [T.StructField(n, T.StringType() if n in ("name", "doc_kind", "description", "documentation", "code") else T.LongType()) for n in ("name", "name_row", "start_row", "end_row", "doc_kind", "doc_row", "description", "documentation", "code")]
)


def _read(text: str, language: str) -> list[dict]:
    lexed = lex(text, language)
    pairs = pairs_of(text, language, lexed)
    ok = bool(pairs) and is_valid(text, language, lexed)
    return [{"parses": ok} | p for p in pairs]


def documented_functions(files: DataFrame, key: str = "file_id", content: str = "content", language: str = "language") -> DataFrame:
    """A row (key, parses, name, name_row, start_row, end_row, doc_kind, doc_row, description, documentation, code) for each function or method with real documentation.

    Rows are 0-based and end with LF or CRLF; end_row holds the body's last character. Where a function has a comment and a docstring, the
    comment counts if it is real, else the docstring. Null content, and languages other than the eight, give no rows; files that do not parse
    give rows with ``parses`` false. Repeated rows count each. Other columns, whatever their names, are not looked at.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("parses", T.BooleanType()), *_PAIR.fields])))
    def read(contents: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series(once_each(_read)(contents, langs))

    judged = files.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.col(language).alias("_l")).filter(F.col("_c").isNotNull() & F.col("_l").isin(*LANGUAGES))
    return judged.select(F.col("_k").alias(key), F.explode(read("_c", "_l")).alias("_p")).select(key, "_p.*")
