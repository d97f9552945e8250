"""Text functions as column expressions: comment cleaning, query extraction, analyzers, byte spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ASCII white space, which marker stripping uses, and the wider set that text stripping uses.
ASCII_SPACE = " \t\n\r\x0b\x0c"
_WIDE = r"[\s\x0b\x1c-\x1f\x85   -     　]"
_LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
WORD = r"[\p{L}\p{N}_]+"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\p{Nd}+"

# Comment markers by language, and the line prefixes at which a description ends or that it leaves out.
HASH, DASH = ("Python", "Julia", "Ruby", "R"), ("Lua",)
SKIP_LINES = ("C", "C++", "Java", "JavaScript", "Kotlin", "Lua", "PHP", "Ruby", "TypeScript")
SKIP_PREFIXES = ("return:", "returns:", "\\param", "\\return", "-")
PYTHON_STOPS = ("arguments", "args", "param", "example", ":param", ":return", ":type", ":rtype", ":raises", "todo:", "pylint:", "@param", "@return", "---", ">>>")
GO_STOPS = ("@param", "@return", "- ")
PAIR_LANGUAGES = ("C", "C#", "C++", "Go", "Java", "JavaScript", "Julia", "Kotlin", "Lua", "PHP", "Python", "R", "Ruby", "Rust", "Scala", "TypeScript")


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is evaluated once, however often it is read there."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(c, f"^{_WIDE}+|{_WIDE}+$", "")


def split_lines(c: Column) -> Column:
    """The lines of a text; a line end at the end of the text begins no further line, an empty text has none."""
    return let(F.split(c, _LINE_END, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def trim_set(c: Column, left: str = "", right: str = "") -> Column:
    if left == right:
        return F.btrim(c, F.lit(left))
    c = F.ltrim(c, F.lit(left)) if left else c
    return F.rtrim(c, F.lit(right)) if right else c


def clean_single_line_comment(c: Column, lang: Column) -> Column:
    """A comment line without its markers on the left: ``#``, ``-`` or ``/`` by language, and white space."""
    return F.when(lang.isin(*HASH), trim_set(c, "#" + ASCII_SPACE)).when(lang.isin(*DASH), trim_set(c, "-" + ASCII_SPACE)).otherwise(trim_set(c, "/" + ASCII_SPACE))


def clean_single_line_group(c: Column, lang: Column) -> Column:
    """Each line of a group of comment lines without its markers; empty lines stay."""
    return F.array_join(F.transform(split_lines(c), lambda x: clean_single_line_comment(x, lang)), "\n")


def clean_multi_line_comment(c: Column, lang: Column) -> Column:
    """A block comment without its markers; null for a language that has none here."""
    marks = "/*" + ASCII_SPACE
    lines = F.array_join(F.filter(F.transform(split_lines(c), lambda x: F.btrim(x, F.lit(marks))), lambda x: x != ""), "\n")
    ruby = F.when(c.startswith("=begin") & c.endswith("=end"), strip(F.substring(c, 7, F.greatest(F.char_length(c) - 10, F.lit(0))))).otherwise(c)
    return (
        F.when(lang == "Python", F.btrim(c, F.lit("\"'" + ASCII_SPACE)))
        .when(lang == "Julia", F.btrim(c, F.lit('"' + ASCII_SPACE)))
        .when(lang == "Lua", trim_set(c, "-[" + ASCII_SPACE, "-]" + ASCII_SPACE))
        .when(lang == "Ruby", ruby)
        .when(lang.isin(*PAIR_LANGUAGES), lines)
    )


def clean_brief(c: Column) -> Column:
    """The text without the first of ``@brief``, ``\\brief`` and ``!`` with a line of ``\\brief`` that it begins with."""

    def cut(x: Column) -> Column:
        out = x
        for mark in ("!\n\\brief", "\\brief", "@brief"):
            out = F.when(x.startswith(mark), F.ltrim(F.substring(x, len(mark) + 1, 1 << 30), F.lit(ASCII_SPACE))).otherwise(out)
        return out

    return let(c, cut)


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def _lines_until(lines: Column, stop) -> Column:
    """The lines before the first for which stop holds."""

    def before(x: Column) -> Column:
        return let(F.array_position(F.transform(x, stop), True), lambda at: F.when(at > 0, F.slice(x, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(x))

    return let(lines, before)


def _kept(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def query_skip(c: Column, identifier: Column) -> Column:
    """Lines up to an example list, without tag lines, lines that hold the identifier in lower case, and stop prefixes."""
    lines = F.transform(split_lines(c), strip)
    lines = _lines_until(lines, lambda x: F.lower(x).startswith("-") & F.contains(F.lower(x), F.lit("example")))

    def keep(line: Column) -> Column:
        return let(F.lower(line), describes)

    def describes(low: Column) -> Column:
        first = F.element_at(F.split(low, r"\s+"), 1)
        tag = low.startswith("@") & ~low.startswith("@brief")
        return ~(F.contains(low, identifier) | _starts(low, SKIP_PREFIXES) | tag | F.coalesce(first.endswith(":"), F.lit(False)))

    return _kept(F.filter(lines, keep))


def query_break(c: Column, stops: tuple[str, ...]) -> Column:
    """Lines before the first that begins with a stop prefix."""
    lines = F.transform(split_lines(c), strip)
    return _kept(_lines_until(lines, lambda x: _starts(F.lower(x), stops)))


def query_summary(c: Column) -> Column:
    """What stands between the first ``<summary>`` and the first ``</summary>``, if both are there; nothing if they come in the wrong order."""

    def cut(x: Column) -> Column:
        a, b = F.instr(x, "<summary>"), F.instr(x, "</summary>")
        inner = F.when(b > a, F.substring(x, a + 9, F.greatest(b - a - 9, F.lit(0)))).otherwise("")
        return F.when((a > 0) & (b > 0), inner).otherwise(x)

    return strip(let(c, cut))


def comment_to_query(c: Column, lang: Column, identifier: Column) -> Column:
    """The describing part of a cleaned comment; null for languages without a rule (such pairs go to the rejects)."""
    return (
        F.when(lang.isin(*SKIP_LINES), query_skip(c, identifier))
        .when(lang == "C#", query_summary(c))
        .when(lang.isin("Rust", "R", "Scala"), strip(c))
        .when(lang == "Python", query_break(c, PYTHON_STOPS))
        .when(lang == "Go", query_break(c, GO_STOPS))
    )


def extension(path: Column) -> Column:
    """The last suffix of the base name with its dot; names that only begin with dots have none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def is_function(kind: Column, lang: Column) -> Column:
    return F.when(lang == "R", kind == "binary_operator").otherwise(kind.startswith("function") | kind.startswith("method"))


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """Bytes start to end (0-based, exclusive) of the UTF-8 text; null where they are no valid text."""
    return text_between(F.encode(c, "UTF-8"), start, end)


def text_between(data: Column, start: Column, end: Column) -> Column:
    """byte_slice() of the text's bytes."""
    piece = F.substring(data, start + 1, F.greatest(end - start, F.lit(0)))
    return F.when(F.is_valid_utf8(piece.cast("string")), piece.cast("string"))


def split_camel(c: Column) -> Column:
    """The parts of a camel-case name; the name itself if there are none."""
    return let(F.regexp_extract_all(c, F.lit(CAMEL), F.lit(0)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(c)))


def grams(words: Column, most: int = 3) -> Column:
    """All runs of one to ``most`` words, joined by a blank. words: better a column than an expression, as it is read for each run."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *(runs(n) for n in range(2, most + 1)))


def words_v1(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def words_v2(c: Column) -> Column:
    return F.transform(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), split_camel)), F.lower)


#: The words of an analyzer; its terms are their grams.
ANALYZERS = {"v1": words_v1, "v2": words_v2}


def answer_to_label(c: Column, thinks: bool = True) -> Column:
    """1 for an answer that begins with yes, 0 for no, else -1; of a reasoning answer, what follows the first ``</think>`` counts."""
    at = F.instr(c, "</think>")
    rest = F.when(at > 0, F.substring(c, at + 8, 1 << 30)) if thinks else c
    low = F.lower(strip(rest))
    return F.when(low.startswith("yes"), 1).when(low.startswith("no"), 0).otherwise(-1)
