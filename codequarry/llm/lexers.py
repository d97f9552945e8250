"""Lexers of the eight languages: one regular expression each, run in C over a whole file.

``lex(text, language)`` gives the token classes of the code as one string (a letter per token), and the spans of the comments and
string literals. The letters are those that ``grammar`` states its rules in:

=====  =====================================================================================
i n s  name, number, string literal
= o    assignment (also compound), binary operator
m & u  ``*``, ``&``, ``+ -``: binary or prefix;  ``!`` prefix only;  ``U`` ``++ --``
d Q :  member access, question mark, colon;  ``, ; < >`` themselves;  ``l`` an arrow;  ``e`` an ellipsis
~      a line break, where the language gives it meaning
other  keywords, by language (the tables below)
=====  =====================================================================================

An error (an illegal character, a literal or comment that never ends) makes ``Lexed.error`` say so; the spans up to there are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

LANGUAGES = ("Python", "JavaScript", "Java", "C", "Go", "PHP", "Ruby", "Lua")

Span = tuple[int, int]


@dataclass
class Lexed:
    """classes: a letter per token. starts: where each token begins. comments, strings: spans in characters, string spans with quotes."""

    classes: str = ""
    starts: list[int] = field(default_factory=list)
    comments: list[Span] = field(default_factory=list)
    strings: list[Span] = field(default_factory=list)
    error: str | None = None


def _words(**kinds: str) -> dict[str, str]:
    return {w: k for k, ws in kinds.items() for w in ws.split()}


# The keywords of each language and their token classes.
KEYWORDS = {
    "C": _words(t="int char void float double short long signed unsigned _Bool bool", q="static const inline extern volatile register restrict typedef auto __inline __inline__ __extension__ __volatile__ __const __restrict _Noreturn _Thread_local", T="struct union enum", z="sizeof _Alignof", I="if", E="else", W="while", F="for", D="do", S="switch", K="case", L="default", R="return", J="break continue", G="goto", y="__attribute__ __attribute __declspec _Alignas typeof __typeof__ __typeof _Atomic", a="asm __asm__ __asm"),
    "Java": _words(t="int char void float double short long boolean byte", q="public private protected static final abstract synchronized native transient volatile strictfp non-sealed", C="class interface enum", x="extends implements throws permits", N="new", H="throw", Y="try", X="catch", Z="finally", P="package import", A="assert", V="instanceof", I="if", E="else", W="while", F="for", D="do", S="switch", K="case", L="default", R="return yield", J="break continue"),
    "JavaScript": _words(V="var let const", F="function", a="async", C="class", x="extends", N="new", t="typeof void delete await yield", o="in instanceof", H="throw", Y="try", X="catch", Z="finally", I="if", E="else", W="while", f="for", D="do", S="switch", K="case", L="default", R="return", J="break continue", M="import", B="export"),
    "Go": _words(F="func", V="var const", T="type", R="return", J="break continue fallthrough", G="goto", g="go defer", I="if", E="else", f="for", W="switch select", K="case", L="default", r="range", M="map", c="chan", C="struct interface", P="package", p="import"),
    "PHP": _words(F="function fn", C="class interface trait enum", x="extends implements", q="public private protected static final abstract readonly var const global", N="new clone", t="print include include_once require require_once yield", h="echo", H="throw", Y="try", X="catch", Z="finally", P="use namespace", V="instanceof insteadof", o="and or xor", a="as", I="if elseif", E="else", W="while", f="for", O="foreach", D="do", S="switch match", K="case", L="default", R="return", J="break continue", G="goto", k="endif endwhile endfor endforeach endswitch", j="declare"),
    "Ruby": _words(f="def", c="class module", I="if unless", W="while until", O="for", K="case", w="when in", B="begin", r="rescue", g="ensure", E="else", L="elsif", D="do", e="end", T="then", R="return break next redo retry", o="and or", a="alias undef"),
    "Lua": _words(F="function", I="if", T="then", L="elseif", E="else", e="end", D="do", W="while", O="for", P="repeat", y="until", N="in", V="local", R="return", J="break goto", o="and or"),
    "Python": {},
}
KEYWORDS["Ruby"]["not"] = KEYWORDS["Lua"]["not"] = "!"
# Words of JavaScript that are keywords next to a name only.
_CONTEXTUAL = frozenset("as from of get set static async accessor".split())
# Operators and their token classes, by language; a longer one is tried first.
_C_OPS = {"=": "= += -= *= /= %= &= |= ^= <<= >>=", "o": "== != <= >= && || << >> / % | ^ < >", "U": "++ --", "d": ". ->", "e": "...", "u": "+ -", "m": "*", "&": "&", "!": "! ~", "Q": "?"}
_OPS = {
    "C": _C_OPS,
    "Java": _C_OPS | {"=": _C_OPS["="] + " >>>=", "o": "== != <= >= && || << / % | ^ *", "m": "", "d": ". ::", "l": "->", "<": "<", ">": ">"},
    "JavaScript": _C_OPS | {"=": _C_OPS["="] + " **= >>>= &&= ||= ??=", "o": _C_OPS["o"] + " === !== ** >>> ??  &", "&": "", "d": ". ?.", "l": "=>"},
    "Go": _C_OPS | {"=": _C_OPS["="] + " := &^=", "o": _C_OPS["o"] + " &^", "d": ".", "y": "<-", "!": "!", "u": "+ - ^", "Q": "", "t": "~"},
    "PHP": _C_OPS | {"=": _C_OPS["="] + " .= **= ??=", "o": _C_OPS["o"] + " * === !== <> ** ?? . <=> |>", "m": "", "d": "-> :: ?->", "l": "=>", "!": "! ~ @", "b": "\\"},
    "Ruby": _C_OPS | {"=": _C_OPS["="] + " **= ||= &&=", "o": _C_OPS["o"] + " === =~ !~ <=> ..", "U": "", "d": ". :: &.", "l": "=>", "x": "->", "e": "", "h": "**"},
    "Lua": {"=": "=", "o": "== ~= <= >= < > / // % ^ .. | & << >> +  *", "u": "-", "!": "#", "d": ".", "x": "...", "~": "~"},
}
_OPS["Lua"]["g"] = "::"
_PLAIN = {c: c for c in "()[]{},;:"}
_OPS["Java"]["@"] = _OPS["JavaScript"]["@"] = "@"

_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]++[uUlLn]*|(?:\d[\d_]*+(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?(?:[uUlLfFdDnirj]{0,3}))(?![\w$])"
_DQ, _SQ = r'"(?:[^"\\\n\r]++|\\(?:\r\n|[\s\S]))*+"', r"'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+'"
_DQM, _SQM = r'"(?:[^"\\]++|\\[\s\S])*+"', r"'(?:[^'\\]++|\\[\s\S])*+'"
_BLOCK = r"/\*[\s\S]*?\*/"
_NAME = r"[^\W\d]\w*+"
_JSNAME = r"[$#]?(?:[^\W\d]|\$)[\w$]*+|\$"
#: A regular-expression literal, on one line.
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\r\[]++|\\.|\[(?:[^\]\\\n\r]++|\\.)*+\])++/[a-z]*")

# comment, string and name patterns by language, and others; of these, a group E is what begins a literal or comment that never ends (what does end
# has matched before), T a literal with code inside, h the mark at which a heredoc ends
_PARTS = {
    "C": (rf"//(?:[^\n\r\\]++|\\(?:\r\n|[\s\S]))*+|{_BLOCK}", rf"(?:u8|[uUL])?{_DQ}", _NAME, r"(?P<P>\#[ \t]*(?:(?:include|include_next|import|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|ident|embed)\b|\d|(?=[\r\n]|\Z))(?:[^\n\r\\/]++|\\(?:\r\n|[\s\S])|/(?![*/]))*+)|(?P<H>[uUL]?'(?:[^'\\\n\r]|\\.[0-7a-fA-F]*+){1,4}')|(?P<E>/\*)"),
    "Java": (rf"//[^\n\r]*|{_BLOCK}", rf'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|{_DQ}', r"@interface\b|non-sealed\b|[^\W\d][\w$]*+", r"(?P<H>'(?:[^'\\\n\r]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)')|(?P<E>/\*)"),
    "JavaScript": (rf"//[^\n\r]*|{_BLOCK}|\A\#![^\n\r]*", rf"{_DQ}|{_SQ}|`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{))*+`", _JSNAME, r"(?P<T>`)|(?P<E>/\*)"),
    "Go": (rf"//[^\n\r]*|{_BLOCK}", rf"`[^`]*`|{_DQ}", _NAME, r"(?P<H>'(?:[^'\\\n\r]|\\(?:[xuU][\da-fA-F]++|[0-7]{3}|.))')|(?P<E>/\*)"),
    "PHP": (rf"\#(?!\[)(?:[^\n\r?]++|\?(?!>))*+|//(?:[^\n\r?]++|\?(?!>))*+|{_BLOCK}", rf"{_DQM}|{_SQM}", r"\$*\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+", r"(?P<O>\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z))|(?P<A>\#\[[^\n\]]*\])|<<<[ \t]*(?P<q>['\"]?)(?P<h>\w++)(?P=q)\r?\n|(?P<E>/\*|<<<)"),
    "Ruby": (r"\#[^\n\r]*|^=begin\b[\s\S]*?^=end\b[^\n\r]*|^__END__[ \t\r]*$[\s\S]*", rf"\"(?:[^\"\\\#]++|\\[\s\S]|\#(?!\{{))*+\"|{_SQM}|`(?:[^`\\\#]++|\\[\s\S]|\#(?!\{{))*+`|%[wWiIqQrxs]?(?:\[[^\]]*+\]|\((?:[^()]++|\([^()]*+\))*+\)|\{{(?:[^{{}}]++|\{{[^{{}}]*+\}})*+\}}|<[^>]*+>|![^!]*+!|\|[^|]*+\|)[a-z]*", r"@{0,2}[^\W\d]\w*+[?!]?(?!=(?!=|~|>))|@{0,2}[^\W\d]\w*+|\$(?:\w++|[!@~&`'+=/\\,;.<>_*$?:\"])", r"<<[~-]?(?P<q>['\"`]?)(?P<h>[A-Z_a-z]\w*+)(?P=q)|(?P<Y>:(?:[^\W\d]\w*+[?!=]?(?![=\w])|[^\W\d]\w*+|\"(?:[^\"\\]++|\\.)*+\"|[+\-*/<=>!\[\]]++)(?<!::))|(?P<K>[^\W\d]\w*+[?!]?:(?!:))|(?P<B>(?:\bdo\b|\{)[ \t]*\|[^|\n]*\|)|(?P<T>[\"`])|(?P<E>^=begin\b|%[wWiIqQrxs]?[\[({<])"),
    "Lua": (r"--\[(?P<c>=*+)\[[\s\S]*?\](?P=c)\]|--(?!\[=*\[)[^\n\r]*", rf"{_DQ}|{_SQ}|\[(?P<b>=*+)\[[\s\S]*?\](?P=b)\]", _NAME, r"(?P<Z>\A\#![^\n]*)|(?P<E>(?:--)?\[=*\[)"),
    "Python": (r"\#[^\n\r]*", rf"\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|(?!\"\"\"|'''){_DQ}|(?!'''){_SQ}", _NAME, None),
}


def _compile(language: str) -> tuple[re.Pattern, dict[str, str]]:
    """One token, blanks before it included: any text has one at each place, so that reading it takes time in proportion to its length."""
    comment, string, name, more = _PARTS[language]
    ops = {o: k for k, os in _OPS.get(language, {}).items() for o in os.split()}
    if language == "Python":
        return re.compile(rf"(?P<C>{comment})|(?P<S>{string})|(?P<X>[\"'])"), {}
    ops |= {k: v for k, v in _PLAIN.items()}
    marks = "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))
    own, _, unended = more.rpartition("(?P<E>")
    own, unended = own.rstrip("|") + "|" * bool(own), "(?P<E>" + unended + "|"
    lead = f"(?P<C>{comment})|{own}"
    if language == "Ruby":  # literals with code inside, and what begins with a mark of its own, come behind the plain ones
        own, _, template = own.rpartition("(?P<T>")
        lead, unended = f"(?P<C>{comment})|{own}", f"(?P<T>{template}{unended}"
    elif language == "JavaScript":
        lead, unended = f"(?P<C>{comment})|", f"{own}{unended}"
    blank = r"(?:[ \t\f\v]++|\\\r?\n)*+" if language in ("C", "Ruby") else r"[ \t\f\v]*+"
    return re.compile(rf"{blank}(?:(?P<N>\r\n|[\n\r])|{lead}(?P<S>{string})|{unended}(?P<n>{_NUMBER})|(?P<W>{name})|(?P<M>{marks})|\Z|(?P<X>[\s\S]))", re.M), ops


_COMPILED = {x: _compile(x) for x in LANGUAGES}
_RECORD = re.compile(r"\s+[^\W\d]\w*+\s*+[(<]")
_SEALED = re.compile(r"\s++(?:[a-z]+\s++){0,4}?(?:class|interface)\b")
_MACRO = re.compile(r"_\w*|[A-Z][A-Z\d_]*").fullmatch
# Token classes after which a line break ends the statement in Go.
_GO_ENDS = frozenset("insRJU)]}")
_OPERAND_ENDS = frozenset("ins)]}eUbR")
#: Token classes behind which a slash divides.
_DIVIDED = {"JavaScript": frozenset("ins)]}U"), "Ruby": frozenset("ins)]}e")}
# what matters inside a literal with code in it, and inside that code, by language
_INSIDE = {"JavaScript": re.compile(r"\\[\s\S]|`|\$\{"), "Ruby": re.compile(r"\\[\s\S]|[\"`]|\#\{")}
_CODE = {"JavaScript": re.compile(rf"[`{{}}]|{_DQ}|{_SQ}|//[^\n\r]*|{_BLOCK}|(?P<E>/\*)"), "Ruby": re.compile(rf"[\"`{{}}]|{_SQ}")}


def _literal_end(text: str, begin: int, language: str) -> int:
    """Behind the literal that begins here and may hold code with literals inside; -1 if it never ends."""
    inside, code = _INSIDE[language].search, _CODE[language].search
    stack, at = [text[begin]], begin + 1
    while m := (code if stack[-1] == "{" else inside)(text, at):
        at, x = m.end(), m[0]
        if stack[-1] == "{":
            if x in "{`\"":
                stack.append(x)
            elif x == "}":
                stack.pop()
            elif x == "/*":
                return -1
        elif x == stack[-1]:
            stack.pop()
            if not stack:
                return at
        elif x[-1] == "{" and len(x) == 2 and x[0] in "$#":
            stack.append("{")
    return -1


class _Heredocs:
    """Finds the lines at which heredocs end, each text's lines being looked through once."""

    def __init__(self, text: str):
        self.text, self.lines = text, None

    def after(self, mark: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the first line from ``at`` on that is only the mark."""
        if self.lines is None:
            self.lines = {}
            for m in re.finditer(r"^[ \t]*+(\w++)[ \t\r]*+$", self.text, re.M):
                self.lines.setdefault(m[1], []).append((m.start(), m.end(1)))
        found = self.lines.get(mark, [])
        i = bisect_left(found, (at, 0))
        return found[i] if i < len(found) else None


def lex(text: str, language: str, most: int | None = None) -> Lexed:
    """The tokens of the text, which begins behind any byte order mark; the first ``most`` of them, if that is given."""
    pattern, ops = _COMPILED[language]
    words, out = KEYWORDS[language], Lexed()
    classes, starts, comments, strings = [], out.starts, out.comments, out.strings
    add, at = classes.append, starts.append
    begin = 1 if text.startswith("\ufeff") else 0
    if begin:
        text = "\n" + text[1:]  # the first line begins behind the mark
    if language == "PHP":
        if (i := text.find("<?php")) < 0 and (i := text.find("<?=")) < 0:
            out.error = "no code"
            return out
        begin = i + (5 if text.startswith("<?php", i) else 3)
    lines = language in ("JavaScript", "Go", "Ruby")
    last = ""
    if language == "Python":
        for m in pattern.finditer(text, begin):
            a, b = m.span()
            if m.lastgroup == "C":
                comments.append((a, b))
            elif m.lastgroup == "S":
                while a > max(begin, m.start() - 2) and text[a - 1] in "rRbBuUfF":
                    a -= 1
                strings.append((m.start() if a > begin and (text[a - 1].isalnum() or text[a - 1] == "_") else a, b))
            else:
                out.error = f"a literal that begins at {a} never ends"
                break
        return out
    match, pos, word = pattern.match, begin, ""
    heredocs, waiting = _Heredocs(text), []
    divided = _DIVIDED.get(language)
    while m := match(text, pos):
        k, pos = m.lastgroup, m.end()
        if k == "N":
            if waiting:  # the bodies of the heredocs that began on this line
                for mark in waiting:
                    if got := heredocs.after(mark, pos):
                        strings.append((pos, got[0]))
                        pos = got[1]
                waiting = []
            if lines and last != "~":
                if language == "Go":
                    if last in _GO_ENDS:
                        add(last := ";")
                        at(m.end() - 1)
                elif last:
                    add(last := "~")
                    at(m.end() - 1)
            continue
        if k == "W":
            w = m["W"]
            before, last = last, "i" if last == "d" else words.get(w, "i")
            if language == "Ruby":
                if last in "IW" and classes and classes[-1] in _OPERAND_ENDS:
                    last = "v"  # a modifier
            elif language == "C":
                if last == before == "i" and classes[-2:-1] == ["t"] and not _MACRO(w) and not _MACRO(word):
                    out.error = f"two names in a row at {m.start('W')}"
                    break
                word = w
            elif language == "JavaScript":
                if last == before == "i" and w not in _CONTEXTUAL and word not in _CONTEXTUAL:
                    out.error = f"two names in a row at {m.start('W')}"
                    break
                word = w
            elif language == "Java":
                if w == "@interface" or w == "record" and _RECORD.match(text, pos):
                    last = "C"
                elif w == "sealed" and _SEALED.match(text, pos):
                    last = "q"
            elif language == "PHP" and last == "i" and w[0] == "$":
                last = "v"
        elif k == "M":
            w = m["M"]
            if divided and w[0] == "/" and (last == "~" and (classes[-2:-1] or ["~"])[0] not in divided - {"}"} or last != "~" and last not in divided or last == "i" and language == "Ruby" and text[m.start("M") - 1] in " \t" and text[pos : pos + 1] not in (" ", "\t", "")):
                got = _REGEX.match(text, m.start("M"))
                if got:
                    pos, last = got.end(), "n"
                elif last in ("~", "i"):
                    last = ops[w]
                else:
                    out.error = f"a regular expression that begins at {m.start('M')} never ends"
                    break
            else:
                last = ops[w]
        elif k == "n":
            last = "n"
        elif k == "C":
            comments.append(m.span("C"))
            if language == "Go" and last in _GO_ENDS and m["C"].startswith("/*") and "\n" in m["C"]:
                add(last := ";")
                at(m.start("C"))
            continue
        elif k == "S":
            strings.append(m.span("S"))
            last = "s"
        elif k == "X" or k == "E":
            out.error = f"illegal {m[k][:1]!r} at {m.start(k)}" if k == "X" else f"{m[k]!r} at {m.start(k)} never ends"
            break
        elif k in ("H", "Y"):
            last = "n"
        elif k in ("P", "A", "Z"):
            if k == "P" and m.start() and text[m.start() - 1] not in "\r\n" and not (comments and comments[-1][1] == m.start()):
                out.error = f"a directive inside a line at {m.start('P')}"
                break
            continue
        elif k == "O":
            last = ";"
        elif k == "K":
            last = "k"
        elif k == "B":
            last = "D" if m["B"].startswith("do") else "{"
        elif k == "T":
            end = _literal_end(text, m.start("T"), language)
            if end < 0:
                out.error = f"a literal that begins at {m.start('T')} never ends"
                break
            strings.append((m.start("T"), end))
            pos, last = end, "s"
        elif k == "h" and language == "PHP":
            got = re.compile(rf"^[ \t]*+{re.escape(m['h'])}\b", re.M).search(text, pos)
            if not got:
                out.error = f"a literal that begins at {m.start('q')} never ends"
                break
            strings.append((m.start("q") - 3, got.end()))
            pos, last = got.end(), "s"
        elif k == "h":  # a heredoc of Ruby, whose body begins on the next line; without an end, or right behind an operand, it's an operator
            begin = text.index("<<", m.start())
            if last in _OPERAND_ENDS and begin == m.start() or not heredocs.after(m["h"], pos):
                pos, last = begin + 2, "o"
            else:
                waiting.append(m["h"])
                last = "s"
        else:  # the end
            break
        add(last)
        at(m.start(k) if k != "h" else m.start("q"))
        if most and len(classes) >= most:
            break
    out.classes = "".join(classes)
    return out
