"""Natural-language text in comments and string literals: taking off the marks of code, mending damage, and telling sentences from the rest."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from .lexers import Lexed, Span

NL_LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru", "zh", "ja")

# Frequent function words of each language, without accents, as after fold().
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with on be at by this have from or had not are but what all were when we there can an your which their if do will each how them then many some so these would into has more two he was you his they i one other out up about than its who only may must a no any because while unless whether before after over under again every once never still already until without as both such same been being should could also where here does did just most very was anything nothing everything what itself",
    "de": "der die das und in den von zu mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem uber einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ob weil was alles schon damit bereits muss kann keine kein diese dieser dieses wird darf solange ausser sonst deren beide jeden jede",
    "fr": "le la les de des du un une et en est que qui dans pour pas ne sur se ce il sont avec au aux par plus son sa ses ou mais comme on tout nous vous leur si cette ces meme elle ete bien sans deux peut fait aussi encore rien tant afin avant avoir etre deja jamais chaque quand dont toute tous lors sinon y l d qu n s c",
    "es": "el la los las de del un una y en es que se no por con para su al lo como mas o pero sus le ya este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e ha sido cada aunque mientras salvo estan son haya vez veces para nada",
    "pt": "o a os as de do da dos das um uma e em no na nos nas que se nao por com para seu sua ao mais como mas foi ele tem sem ou ser quando muito ha ja esta eu tambem so pelo pela ate isso ela entre era depois mesmo aos ter seus quem me esse eles estao voce ainda cada tudo antes porque enquanto mesmo caso nada vazia foram",
    "pl": "i w z na do sie nie to jest ze o jak co za od po przez dla ale tak byl czy juz tym lub oraz ktory ktora ktore przed tylko bo jego gdy aby jesli nawet kazdy kazda kazdego jeden dwa moze byc ma sa sposob bez pod nad tej tego ten ta ich gdzie niz wszystko wszystkie ponieważ poniewaz chyba zeby dopoki zostalo zostal pole nic razy ile",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот который пока потому чтобы который которая перед",
}
# Letters that lose their mark without Unicode saying so.
_FOLD = str.maketrans("łŁøØđĐßœŒæÆıё", "lLoOdDsoOaAiе")


@lru_cache(200_000)
def fold(word: str) -> str:
    """Lower case, without accents; ASCII and Cyrillic stay letters."""
    word = word.lower().translate(_FOLD)
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_WORDS = {k: frozenset(map(fold, v.split())) for k, v in FUNCTION_WORDS.items()}
_SIMPLE = {"n": "\n", "t": "\t", "r": "\n", "\n": "", '"': '"', "'": "'", "\\": "\\", "0": "", "b": " ", "f": " ", "v": " ", "a": " "}
_ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]{1,6})\}|[uU]([\da-fA-F]{8}|[\da-fA-F]{4})|((?:x[\da-fA-F]{2})(?:\\x[\da-fA-F]{2})*)|((?:[0-3][0-7]{2})(?:\\[0-3][0-7]{2})+)|(\r\n|.|\n))", re.S)
_ENTITY = re.compile(r"&(?:#\d{2,7}|#x[\da-fA-F]{2,6}|[a-zA-Z]{2,8}\d{0,2});")


def _unescaped(m: re.Match) -> str:
    try:
        if m[1] or m[2]:
            c = chr(int(m[1] or m[2], 16))
            return c if not 0xD800 <= ord(c) < 0xE000 else ""
        if m[3] or m[4]:
            b = bytes(int(x, 16) for x in re.findall(r"x(..)", m[3])) if m[3] else bytes(int(x, 8) for x in re.findall(r"\d{3}", m[4]))
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("latin-1")
    except (ValueError, OverflowError):
        return " "
    return _SIMPLE.get(m[5], m[5] if len(m[5]) == 1 else "")


_BROKEN = re.compile(r"[ÂÃÄÅÆÐÑØÙà-ï][\x80-¿€-™ŒœŠšŽžŸƒˆ˜‚„…†‡‰‹›‘’“”•–—]")
_LONE = {0x81, 0x8D, 0x8F, 0x90, 0x9D}


def _bytes_of(text: str) -> bytes:
    out = bytearray()
    for c in text:
        o = ord(c)
        if o < 256:
            out.append(o)
        else:
            out += c.encode("cp1252")
    return bytes(out)


def mend(text: str) -> str:
    """Undo text that was UTF-8 and read as a one-byte encoding, line by line where that decodes; other text stays as it is."""
    for _ in range(2):
        if not _BROKEN.search(text):
            break
        out = []
        for x in re.split(r"([ \t\n\r]+)", text):
            if not x.isascii() and _BROKEN.search(x):
                try:
                    x = _bytes_of(x).decode("utf-8", "strict")
                except (UnicodeDecodeError, UnicodeEncodeError):
                    pass
            out.append(x)
        if (new := "".join(out)) == text:
            break
        text = new
    return text


def literal_text(text: str, raw: bool = False) -> str:
    """The text of a string literal without quotes and prefix, its escapes resolved unless it is raw, damage mended."""
    m = re.match(r"(?:[rRbBuUfFL@$]|u8)*(\"\"\"|'''|`|\"|'|\[=*\[|<<<[ \t]*['\"]?\w+['\"]?\r?\n)", text)
    if m:
        q = m[1]
        text = text[m.end() :]
        text = text[: max(0, text.rfind("\n"))] if q.startswith("<<<") else text.removesuffix(q.replace("[", "]")) if q[0] == "[" else text.removesuffix(q)
        raw = raw or q[0] in "`[" or "r" in m[0][:2].lower() and q[0] in "\"'"
    if "\\" in text and not raw:
        text = _ESCAPE.sub(_unescaped, text)
    elif "\\u" in text:
        text = re.sub(r"\\u([\da-fA-F]{4})", _ESCAPE_U, text)
    if "&" in text and _ENTITY.search(text):
        import html

        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFC", mend(text))


def _ESCAPE_U(m: re.Match) -> str:  # noqa: N802
    return chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else ""


_FRONT = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!\*)|//+[/!]*|--\[=*\[|\]=*\](?:--)?|--+|#+!?|=begin\b|=end\b|;+|<!--)?[ \t]?")


def _without_end(x: str) -> str:
    """The line without the mark that ends a comment, and blanks around it."""
    x = x.rstrip(" \t\r")
    if x.endswith("*/"):
        x = x[:-1].rstrip("*")
    elif x.endswith("-->"):
        x = x[:-3]
    elif x.endswith(("//", "#", "--")):
        x = x.rstrip(x[-1])
    elif x.endswith("]") and (y := x[:-1].rstrip("=")).endswith("]"):
        x = y[:-1]
    return x.rstrip(" \t")


def comment_lines(text: str) -> list[str]:
    """The lines of a comment (or of several line comments) without their markers."""
    if "\\u" in text:
        text = re.sub(r"\\u([\da-fA-F]{4})", _ESCAPE_U, text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", mend(text))
    if "&" in text and _ENTITY.search(text):
        import html

        text = html.unescape(text)
    return [_without_end(_FRONT.sub("", x)) for x in re.split(r"\r\n|[\n\r]", text)]


_START = re.compile(r"[﻿ \t\r]*+(?:<\?php\b[ \t\r]*+)?")


class Rows:
    """The rows of a text, as the given line breaks part them."""

    def __init__(self, text: str, breaks: str = r"\r\n|[\n\r]"):
        self.text = text
        self.ends = [m.end() for m in re.finditer(breaks, text)]
        self._first: dict[int, int] = {}

    def of(self, i: int) -> int:
        return bisect_right(self.ends, i)

    def start(self, row: int) -> int:
        return self.ends[row - 1] if row else 0

    def first(self, row: int) -> int:
        """Where the row's text begins, behind blanks and the mark that opens PHP."""
        if row not in self._first:
            self._first[row] = _START.match(self.text, self.start(row)).end()
        return self._first[row]


def comment_runs(text: str, lexed: Lexed) -> list[Span]:
    """The comments, with each run of line comments on adjacent rows as one span: nothing but blanks stands between them, and before each of them on its row."""
    runs: list[list[int]] = []
    rows = Rows(text)
    for a, b in lexed.comments:
        between = text[runs[-1][1] : a] if runs else ""
        if runs and not runs[-1][2] and between.strip(" \t\r\n") == "" and len(re.findall(r"\r\n|[\n\r]", between)) == 1 and text[a : a + 2] not in ("/*",) and not text.startswith(("--[[", "=begin"), a):
            runs[-1][1] = b
        else:
            block = text.startswith(("/*", "=begin", "--[[", "--[="), a)
            runs.append([a, b, block or rows.first(rows.of(a)) < a])
    return [(a, b) for a, b, _ in runs]


# Line beginnings of documentation tags and section heads, and tool directives.
_TAG = re.compile(r"^\s*(?:[@\\](?!brief\b|description\b|summary\b|details\b)[a-zA-Z]+|:\w+(?: [\w.*]+)*:|\.\. \w+|<\/?\w+[^>]*>\s*$|[-*]?\s*[\w$.*]+ ?(?:\([^)]*\))? ?: ?\w+(?: \w+){0,3}\s*$)")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|usage|see also|notes?|attributes)\s*:?\s*$", re.I)
_RULE = re.compile(r"^\s*[-=*#~_+/.\\]{3,}\s*$")
_DIRECTIVE = re.compile(
    r"(?i)^\s*(?:!?/?usr/bin|pylint\b|flake8\b|noqa\b|type:\s*ignore|mypy\b|pragma\b|eslint\b|eslint-|jshint\b|jslint\b|global [\w, ]+$|@ts-|ts-|prettier-|istanbul\b|c8 ignore|nolint\b|golint\b|go:\w+|\+build|phpcs\b|phpstan\b|psalm\b|@phpcs|@codecov|rubocop\b|frozen_string_literal\b|encoding:|coding[:=]|-\*-|vim:|vi:|ex:|luacheck\b|checkstyle\b|nopmd\b|nosonar\b|noinspection\b|clang-|cppcheck\b|lint\b|fmt:|yapf\b|(?:emacs|isort|black|suppress(?:warnings?|lint)?|sonar(?:qube|lint)?)\b(?:\s*[-:=(\[]|.*-\*-|(?:\s+\S+){0,2}\s*$)|todo\b|fixme\b|xxx\b|hack\b|tbd\b|region\b|endregion\b)"
)
_CODE = re.compile(r"[{};]\s*$|^\s*[{}()\[\]]+\s*$|^\s*(?:if|for|while|return|def|function|local|var|let|const|import|from|else|elif|end|print|class|public|private|static)\b.*(?:[(){}=;]|:\s|:$| then\b| do\b)|^\s*[\w.$>-]+\s*(?:[-+*/%|&^.]?=|:=)(?!=)\s*\S|^\s*[\w.$:>-]+\([^)]*\)[;,]?\s*$|^\s*(?:\$|>>>|>|%)\s+\w|\w\(\)\s*$")
# What no sentence has: operators that stand alone, assignments, braces.
_OPERATOR = re.compile(r"(?:^|\s)[-+*/%|&^<>=!:]*[<>=+*/%|&^](?=\s)|[\w\])]=\S|[{}]")
_QUERY = re.compile(r"^\s*(?:SELECT\b.*\bFROM|INSERT\s+INTO|UPDATE\b.*\bSET|DELETE\s+FROM|CREATE\s+(?:TABLE|INDEX|VIEW)|DROP\s+TABLE|ALTER\s+TABLE|WITH\b.*\bAS\s*\()\b", re.I | re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿々〆ｦ-ﾟ]")
_KANA = re.compile(r"[぀-ゟ゠-ヺー-ヿㇰ-ㇿｦ-ﾟ]")
_ENDS = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=\S)|(?<=[。！？])")


def paragraphs(lines: list[str], description: bool = False) -> list[str]:
    """The running text of cleaned lines: tag lines, rules, directives and code are left out and end a paragraph, like blank lines and section heads do.

    description: stop at the first tag line or section head behind which only such follow, as a description does.
    """
    out: list[list[str]] = [[]]
    skip = -1
    for x in lines:
        bare = x.strip()
        if not bare:
            skip = -1 if not description else skip
            out.append([])
            continue
        depth = len(x) - len(x.lstrip())
        if skip >= 0 and depth > skip:
            continue
        skip = -1
        if bare[0] in "@\\":
            bare = re.sub(r"^[@\\](?:brief|description|summary|details)\b:?\s*", "", bare)
        if _TAG.match(bare) or _SECTION.match(bare):
            skip = depth
            out.append([])
        elif _RULE.match(bare) or _DIRECTIVE.match(bare) or _QUERY.match(bare) or _CODE.search(bare) and not (is_sentence(bare) and not _OPERATOR.search(bare)):
            out.append([])
        else:
            out[-1].append(bare)
    return [("" if _CJK.search(p[0][-1:]) and _CJK.search(p[-1][:1]) else " ").join(p) for p in out if p]


def sentences(paragraph: str) -> list[str]:
    return [x for x in (y.strip() for y in _ENDS.split(paragraph)) if x]


def words(text: str) -> list[str]:
    """The words of natural text: runs of letters; pieces of names, paths, addresses, numbers and patterns are none."""
    out = []
    for token in text.split():
        t = token.strip(".,;:!?\"'()[]«»„“”…*`–—-¡¿")
        if _CJK.search(t):
            out.append(t)
        elif t and _WORD.fullmatch(t) or "-" in t and all(_WORD.fullmatch(y) for y in t.split("-")):
            out.append(t)
        elif re.fullmatch(r"[^\W\d_]+(?:['’/&][^\W\d_]+)+", t):
            out.append(t)
    return out


def is_sentence(text: str, least_words: int = 6, least_chars: int = 12) -> bool:
    """Is this a natural sentence of at least so many words (Chinese, Japanese: characters)?"""
    cjk = len(_CJK.findall(text))
    if cjk >= least_chars:
        return cjk >= 0.4 * len(re.sub(r"\s", "", text))
    if cjk:
        return False
    tokens = text.split()
    if len(tokens) < least_words or _QUERY.match(text) or re.search(r"https?://\S+$", text):
        return False
    ws = words(text)
    names = sum("_" in t and re.sub(r"\W", "", t).isidentifier() for t in tokens)
    return len(ws) + names >= least_words and len(ws) >= 0.6 * len(tokens)
