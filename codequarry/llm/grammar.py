"""Grammars of seven languages over the token classes of ``lexers``; Python's own parser serves as the eighth.

A grammar is a set of regular expressions without recursion. Brackets (and, in Lua and Ruby, blocks that end with ``end``) are reduced
as they close, with a stack: the flat text of each is matched against what may stand there, and a letter or digit takes its place:

===  ===============================================================
1    list of expressions: arguments, or an expression in parentheses
2    list of parameters     3  header of a loop, or a group of declarations
4    a type, as in a cast   5  nothing, or names only: arguments, parameters or a type
6    square brackets        7  a block     8  an initialiser or object     9  ``{}``
k    body of a class or type       b  a block that is an expression (Ruby, Lua)
===  ===============================================================

What is left of the file has to match the rule for a whole file. Most groups repeat, so their letters are remembered. Loops over what
has no bound are possessive and expressions atomic, so that the time is in proportion to the text's length.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable
from functools import lru_cache

from .lexers import LANGUAGES, Lexed, lex


def _remembered(f: Callable[[str], str], longest: int = 80) -> Callable[[str], str]:
    """The function with its results for short texts kept, which are those that repeat."""
    kept = lru_cache(100_000)(f)
    return lambda x: kept(x) if len(x) <= longest else f(x)


def _list(x: str) -> str:
    return rf"(?:{x})(?:,(?:{x}))*+"


def _full(x: str) -> Callable[[str], re.Match | None]:
    return re.compile(x).fullmatch


def _ternary(x: str) -> str:
    """Expressions of operands and binary operators, and conditions over them."""
    return rf"(?>{x}(?:Q{x}(?:Q{x}:{x})?:{x})*+)"


def _statement(head: str, body: str) -> str:
    """A statement: what heads it (conditions, loops, labels) and a body. Which ``else`` has its ``if`` is left to _elses()."""
    return rf"(?>(?:{head}|E(?!:)|D)*+(?:{body}))"


_ENDS = re.compile("[IE;79kw]")


def _elses(x: str) -> bool:
    """Does each ``else`` in these statements follow one with a condition?"""
    if "E" not in x:
        return True
    ifs = 0
    for m in _ENDS.finditer(x):
        end, after = m[0], x[m.end() : m.end() + 1]
        if end == "I":
            ifs += 1
        elif end == "E":
            if after != ":":  # the else of a block that ends with a word
                if not ifs:
                    return False
                ifs -= 1
        elif after != "E" and (after != "W" if end == ";" else after not in tuple(";,:Qoum=d&156)W")):
            ifs = 0
    return True


_BRACKETS = re.compile(r"([()\[\]{}])")
_PAIRS = {")": ("(", 0), "]": ("[", 1), "}": ("{", 2)}


def _brackets(classes: str, paren: Callable, square: Callable, brace: Callable) -> str | None:
    """The text with all brackets reduced, in one pass; None where one of them is wrong or has no partner."""
    reduce, stack, parts = (paren, square, brace), [], []
    for x in _BRACKETS.split(classes):
        if x in ("(", "[", "{"):
            stack.append((x, parts))
            parts = []
        elif (pair := _PAIRS.get(x)) is None:
            parts.append(x)
        else:
            if not stack or stack[-1][0] != pair[0]:
                return None
            letter = reduce[pair[1]]("".join(parts))
            if not letter:
                return None
            parts = stack.pop()[1]
            parts.append(letter)
    return None if stack else "".join(parts)


def _c() -> Callable[[str], bool]:
    prim = r"(?:z4|[45][89]|s(?:i?s)*+|i(?:s(?:i?s)*+)?|n|[15])"
    unary = rf"(?>(?:[um&!Uz]|[45])*{prim}(?:[15]|6|di|U)*+)"
    expr, label = _ternary(rf"{unary}(?:[omu&=]{unary})*+"), rf"(?>{unary}(?:[omu&]{unary})*+)"
    exprs = _list(expr)
    ini = rf"(?:(?:(?:di|6)+=|i:)?(?:{expr}|[89]))"
    kind = r"(?:q*+(?:t[tq]*+|Ti?+|i|y[1245])q*+)"
    typename = rf"{kind}[mq]*+(?:1[1245])?6*+"
    param = rf"(?:{kind}[mq]*+(?:[15][1245]|i[1245]|i?6*+)(?:y[15])*+|e)"
    dcl = rf"(?:m[mq]*+)?(?:i|1)(?:6|[1245])*+(?:aq*+[A15])?(?:y[15])*+(?:=(?:{expr}|[89]))?(?::n)?"
    spec = r"(?:[qt]|Ti?+[7-9]?+|i|y[1245])"
    decl = rf"{spec}+?(?:{dcl}(?:,(?:y[15])*+{dcl})*+)?"
    func = rf"{spec}+?m*+(?:i|1)[1245](?:y[15])*+[79]|{spec}+?m*+i5(?:{decl};)++[79]"
    head = rf"I[15]|W[15]|F3|S[15]|K{label}(?:e{label})?:|L:|i:(?!:)|i[15](?=[79])"
    simple = rf"(?:{exprs}|R(?:{expr})?|J|G(?:i|m{unary})|aq*+G?[A15]|{decl})?;"
    stmt = _statement(head, rf"{simple}|[79]|{func}")
    names, is_exprs, types, params = _full(r"(?:i(?:,i)*+)?"), _full(exprs), _full(typename), _full(_list(param))
    header, mixed = _full(rf"(?:{decl}|{exprs})?;(?:{exprs})?;(?:{exprs})?"), _full(_list(f"(?:{expr}|{typename})(?=,|$)"))
    others = _full(r"[79]|(?:m[mq]*+)?i(?:[1245]|6)++|m[mq]*+6*+")
    asm = _full(r"s(?:i?s)*+(?::(?:(?:6?s[15])(?:,6?s[15])*+)?)*+(?:s(?:,s)*+)?")
    index, block, init = _full(rf"q*+(?:{expr}(?:e{expr})?)?"), _full(rf"(?:{stmt})*+"), _full(_list(ini) + ",?")
    whole = _full(rf"(?>(?!{expr};){decl};|{func}|;|qs[79]|i[1245][79]|i[15];?|{spec}+?m*+i[1245];|aq*+[A15];)*+")

    @_remembered
    def paren(x: str) -> str:
        return "5" if names(x) else "1" if is_exprs(x) else "4" if types(x) else "2" if params(x) else "3" if header(x) else "1" if mixed(x) or others(x) else "A" if asm(x) else ""

    square = _remembered(lambda x: "6" if index(x) else "")
    brace = _remembered(lambda x: "9" if not x else "7" if block(x) and _elses(x) else "8" if init(x) else "")

    def ok(classes: str) -> bool:
        rest = _brackets(classes, paren, square, brace)
        return rest is not None and bool(whole(rest))

    return ok


_ANGLES = re.compile(r"([<>])")
_GENERIC, _METHOD_TYPES = _full(r"[it,dQ&x6@q]*+"), _full(r"[i,x&d6]++")


def _plain(x: str) -> str:
    """Java without its type arguments: angles that hold types only, behind a name, or before the type of a generic method."""
    if "<" not in x:
        return x
    pieces = _ANGLES.split(x)
    parts: list[str] = []
    opened: list[int] = []  # where in parts the open angles are
    for n, p in enumerate(pieces):
        if n % 2 and p == "<":
            opened.append(len(parts))
            parts.append(p)
        elif n % 2 and opened:
            at = opened[-1]
            inner, before, behind = "".join(parts[at + 1 :]), parts[at - 1][-1:] if at else "", pieces[n + 1][:1]
            if _GENERIC(inner) and before and before in "id" or _METHOD_TYPES(inner) and not (before and before in "isn156>") and behind and behind in "it":
                del parts[at:]
                opened.pop()
            else:  # neither this one nor any around it holds types only
                opened.clear()
                parts.append(p)
        elif p:
            parts.append(p)
    return "".join(parts)


def _java() -> Callable[[str], bool]:
    kind = r"(?:[it](?:di)*+6*+)"
    new = rf"N[it](?:di)*+(?:[15](?:[79k])?|6++[89]?)"
    plain = rf"i|n|s|[15]|{new}|(?:[it]6*+d[CN]|t6*+di|i6++di)"
    post = r"(?:[15]|6|di|dN(?:i[15])?|dC|U)*+"
    prim = rf"(?:(?:i|[125])l[7-9k]|S[15][7-9k]|{plain})"
    unary = rf"(?>(?:[u!U]|[45]|(?:i|[125])l)*{prim}{post})"
    bare = rf"(?>(?:[u!U]|[45])*(?:{plain}){post}(?:(?:[ou&<]|>{{1,3}})(?:[u!U]|[45])*(?:{plain}){post})*+)"  # without arrows
    pattern = rf"q*+{kind}(?:i|[125]i?)?"
    expr = _ternary(rf"{unary}(?:(?:[ou=&<]|>{{1,3}}){unary}|V{pattern})*+")
    exprs, value = _list(expr), rf"(?:(?:i=)?[89]|{expr})"
    dcl = rf"i6*+(?:={value})?"
    decl = rf"q*+{kind}{dcl}(?:,{dcl})*+"
    param = rf"q*+{kind}e?(?:o{kind})*+(?:[125]|i?6*+)"
    throws = rf"(?:x{_list(kind)})*+"
    method = rf"[qL]*+(?:{kind})?i[125]6*+{throws}(?:[789k]|(?:L{value})?;)"
    clazz = rf"q*+Ci[125]?{throws}(?:i{_list(kind)})?[789k]"
    case = rf"K(?:{_list(r'u?[ins](?:di)*+')}(?:,L)?l|{_list(f'(?:{kind}(?:[125]i?|i)|{bare})')}(?:i{bare})?[l:])"
    head = rf"I[15]|W[15]|F3|S[15](?=[79k])|{case}|L[:l]|i:|q[15]"
    final = r"(?:Z[79])"
    simple = rf"(?:{exprs}|R(?:{expr})?|Ji?|H{expr}|A{expr}(?::{expr})?|{decl})?;"
    body = rf"{simple}|Y[79](?:(?:X2[79])++{final}?|{final})|Y[1235][79](?:X2[79])*+{final}?|[79k]|{clazz}"
    stmt = _statement(head, body)
    member = rf"q*+{kind}{dcl}(?:,{dcl})*+;|{method}|{clazz}|q*+i[79]|q?[79]|;"
    entries = rf"i[15]?[79k]?(?:,i[15]?[79k]?)*+,?"
    note = re.compile(r"@i(?:di)*+[158]?")
    names, is_exprs, types, params = _full(r"(?:i(?:,i)*+)?"), _full(_list(value)), _full(f"{kind}(?:&{kind})*+"), _full(_list(param))
    header = _full(rf"(?:{decl}|{exprs})?;(?:{expr})?;(?:{exprs})?|q*+{kind}i:{expr}|(?:{decl}|{expr})(?:;(?:{decl}|{expr}))*+;?")
    index, block, init = _full(rf"(?:{expr})?"), _full(rf"(?:{stmt})*+"), _full(_list(rf"(?:{value})") + ",?")
    body_of = _full(rf"(?:{entries}(?:;(?:{member})*+)?|(?>{member})*+)")
    module = _full(r"(?:ii?(?:i(?:di)*+)(?:[ix]i(?:di)*+(?:,i(?:di)*+)*+)?;)*+")
    whole = _full(rf"(?>P[qi]?i(?:di|do)*+;|{clazz}|i{{1,2}}i(?:di)*+[Mk79]|;)*+")

    @_remembered
    def plain_of(x: str) -> str:
        return _plain(note.sub("", x))

    @_remembered
    def paren(x: str) -> str:
        x = plain_of(x)
        return "5" if names(x) else "1" if is_exprs(x) else "4" if types(x) else "2" if params(x) else "3" if header(x) else ""

    square = _remembered(lambda x: "6" if index(x) else "")

    @_remembered
    def brace(x: str) -> str:
        x = plain_of(x)
        return "9" if not x else "7" if block(x) and _elses(x) else "k" if body_of(x) else "8" if init(x) else "M" if module(x) else ""

    def ok(classes: str) -> bool:
        rest = _brackets(classes, paren, square, brace)
        return rest is not None and bool(whole(plain_of(rest)))

    return ok


def _javascript() -> Callable[[str], bool]:
    block = "[79kw]"
    func, clazz = rf"a?Fm?i?1{block}", rf"Ci?(?:x(?:i|1)(?:di|1|6)*+)?[789kw]"
    prim = rf"(?:a?(?:i|1)l[79kw]|{func}|{clazz}|i|n|s|[1689w]|M1|Md?i)"
    unary = rf"(?>(?:[ut!Ue]|tm|a(?=[itNF1])|N|a?(?:i|1)l)*{prim}(?:1|6|di|U|s|Q?d[16])*+|t(?=[;,]|$))"
    expr, label = _ternary(rf"{unary}(?:[oum=]{unary})*+"), rf"(?>{unary}(?:[oum]{unary})*+)"
    exprs = _list(expr)
    dcl = rf"(?:i|[68w])(?:={expr})?"
    decl = rf"V{_list(dcl)}"
    head = rf"I1|W1|f(?:a|t)?3|S1|K{label}:|L:|i:"
    simple = rf"(?!8)(?:{exprs}|{decl}|R(?:{exprs})?|Ji?|H{expr}|M(?:i,)?(?:[89wk]|i|mii)is(?:i[89w])?|Ms|BL(?:{expr})|B(?:[89wk](?:is)?|m(?:i[is])?is)|BV{_list(dcl)})?;"
    tried = rf"[79w](?:X1?[79w](?:Z[79w])?|Z[79w])"
    body = rf"{simple}|Y{tried};?|(?:BL?)?(?:{func}|{clazz});?|[79w]"
    stmt = _statement(head, body)
    name = r"(?:[isn6]|[A-Zaftx])"
    method = rf"(?:[iaoN]*?m?{name}1{block})"
    is_exprs = _full(rf"(?:(?:{expr})?,)*+(?:{expr})?")
    header = _full(rf"(?:{decl}|{exprs})?;(?:{exprs})?;(?:{exprs})?|V?(?:i|[68w])(?:di|6)*+[io]{expr}")
    obj = _full(rf"(?>(?:{name}:{expr}|{method}|e{expr}|{name}i{name}|{name}(?:={expr})?)(?:,|$))*+")
    is_block = _full(rf"(?:{stmt})*+")
    body_of = _full(rf"(?>{method};?|i[79w];?|i*?{name}(?:={expr})?;|;)*+")
    breaks = re.compile(r"~(?=[.,?:=om&dlQ);>])|(?<=[oum=Q:,;{l!etVNfIW])~|^~|(?<=1)~(?=[79kw])|(?<=[7-9kw])~(?=[EXZW])")
    notes = re.compile(r"@i(?:di)*+1?")

    @_remembered
    def flat(x: str) -> str:
        return breaks.sub("", notes.sub("", x)).replace("~", ";")

    @_remembered
    def paren(x: str) -> str:
        x = notes.sub("", x.replace("~", ""))
        return "1" if is_exprs(x) else "3" if header(x) else ""

    square = _remembered(lambda x: "6" if is_exprs(x.replace("~", "")) else "")

    @_remembered
    def brace(x: str) -> str:
        y = x.replace("~", "")
        if not y:
            return "9"
        x = flat(x)
        x += ";" * (x[-1:] != ";")
        statements = is_block(x) and _elses(x)
        if obj(y):
            return "w" if statements else "8"
        return "7" if statements else "k" if body_of(x) else ""

    def ok(classes: str) -> bool:
        rest = _brackets(classes, paren, square, brace)
        return rest is not None and bool(is_block(x := flat(rest) + ";")) and _elses(x)

    return ok


def _go() -> Callable[[str], bool]:
    inner = r"(?:m|6|c|y|M6)*+(?:i(?:di)?6?|C[789kw])"
    kind = rf"(?:m|6|c|y|M6)*+(?:i(?:di)?6?|C[789kw]|F[125](?:[125]|{inner})?|[15](?!{inner}))"
    result = rf"(?:[125]|{kind})?"
    named = rf"(?:(?:6|c|M6)(?:m|6|c|y|M6)*+)?(?:i(?:di)?6?|C[789kw]|F[125](?:[125]|{inner})?|[15](?!{inner}))"  # a type that begins with no mark that an operand may begin with
    operand = rf"i|n|s|[15]|F[125]{result}[79w]"
    prim = rf"(?:F[125]{result}[79w]|{named}[89w]|{named}[15]|{operand}|[89w])"
    unary = rf"(?>(?:[mu&!y])*+{prim}(?:[15]|6|di|d[15]|[89w])*+)"
    expr = rf"(?>{unary}(?:[omu&]{unary})*+)"
    bare = rf"(?>(?:[mu&!y])*+(?:F[125]{result}[79w]|{named}[15]|{operand}|(?:6|M6)+{inner}[89w](?=[79w];))(?:[15]|6|di|d[15]|[89w](?=[d156]))*+)"  # in a header, no literal of a plain name ends before the block
    head = rf"(?>{bare}(?:[omu&]{bare})*+)"
    heads = _list(rf"(?:{head}|(?:{kind})[89w](?=;))")
    clause = rf"(?:{heads}(?:={heads})?|{head}U|{head}y{head})"
    arg = rf"(?:{expr}|{kind})e?"
    exprs = _list(expr)
    simple = rf"(?:{expr}(?:U|y{expr}|(?:,{expr})*+={exprs}|(?<=[15]))|y{expr})"
    block = "[79w]"
    iff = rf"(?:I(?:(?:{simple})?;)?{head}{block}(?:E(?=I)|(?=[E;])))++(?:E{block})?;"
    ranged = rf"(?:{expr}(?=[79w];)|(?:6|M6)*{inner}[89w](?=[79w];)|{head})"
    loop = rf"f(?:(?:{simple})?;(?:{head})?;(?:{clause})?|(?:{heads}=)?r{ranged}|{head})?{block};"
    switch = rf"W(?:(?:{simple})?;)?(?:{clause})?[789kw];"
    value = rf"i(?:,i)*+(?:{kind})?(?:={exprs})?"
    typed = rf"i=?{kind}|i6{kind}"
    decl = rf"V(?:{value}|[135])|T(?:{typed}|3)"
    stmt = rf"(?>(?:K(?:{simple}|{_list(arg)}):|L:|i:;?)*+(?:{iff}|{loop}|{switch}|(?:{simple}|{decl}|R(?:{exprs})?|Ji?|Gi|g{expr}|{block})?;))"
    names, is_args = _full(r"(?:i(?:,i)*+)?|T|V"), _full(rf"(?:{_list(arg)},?)?")
    params = _full(rf"{_list(rf'i?e?{kind}')},?")
    group = _full(rf"(?>(?:[io]?s|{typed}|{value});)*+(?:[io]?s|{value}|{typed})?")
    index = _full(rf"(?>{expr}|{kind}|:|,|e|it?{kind}|o)*+")
    is_block = _full(rf"(?:{stmt})*+")
    init = _full(rf"{_list(rf'(?:{expr}:)?{expr}')},?")
    union = rf"(?:t?{kind})(?:o(?:t?{kind}))*+"
    fields = _full(rf"(?>(?:i(?:,i)*+{kind}|m?i(?:di)?6?|i[125]{result}|{union})s?;)*+")
    whole = _full(rf";*+Pi;(?:p(?:[id]?s|[35]|1);)*+(?>F[125]?i6?[125]{result}{block}?;|(?:{decl});|;)*+")

    @_remembered
    def paren(x: str) -> str:
        y = x.rstrip(";") if ";" in x[-1:] and ";" not in x[:-1] else x
        return "5" if names(y) else "1" if is_args(y) else "2" if params(y) else "3" if group(x) else ""

    square = _remembered(lambda x: "6" if index(x) else "")

    @_remembered
    def brace(x: str) -> str:
        if not x:
            return "9"
        y = x + ";" * (x[-1] != ";")
        if is_block(y):
            return "w" if init(x) else "7"
        return "8" if init(x) else "k" if fields(y) else ""

    def ok(classes: str) -> bool:
        rest = _brackets(classes, paren, square, brace)
        return rest is not None and (not rest.strip(";") or bool(whole(rest + ";")))

    return ok


def _php() -> Callable[[str], bool]:
    block = "[789]"
    kind = r"(?:Q?[i5](?:[o&][i5])*+)"
    given = rf"(?::(?:{kind}|Q?q))?"  # the type of what is given back
    closure = rf"q?F&?[125](?:P[15])?{given}"
    prim = rf"(?:q?F&?[125](?:P[15])?{given}{block}|N(?:[iv]|[15])(?:di)*+[15]?|NqC[15]?(?:x{_list('i')})*+[79k]|NC[15]?(?:x{_list('i')})*+[79k]|S[15][789]|[iv]|n|s|q(?=d)|[1568])"
    unary = rf"(?>(?:[u!U&N]|ti(?=[ivN])|t|[5](?=[ivnsN15(uF])|{closure}l)*{prim}(?:[15]|6|[89](?=d)|d(?:[iv]|[789]|C|6|[A-Zhjkqtx])|U)*+|t(?=[;,]|$))"
    arrow = rf"(?:l{unary})?"
    plain = rf"(?>{unary}(?:[ou=&]{unary}|V[iv])*+)"
    expr, label = rf"(?>{plain}(?:Q(?:{plain}(?:Q{plain}:{plain})?)?:{plain})*+)", rf"(?>{unary}(?:[ou&]{unary})*+)"
    exprs = _list(expr)
    param = rf"q*+(?:{kind})?&?e?v(?:={expr})?"
    func = rf"F&?i[125]{given}{block}"
    clazz = rf"q*+Ci{given}(?:x{_list('i')})*+[79k8]"
    head = rf"I[15](?!:)|W[15](?![;:])|f3(?!:)|O3(?!:)|S[15](?=[79])|K{label}[:;]|L[:;]|i:|j[15](?=[79;])"
    used = r"(?:[Fq])?i(?:ai)?(?:b?[78])?"
    simple = rf"(?:{exprs}|h{exprs}|R(?:{expr})?|Jn?|H{expr}|q{_list(rf'[iv](?:={expr})?')}|P{used}(?:,{used})*+|Gi|W[15]|k|t{expr}{arrow})?;"
    open_ = r"(?:I[15]:|E:|W[15]:|f3:|O3:|S[15]:)"  # the other form of blocks, up to endif and the like
    body = rf"{simple}|Y[789](?:(?:X[1235][789])++(?:Z[789])?|Z[789])|{open_}|j[15];?|{block}|{func}|{clazz}|P(?:i)?[79]"
    stmt = _statement(head, body)
    names, is_exprs, params = _full(r"(?:i|v(?:,v)*+)?"), _full(rf"(?:{_list(rf'(?:i:)?e?{expr}')},?)?|e"), _full(rf"{_list(param)},?")
    header = _full(rf"(?:{exprs})?;(?:{exprs})?;(?:{exprs})?|{expr}a(?:{expr}l)?&?{expr}|{kind}v?")
    array = _full(rf"(?:(?:(?:{expr}l)?(?:{expr})|e{expr})?,)*+(?:(?:{expr}l)?{expr}|e{expr})?")
    yielded = _full(rf"t{expr}l{expr}")
    rule = _full(rf"(?:i(?:di)?(?:V{_list('i')}|a(?:q?i|q));)++")
    body_of = _full(rf"(?>q++(?:{kind})?{_list(rf'[iv](?:={expr})?')}(?:;|[78])|q*+F&?[iA-Z][125]{given}(?:{block}|;)|P{_list('i')}(?:;|[789r])|Ki(?:={expr})?;|;)*+")
    arms = _full(rf"(?>(?:{exprs}|L)l(?:{expr}|H{expr})(?:,|$))*+")
    many = _full(rf"{_list(used)},?")
    is_block = _full(rf"(?:{stmt})*+")

    @_remembered
    def paren(x: str) -> str:
        return "5" if names(x) else "1" if is_exprs(x) else "2" if params(x) else "3" if header(x) else "1" if array(x) or yielded(x) else ""

    square = _remembered(lambda x: "6" if array(x) else "")
    brace = _remembered(lambda x: "9" if not x else "7" if is_block(x) and _elses(x) else "k" if body_of(x) else "8" if is_exprs(x) or arms(x) or many(x) else "r" if rule(x) else "")

    def ok(classes: str) -> bool:
        rest = _brackets(classes, paren, square, brace)
        return rest is not None and bool(is_block(rest)) and _elses(rest)

    return ok


def _lua() -> Callable[[str], bool]:
    prim = rf"(?:n|x|b|(?:i|[158]|s)(?:(?:d|:)i|6|[158]|s)*+)"
    unary = rf"[u!~]*+{prim}"
    expr = rf"(?>{unary}(?:[ou~]{unary})*+)"
    exprs = _list(expr)
    target = r"[i15](?:(?:(?:d|:)i|6|[158]|s)*+(?<=[i6]))?"
    call = r"[i15](?:(?:d|:)i|6|[158]|s)++(?<=[158s])"
    stat = rf"(?:Vi(?:oio)?(?:,i(?:oio)?)*+(?:={exprs})?|VB|{target}(?:,{target})*+={exprs}|{call}|B|p{expr}|Ji?|gig|;)"
    body = rf"(?:{stat})*+(?:R(?:{exprs})?;?)?"
    rules = {
        "F": _full(rf"F(?:i(?:di)*+(?::i)?)?[15]{body}e"), "I": _full(rf"I{expr}T{body}(?:L{expr}T{body})*+(?:E{body})?e"), "W": _full(rf"W{expr}D{body}e"),
        "O": _full(rf"O(?:i={expr}(?:,{expr}){{1,2}}|i(?:,i)*+N{exprs})D{body}e"), "D": _full(rf"D{body}e"), "P": _full(rf"P{body}"),
    }
    names, table, index = _full(r"(?:[ix](?:,[ix])*+)?"), _full(rf"(?>(?:(?:6|i)=)?{expr}(?:[,;]|$))*+"), _full(expr)
    is_args, is_body = _full(exprs), _full(body)
    closed = {
        ")": ("(", _remembered(lambda x: "5" if names(x) else "1" if is_args(x) else "")),
        "]": ("[", _remembered(lambda x: "6" if index(x) else "")),
        "}": ("{", _remembered(lambda x: "8" if table(x) else "")),
    }
    ends = _remembered(lambda x: ("b" if x[1] in "15" and x[0] == "F" else "B") if rules[x[0]](x) else "")
    marks = re.compile(r"([()\[\]{}FIWODPey])")

    def ok(classes: str) -> bool:
        stack: list[list] = []
        parts: list[str] = []
        for x in marks.split(classes):
            if x in closed:
                opener, rule = closed[x]
                if not stack or stack[-1][0] != opener or not (letter := rule("".join(parts))):
                    return False
                parts = stack.pop()[1]
                parts.append(letter)
            elif x == "D" and stack and stack[-1][0] in "WO" and not stack[-1][2]:
                stack[-1][2] = True
                parts.append(x)
            elif x and x in "([{FIWODP":
                stack.append([x, parts, False])
                parts = []
            elif x == "e" or x == "y":
                if not stack or (stack[-1][0] in "FIWOD") != (x == "e") or stack[-1][0] in "([{":
                    return False
                opener, outer, _ = stack.pop()
                text = opener + "".join(parts)
                if x == "y":
                    letter = "p" if rules["P"](text) else ""
                else:
                    letter = ends(text + "e")
                if not letter:
                    return False
                parts = outer
                parts.append(letter)
            else:
                parts.append(x)
        return not stack and bool(is_body("".join(parts)))

    return ok


def _ruby() -> Callable[[str], bool]:
    prim = r"(?:i|n|s++|[1568]|b|x[15]?(?:8|q))"
    post = r"(?:d(?:i|1|[RIWBKOcfeEagrwvDo])|[156]|8|q)"
    simple = rf"(?>(?:[um&!h]|d(?=i))*+{prim}{post}*+)"
    expr = rf"(?>{simple}(?:[oumw&Q:=<]{simple})*+)"
    item = rf"(?:k(?:{expr})?|{expr}(?:[l:]{expr}|(?:o|od)(?=[,;~v]|$))?|[mh&])"
    items = rf"{item}(?:,{item})*+"
    call = rf"(?:{items}(?:(?<=i){items})?)"
    stm = rf"(?!k)(?:R?{call}|R|a[inoumf&](?:,?[inoum&])*+)(?:[vr](?:R?{call}|R))*+"
    params = rf"(?:5|[mh&]*+(?:i(?:={expr})?|k(?:{expr})?)(?:,[mh&]*+(?:i(?:={expr})?|k(?:{expr})?))*+)?"
    name = r"(?:[ibA-Z]d)?(?:[ioum&!]|[a-zA-Z]|6)=?"
    is_stm, header = _full(stm), {
        "f": _full(rf"f{name}{params}"), "c": _full(rf"c(?:i(?:di)*+(?:o{expr})?|oi)"), "I": _full(rf"I{call}"), "W": _full(rf"W{call}"),
        "O": _full(rf"Oi(?:,i)*+w{expr}"), "K": _full(rf"K(?:{call})?"), "B": _full("B"), "D": _full("D"),
    }
    is_params = _full(rf"(?>(?:[mh&]*+(?:[i5](?:={expr})?|k(?:{expr})?)|[mh&])(?:,|$))*+|od")
    endless = _full(rf"f{name}{params}={stm}")
    inner = {"I": _full(rf"L{call}|E"), "K": _full(rf"w{items}(?:v{call})?|E")} | dict.fromkeys("fBDc", _full(rf"r(?:{items})?(?:l{expr})?|E|g"))
    is_args = _full(rf"(?:{call},?|(?:[m&]*+(?:i|k)(?:=?{expr})?,?)*+)?")
    table = _full(rf"(?>(?:k(?:{expr}(?:l{expr})?)?|{expr}[l:]{expr}|h(?:{expr})?)(?:,|$))*+")
    joined = re.compile(r"(?<=[,oum&=Q:dl!({\[])~++|(?<!~)~++(?=[d)\]}])")

    def lines(x: str) -> bool:
        return all(is_stm(y) for y in re.split("[~;]+", x) if y)

    def block(x: str) -> str:
        first, *rest = re.split("[~;]+", x)
        k = x[0]
        if not header[k](first):
            return ""
        for y in rest:
            if y and not is_stm(y) and not (k in inner and inner[k](y)):
                return ""
        return "q" if k == "D" else "b"

    ends = _remembered(block)
    closed = {
        ")": ("(", _remembered(lambda x: "5" if is_params(x.replace("~", "")) else "1" if is_args(x.replace("~", "")) or lines(x) else "")),
        "]": ("[", _remembered(lambda x: "6" if is_args(x.replace("~", "")) else "")),
        "}": ("{", _remembered(lambda x: "8" if table(x.replace("~", "")) or lines(x) else "")),
    }
    marks = re.compile(r"([()\[\]{}fcIWOKBDe~;])")

    def ok(classes: str) -> bool:
        x = joined.sub("", classes).replace("T", "~")
        x = re.sub(r"(?<!d)[Eg]", "~\\g<0>~", x)
        stack: list[list] = []  # opener, what stands before it, whether its first line is over
        parts: list[str] = []

        def unended() -> bool:
            """Is the definition on top one without an end?"""
            text = "".join(parts)
            return "=" in text and bool(endless("f" + text)) and not re.fullmatch("[^=]+=[15]", text)

        for i, x in enumerate(marks.split(x)):
            if not i % 2:
                parts.append(x)
            elif parts and parts[-1][-1:] == "d" and x in "fcIWOKBDe":  # a method of that name
                parts.append("i")
            elif x in "~;":
                if stack and not stack[-1][2]:
                    if stack[-1][0] == "f" and unended():
                        parts = stack.pop()[1]
                        parts.append("b")
                    else:
                        stack[-1][2] = True
                parts.append(x)
            elif x == "D" and stack and stack[-1][0] in "WO" and not stack[-1][2]:
                stack[-1][2] = True
                parts.append("~")
            elif x in closed:
                opener, rule = closed[x]
                if not stack or stack[-1][0] != opener or not (letter := rule("".join(parts))):
                    return False
                parts = stack.pop()[1]
                parts.append(letter)
            elif x == "e":
                if stack and stack[-1][0] == "f" and not stack[-1][2] and unended():
                    parts = stack.pop()[1]
                    parts.append("b~")
                if not stack or stack[-1][0] in "([{":
                    return False
                opener, outer, _ = stack.pop()
                if not (letter := ends(opener + "".join(parts))):
                    return False
                parts = outer
                parts.append(letter)
            else:
                stack.append([x, parts, x in "([{BD"])
                parts = ["~"] if x in "BD" else []
        if stack and stack[-1][0] == "f" and not stack[-1][2] and unended():
            parts = stack.pop()[1]
            parts.append("b")
        return not stack and lines("".join(parts))

    return ok


@lru_cache(None)
def _grammar(language: str) -> Callable[[str], bool]:
    return {"C": _c, "Java": _java, "JavaScript": _javascript, "Go": _go, "PHP": _php, "Lua": _lua, "Ruby": _ruby}[language]()


#: What the first tokens of a text have to be, and what none of them may be next to each other, if the grammar is to take it: most foreign code is refused so, without reading on.
_FIRST = {
    "C": re.compile(r"[qtTiym,aA]*+(?:[({=;\[]|$)|qs|;"),
    "Java": re.compile(r";*+(?:P[qi]?+i?+(?:d[io])*+d?(?:;|$)|@|C|q++(?:[@C]|$)|ii|$)"),
    "JavaScript": re.compile(r"(?![o=d,:Q)\]}]|Mi(?:,i)*+[~d;]|Ci[:(]|iiM|i+[CF])"),
    "Go": re.compile(r";*+(?:P$|Pi$|Pi;|$)"),
    "PHP": re.compile(""),
    "Ruby": re.compile(r"(?![=,)\]}l])"),
    "Lua": re.compile(r";*+(?:i(?:[d:(\[{s=,]|$)|V(?:[iF]|$)|F(?:i(?!(?:di)*+\([ix,]*\)\{)|$)|[IDWOP(RJg]|$)"),
}
_NEVER = {
    "C": re.compile(r"n[nis]|in"), "Java": re.compile(r"n[ns]|s[ns]"), "JavaScript": re.compile(r"[ns\]][ns]|ni|\]i"), "Go": re.compile(r"n[ns]|s[ns]"), "PHP": re.compile(r"n[ns]|s[ns]"),
    "Ruby": re.compile(r"iii|(?<!a)n[nsi]|[)\]}][nsi]|s[ni]|ck|ci[(:]|fi\([^()]*\):"), "Lua": re.compile(r"nn|ns|sn"),
}


def _may_be(text: str, language: str) -> bool:
    """Could the text be in the language, by its first tokens?"""
    for most in (6, 40):
        first = lex(text, language, most)
        if first.error or not _FIRST[language].match(first.classes) or _NEVER[language].search(first.classes):
            return False
    return True


def parses(text: str, language: str, lexed: Lexed | None = None) -> bool:
    """Is the text valid in the language? Empty text is; a byte order mark at its start is passed over."""
    if language not in LANGUAGES:
        raise ValueError(f"no grammar for {language}")
    if not text.strip("﻿ \t\r\n\f\v"):
        return True
    if language == "Python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.removeprefix("﻿"))
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    if lexed is None and not _may_be(text, language):
        return False
    lexed = lexed or lex(text, language)
    return not lexed.error and _grammar(language)(lexed.classes)


# Tokens by which code of each language is told apart; one that several languages share counts in part for each.
_MARKS = {
    "Python": "def elif None self import from except raise True False pass lambda with yield logger __init__ print assert global",
    "JavaScript": "function const let var => === !== console require exports module typeof throw new undefined null async await export",
    "Java": "public private protected class package import System int void String final static extends implements throws throw new boolean @Override List",
    "C": "#include #define #ifdef #endif int void char struct sizeof static const typedef unsigned long -> NULL size_t printf inline",
    "Go": "package func := range fmt chan nil defer interface struct import type panic var string error map",
    "PHP": "<?php function echo namespace use => -> $this foreach throw new public static array_ count $",
    "Ruby": "def end do require require_relative puts elsif unless attr_accessor nil each module raise then self @",
    "Lua": "local function then end nil elseif .. ~= ipairs pairs repeat until require",
}
_SETS = {k: frozenset(v.split()) for k, v in _MARKS.items()}
_WEIGHTS = {w: 1 / sum(w in x for x in _SETS.values()) for s in _SETS.values() for w in s}
_TOKENS = re.compile(r"#?[^\W\d]\w*|<\?php|=>|->|[!=]==|:=|\.\.|~=|\$(?=\w)|@(?=\w)")


def rank(text: str, declared: str | None = None) -> list[tuple[float, str]]:
    """(score, language), the likeliest first: the marks of each language that occur in the text; ties go to ``declared``, then by name."""
    found = set(_TOKENS.findall(text))
    scores = [(sum(_WEIGHTS[w] for w in found & s), x) for x, s in _SETS.items()]
    return sorted(scores, key=lambda x: (-x[0], x[1] != declared, x[1]))


#: Languages whose own grammar decides: every file begins with a package or a mark of its own, or holds classes only, or the parser is the language's own.
STRICT = frozenset(("Python", "Java", "Go", "PHP"))


def _code_only(text: str, lexed: Lexed | None) -> str:
    if not lexed or not lexed.comments:
        return text
    edges = [0, *(x for span in lexed.comments for x in span), len(text)]
    return " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def is_valid(text: str, declared: str, lexed: Lexed | None = None, margin: float = 1.0) -> bool:
    """Does its own grammar take the file, and none whose marks are more than twice as many and ``margin`` (some grammars read foreign code)? As findings() says, without the parses that only tell what else the file may be."""
    lexed = lexed or (lex(text, declared) if declared != "Python" else None)
    if not parses(text, declared, lexed):
        return False
    if declared in STRICT:
        return True
    ranked = rank(_code_only(text, lexed), declared)
    least = 2 * dict((x, s) for s, x in ranked)[declared] + margin
    return not any(s > least and x != declared and not _lone(text) and parses(text, x) for s, x in ranked)


def _lone(text: str) -> bool:
    """Is it a single word? That a foreign grammar takes it tells nothing."""
    return bool(re.fullmatch(r"\s*+\w++\s*+", text))


def findings(text: str, declared: str, lexed: Lexed | None = None, margin: float = 1.0) -> tuple[bool, str, str | None, list[str]]:
    """(valid, finding, language that parses, other languages that parse) of a file whose language is said to be ``declared``.

    The languages are ranked by tokens, and the file is parsed by all of them. It is ``valid`` if its own grammar takes it, unless one whose
    marks are more than twice as many and ``margin`` takes it too (some grammars read foreign code). If its own fails, it has the
    ``wrong_extension`` if a foreign grammar takes it, the first in rank; if all fail, it is a ``merge_conflict`` where conflict markers stand
    in it, otherwise ``corrupt``. That a foreign grammar takes a file of a single word tells nothing.
    """
    lexed = lexed or (lex(text, declared) if declared != "Python" else None)
    own = parses(text, declared, lexed)
    ranked = rank(_code_only(text, lexed) if own else text, declared)
    score = {x: s for s, x in ranked}
    others = [] if _lone(text) else [x for _, x in ranked if x != declared and parses(text, x)]
    if own:
        better = [] if declared in STRICT else [x for x in others if score[x] > 2 * score[declared] + margin]
        return (False, "wrong_extension", better[0], others) if better else (True, "valid", declared, others)
    if others:
        return False, "wrong_extension", others[0], others
    marked = re.search(r"^<{7}(?: [^\n]*)?$", text, re.M)
    marked = marked and re.compile(r"^={7}\s*?$", re.M).search(text, marked.end())
    marked = marked and re.compile(r"^>{7}(?: [^\n]*)?$", re.M).search(text, marked.end())
    return False, "merge_conflict" if marked else "corrupt", None, []


def diagnose(text: str, declared: str, lexed: Lexed | None = None, margin: float = 1.0) -> tuple[bool, str, str | None]:
    """The first three of findings()."""
    return findings(text, declared, lexed, margin)[:3]
