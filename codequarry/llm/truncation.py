"""Problem 2: texts that were cut off, by field limits or on the way.

``storage_limits`` recomputes the length of each text under several encodings and escapings, and finds by source the lengths at which
texts pile up with next to nothing beyond: hidden limits. ``truncated`` inspects the endings, helped by the limits; ``truncation_rates`` sums up.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .lineage import materialised
from .prose import _CJK

# What a text is said to be followed by where its rest was lost.
_NOTE = re.compile(r"(?i)(?:…|\.\.\.)?\s*(?:[\[(<{]\s*(?:…|\.{2,3}|(?:text |output |answer |response )?(?:was )?(?:cut|truncated|more|continued?|clipped|snip(?:ped)?|omitted|shortened|rest|abridged)\b[^\])>}]{0,40})\s*[\])>}]|\bread more|<(?:cut|snip|truncated)/?>|…|-- ?more ?--)\s*$")
_VERDICT = re.compile(r"(?i)^[\s*_#>`\"'(-]*(?:(?:final |the )?(?:answer|verdict|judg[e]?ment)(?: is)?\s*[:：]?\s*[*_\"'`]*)?(?:yes|no|true|false|relevant|irrelevant|not relevant|是|不是|否|对|不对|相关|不相关)(?![a-z])")
_ANY_VERDICT = re.compile(r"(?i)(?<![a-z])(?:yes|no)(?![a-z])|[是否]")
_BARE = re.compile(r"(?i)^[\s*_`\"'#>(-]*(?:(?:final |the )?(?:answer|verdict)(?: is)?\s*[:：]?\s*[*_\"'`]*)?(?:yes|no|true|false|是|不是|否|对|不对)[\s*_`\"')!.。！]*(?:\([^()]*\))?[\s*.!。！]*$")
_ABBREVIATION = re.compile(r"(?i)\b(?:e\.g|i\.e|cf|vs|mr|mrs|dr|fig|eq|no|approx)\.$")
_END = re.compile(r"[.!?。！？][\"'”’»)\]}*_`]*$")
_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d{1,2}[.)])\s*$")
_EMOJI = re.compile(r"[\u2600-\u27bf\u2b50-\u2b55\U0001f300-\U0001faff\ufe0f\u200d]+\s*$")


def _json_end(text: str) -> str | None:
    body = re.sub(r"^```\w*\s*|\s*```$", "", text)
    try:
        json.loads(body)
        return None
    except ValueError:
        pass
    depth, quoted, i = 0, False, 0
    for m in re.finditer(r'\\.|["{}\[\]]', body, re.S):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            depth += 1
        elif not quoted and c in "}]":
            depth -= 1
    return "open" if depth > 0 or quoted else None


def ending(text: str | None) -> str | None:
    """How the text stops before its end, or None if it doesn't show it.

    note: a note stands in place of the rest; character, word, sentence: what the end stands in; open: something opened isn't closed;
    no_verdict: the reasoning ends without a verdict; ellipsis: it ends in three dots, which may be the rest's or the sentence's own;
    item: it ends with an item of a list, which has no mark of its end. Null and blank text: None.
    """
    if not text or not text.strip():
        return None
    t = text.rstrip()
    if _NOTE.search(t):
        return "note"
    if t[-1] == "\ufffd" or 0xD800 <= ord(t[-1]) < 0xE000:
        return "character"
    if t[0] in "{[" or re.match(r"```(?:json)?\s*[{\[]", t):
        return _json_end(t)
    if re.search(r"</?[a-zA-Z]*$", t) or t.count("<think>") > t.count("</think>"):
        return "open"
    thought = "</think>" in t
    body = t.rpartition("</think>")[2].strip() if thought else t
    if not body:
        return "no_verdict"
    if "```" not in body and _BARE.match(body) and body.count("**") % 2 == 0 and body.count("(") == body.count(")"):
        return None
    flat = re.sub(r"```[\s\S]*?```", " ", body)
    if "```" in flat or re.search(r"(?<!`)`{1,2}$", body) and body.count("`") % 2:
        return "open"
    flat = re.sub(r"`[^`\n]*`", " ", flat)
    if "`" in flat or flat.count("**") % 2 or flat.count('"') % 2 or flat.count("“") > flat.count("”"):
        return "open"
    plain = re.sub(r"(?m)^\s*\w{1,2}\)|[:;]-?[()]", " ", flat)
    if any(plain.count(a) > plain.count(b) for a, b in ("()", "[]", "{}", "（）", "「」")):
        return "open"
    if not (_VERDICT.match(body) or _ANY_VERDICT.search(body)):
        return "no_verdict"
    if body.endswith("```") or _EMOJI.search(body):
        return None
    if body.endswith("..."):
        return "ellipsis"
    if _ITEM.search(body) or _ABBREVIATION.search(body):
        return "sentence"
    if _END.search(body) or body[-1] in ")）」*" or body.endswith(("**", "”")):
        return None
    last = body.rpartition("\n")[2]
    if re.match(r"\s*(?:[-*•]|\d{1,2}[.)])\s+\S", last):
        return "item"
    return "word" if last[-1:].isalpha() and not _CJK.match(last[-1]) else "sentence"


def last_sentence(text: str | None) -> str | None:
    """The last sentence or list item, digits masked: by it, ends of the same form are known again."""
    if not text:
        return None
    t = re.sub(r"\d+", "9", text.rstrip())
    return re.split(r"(?<=[.!?。！？])\s+|\n+\s*(?:\d{1,2}[.)]|[-*•])?\s*|</?think>", t)[-1][-200:]


def inner_sentences(text: str | None) -> list[str]:
    """The sentences that end in three dots, and list items, that are followed by more: digits masked."""
    if not text or "..." not in text and "\n" not in text:
        return []
    t = re.sub(r"\d+", "9", text)
    out = {m[1][-200:] for m in re.finditer(r"(?:(?<=[.!?。！？]\s)|(?<=\n)|^|(?<=>))[ ]*([^.!?。！？\n]*\.\.\.)(?=\s+\S)", t)}
    return sorted(out | {m[1][-200:] for m in re.finditer(r"\n\s*9[.)] ([^\n]{1,80})\n+(?!\s*9[.)])(?=\S)", t)} | {m[1] for m in re.finditer(r"\n\s*9[.)] ([^\n]{1,40}?) (?=[A-Z<])", t)})


# ---- lengths


def measures(text: Column) -> dict[str, Column]:
    """The length of a text as different stores would count it. Line breaks count two where they are sent as CR LF; escapes as JSON, HTML, or doubled quotes."""
    n = F.char_length(text)
    utf8 = F.octet_length(text)

    def extra(pattern: str, by: int) -> Column:
        return by * F.regexp_count(text, F.lit(pattern))

    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    wide = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    breaks = F.regexp_count(text, F.lit(r"(?<!\r)\n"))
    json_ = extra(r'["\\\n\r\t]', 1)
    html = extra("&", 4) + extra("[<>]", 3)
    quotes = extra('"', 5) + extra("'", 5)
    return {
        "characters": n,
        "utf8_bytes": utf8,
        "utf16_units": n + astral,
        "latin1_bytes": n,
        "json": n + json_,
        "json_utf8": utf8 + json_,
        "json_ascii": n + json_ + 5 * wide + 6 * astral,
        "html": n + html,
        "html_utf8": utf8 + html,
        "html_quotes": n + html + quotes,
        "html_quotes_utf8": utf8 + html + quotes,
        "crlf": n + breaks,
        "crlf_utf8": utf8 + breaks,
        "sql_quotes": n + extra("'", 1),
    }


def storage_limits(texts: DataFrame, source: list[str], text: str = "text", least: int = 5, beyond: float = 0.05, contrast: float = 6.0) -> DataFrame:
    """A row (source columns, measure, max_length, n_at, n_beyond, n_texts) for each source with a hidden limit, under the measure that shows it best.

    A limit is a length that at least ``least`` texts have exactly, ``contrast`` times as many as the lengths up to 20 below it have on
    average, and that at most a share ``beyond`` of the texts exceeds. Only counts per length are shuffled: a source of any size leaves one row per
    length and measure. Null and blank texts don't count; an empty table gives no rows. Ties go to the more exact fit (fewer beyond), then to the simpler measure.
    """
    t = texts.filter(F.trim(F.col(text)) != "")
    m = measures(F.col(text))
    long = t.select(*source, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("length")) for k, v in m.items() if k != "latin1_bytes"))).alias("_m")).select(*source, "_m.*")
    counts = long.groupBy(*source, "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*source, "measure").orderBy("length")
    counts = (
        counts.withColumn("below", F.coalesce(F.sum("n").over(by.rangeBetween(-20, -1)), F.lit(0)))
        .withColumn("n_beyond", F.coalesce(F.sum("n").over(by.rangeBetween(1, W.unboundedFollowing)), F.lit(0)))
        .withColumn("n_texts", F.sum("n").over(W.partitionBy(*source, "measure")))
    )
    spikes = counts.filter((F.col("n") >= least) & (F.col("n") >= contrast * F.col("below") / 20) & (F.col("n_beyond") <= F.greatest(F.lit(1.0), beyond * F.col("n_texts"))) & (F.col("n_beyond") < F.col("n")))
    order = F.array_position(F.array(*(F.lit(k) for k in m)), F.col("measure"))
    best = W.partitionBy(*source).orderBy((F.col("n") - F.col("n_beyond")).desc(), F.col("n").desc(), order, "length")
    return spikes.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*source, "measure", F.col("length").alias("max_length"), F.col("n").alias("n_at"), "n_beyond", "n_texts")


def truncated(texts: DataFrame, key: list[str], source: list[str], text: str = "text", limits: DataFrame | None = None) -> DataFrame:
    """A row (key, source columns, reason, at_limit) for each text that stops before its end.

    A text counts as cut if its ending shows it (``ending``). One that ends in three dots, or with a list item, is whole if the same sentence, digits
    aside, stands inside other texts, unless it is exactly as long as its source's hidden limit (at_limit), or that with a note. A text of that very
    length whose ending is whole is no case: about as many whole texts have any length near it. Null and blank texts are no cases. Repeated rows count each. limits: those of storage_limits, by default found here.
    Other columns, whatever their names, are not looked at. The limits are few (one per source) and joined; Spark broadcasts them if they are small.
    """
    t = texts.select(*key, *source, F.col(text).alias("_t")).filter(F.trim("_t") != "")
    limits = storage_limits(t, source, "_t") if limits is None else limits

    @F.pandas_udf("reason string, last string, inner array<string>")
    def inspect(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            why = ending(x)
            rows.append((why, last_sentence(x) if why in ("ellipsis", "item") else None, inner_sentences(x)))
        return pd.DataFrame(rows, columns=["reason", "last", "inner"])

    m = measures(F.col("_t"))
    seen = t.withColumn("_i", inspect("_t"))
    lengths = F.create_map(*(x for k, v in m.items() if k != "latin1_bytes" for x in (F.lit(k), v.cast("long"))))
    note = F.length(F.regexp_extract("_t", r"(\s*(?:…|\.\.\.)?\s*(?:\[[^\]]{0,30}\]|\([^)]{0,30}\))|…|\.\.\.)\s*$", 1))
    seen = seen.select(*key, *source, F.col("_i.reason").alias("reason"), F.col("_i.last").alias("_last"), F.col("_i.inner").alias("_inner"), lengths.alias("_n"), F.char_length("_t").alias("_c"), note.alias("_note"))
    seen = materialised(seen)
    known = seen.select(F.explode("_inner").alias("_last")).distinct().withColumn("_known", F.lit(True))
    at = F.col("_n")[F.col("measure")]
    checked = seen.drop("_inner").join(known, "_last", "left").join(limits.select(*source, "measure", "max_length"), source, "left")
    at_limit = F.coalesce((at == F.col("max_length")) | ((F.col("_note") > 0) & (at - F.col("_note") <= F.col("max_length")) & (at >= F.col("max_length"))), F.lit(False))
    doubtful = F.col("reason").isin("ellipsis", "item") & F.col("_known") & ~at_limit
    return (
        checked.withColumn("at_limit", at_limit)
        .withColumn("reason", F.when(~F.coalesce(doubtful, F.lit(False)), F.col("reason")))
        .filter(F.col("reason").isNotNull())
        .select(*key, *source, "reason", "at_limit")
    )


def truncation_rates(texts: DataFrame, key: list[str], source: list[str], text: str = "text") -> DataFrame:
    """A row (source columns, n_texts, n_truncated, rate, measure, max_length) for each source; sources without a hidden limit have none there."""
    t = texts.select(*key, *source, F.col(text).alias("_t")).filter(F.trim("_t") != "")
    limits = storage_limits(t, source, "_t")
    cut = truncated(t, key, source, "_t", limits).groupBy(*source).agg(F.count(F.lit(1)).alias("n_truncated"))
    every = t.groupBy(*source).agg(F.count(F.lit(1)).alias("n_texts"))
    return (
        every.join(cut, source, "left")
        .join(limits.select(*source, "measure", "max_length"), source, "left")
        .select(*source, "n_texts", F.coalesce("n_truncated", F.lit(0)).cast("long").alias("n_truncated"), (F.coalesce("n_truncated", F.lit(0)) / F.col("n_texts")).alias("rate"), "measure", "max_length")
    )
