"""Problem 1: natural language in the comments and string literals of source files.

``nl_spans`` is the operator: a row for each file and language, with the bytes of its text and their share of the file.
``nl_texts`` gives the texts themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .grammar import is_valid
from .langid import LanguageModel
from .lexers import LANGUAGES, Lexed, lex
from .once import once_each
from .prose import comment_lines, comment_runs, is_sentence, literal_text, paragraphs, sentences


def texts_of(text: str, language: str, lexed: Lexed | None = None) -> Iterator[tuple[str, int, int, list[str]]]:
    """(kind, begin, end, lines) of each comment run and string literal, in characters; literals with nothing but blanks between them count as one where the language joins them."""
    lexed = lexed or lex(text, language)
    for a, b in comment_runs(text, lexed):
        yield "comment", a, b, comment_lines(text[a:b])
    begin, end, parts = -1, -1, []
    for a, b in lexed.strings:
        raw = language in ("Ruby", "PHP") and text[a : a + 1] == "'"
        body = literal_text(text[a:b], raw) if language != "Ruby" or text[a : a + 1] in "\"'`%" else text[a:b]
        if not (parts and language in ("C", "Python") and not text[end:a].strip()):
            if parts:
                yield "string", begin, end, re.split(r"\r\n|[\n\r]", "".join(parts))
            begin, parts = a, []
        parts.append(body)
        end = b
    if parts:
        yield "string", begin, end, re.split(r"\r\n|[\n\r]", "".join(parts))


def languages_of(lines: list[str], model: LanguageModel) -> Iterator[tuple[str, str, bool]]:
    """(language, text, is it a natural sentence) of each sentence in the lines; a sentence of several languages comes in pieces. Those that the model takes for no language are left out, whatever their length."""
    for p in paragraphs(lines):
        parts = [(s, s.split()) for s in sentences(p)]
        tags = iter(model.segment([w for _, ws in parts for w in ws]))
        for s, ws in parts:
            got = [next(tags) for _ in ws]
            if len(set(got)) == 1:
                if (whole := is_sentence(s)) or model.natural(s):
                    yield got[0], s, whole
                continue
            i = 0
            while i < len(got):
                j = i
                while j < len(got) and got[j] == got[i]:
                    j += 1
                piece = " ".join(ws[i:j])
                if (whole := is_sentence(piece)) or model.natural(piece):
                    yield got[i], piece, whole
                i = j


_FOUND = T.StructType([T.StructField("parses", T.BooleanType()), T.StructField("nl_lang", T.StringType()), T.StructField("nl_bytes", T.LongType()), T.StructField("n_texts", T.LongType()), T.StructField("n_sentences", T.LongType())])


def analyse(text: str, language: str, model: LanguageModel, lexed: Lexed | None = None) -> list[dict]:
    size, texts, found = Counter(), Counter(), Counter()
    for _, _, _, lines in texts_of(text, language, lexed):
        here = set()
        for lang, piece, whole in languages_of(lines, model):
            size[lang] += len(piece.encode("utf-8", "replace"))
            found[lang] += whole
            here.add(lang)
        texts.update(here)
    return [{"nl_lang": k, "nl_bytes": size[k], "n_texts": texts[k], "n_sentences": found[k]} for k in sorted(size)]


def nl_spans(files: DataFrame, model: LanguageModel, key: str = "file_id", content: str = "content", language: str = "language") -> DataFrame:
    """A row (key, nl_lang, nl_bytes, share, n_texts, n_sentences, parses) for each file and language of its comments and string literals.

    nl_bytes: UTF-8 bytes of the text without markers and escapes; share: of the content's bytes; n_sentences: natural sentences of six
    words or more (zh, ja: twelve characters); parses: is the file valid in its language.
    Null content, and languages other than the eight, give no rows; neither do files without text. Repeated rows count each. Other columns, whatever their names, are not looked at.
    """
    shared = files.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(_FOUND))
    def read(contents: pd.Series, langs: pd.Series) -> pd.Series:
        m = shared.value

        def one(text: str, lang: str) -> list[dict]:
            lexed = lex(text, lang)
            found = analyse(text, lang, m, lexed)
            ok = bool(found) and is_valid(text, lang, lexed)
            return [{"parses": ok} | x for x in found]

        return pd.Series(once_each(one)(contents, langs))

    judged = files.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.col(language).alias("_l")).filter(F.col("_c").isNotNull() & F.col("_l").isin(*LANGUAGES))
    return (
        judged.select("_k", F.octet_length("_c").alias("_b"), F.explode(read("_c", "_l")).alias("_f"))
        .select(F.col("_k").alias(key), "_f.nl_lang", "_f.nl_bytes", (F.col("_f.nl_bytes") / F.greatest("_b", F.lit(1))).alias("share"), "_f.n_texts", "_f.n_sentences", "_f.parses")
    )


def nl_texts(files: DataFrame, model: LanguageModel, key: str = "file_id", content: str = "content", language: str = "language") -> DataFrame:
    """A row (key, kind, start_byte, end_byte, nl_lang, text) for each piece of natural text, in the order of the file; the rules of nl_spans hold."""
    shared = files.sparkSession.sparkContext.broadcast(model)
    schema = "array<struct<kind:string,start_byte:bigint,end_byte:bigint,nl_lang:string,text:string>>"

    @F.pandas_udf(schema)
    def read(contents: pd.Series, langs: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for text, lang in zip(contents, langs):
            rows, at, size = [], 0, 0
            for kind, a, b, lines in sorted(texts_of(text, lang), key=lambda x: x[1]):
                size += len(text[at:a].encode("utf-8", "replace")) if a >= at else -len(text[a:at].encode("utf-8", "replace"))
                begin = size
                size += len(text[a:b].encode("utf-8", "replace"))
                end, at = size, b
                rows += [{"kind": kind, "start_byte": begin, "end_byte": end, "nl_lang": x, "text": piece} for x, piece, _ in languages_of(lines, m)]
            out.append(rows)
        return pd.Series(out)

    judged = files.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.col(language).alias("_l")).filter(F.col("_c").isNotNull() & F.col("_l").isin(*LANGUAGES))
    return judged.select(F.col("_k").alias(key), F.explode(read("_c", "_l")).alias("_f")).select(key, "_f.*")
