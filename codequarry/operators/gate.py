"""Which files are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import extension
from .languages import LANGUAGES


def gate_status(language: Column, path: Column, length_bytes: Column, num_lines: Column, max_line_length: Column, encoding: Column, max_bytes: int = 1_000_000, max_lines: int = 10_000, max_line: int = 10_000) -> Column:
    """Why a file is not parsed, or null if it is: the first reason that holds.

    not_implemented: the language isn't known or the extension isn't one of its own; too_long_file, too_many_rows, too_long_line: beyond the
    limits; bad_encoding: other than UTF-8. A null size passes its test; a null language, path or encoding doesn't.
    """
    known = F.lit(False)
    for x in LANGUAGES:
        known = known | ((language == x.name) & extension(path).isin(*x.extensions))
    return (
        F.when(~F.coalesce(known, F.lit(False)), "not_implemented")
        .when(length_bytes > max_bytes, "too_long_file")
        .when(num_lines > max_lines, "too_many_rows")
        .when(max_line_length > max_line, "too_long_line")
        .when(F.coalesce(F.lower(encoding), F.lit("")) != "utf-8", "bad_encoding")
    )


def text_sizes(content: Column) -> dict[str, Column]:
    """length_bytes, num_lines and max_line_length of a text, where a table has none of its own."""
    lines = F.split(content, "\n", -1)
    return {"length_bytes": F.octet_length(content).cast("long"), "num_lines": F.size(lines).cast("long"), "max_line_length": F.array_max(F.transform(lines, F.char_length)).cast("long")}


def with_status(files: DataFrame) -> DataFrame:
    c = F.col
    return files.withColumn("status", gate_status(c("language"), c("path"), c("length_bytes"), c("num_lines"), c("max_line_length"), c("src_encoding")))
