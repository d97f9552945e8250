"""The language table: which files are read as which language, and what counts as a snippet and a comment there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    """extensions: with dot, case counts. snippets: kinds of definition. scoped: do snippets carry the headers around them. comments: the style."""

    name: str
    extensions: tuple[str, ...]
    snippets: tuple[str, ...]
    scoped: bool
    comments: str


# The sixteen languages.
LANGUAGES = (
    Language("C", (".c", ".h"), ("struct_specifier", "function_definition"), True, "cpp"),
    Language("C#", (".cs",), ("class_declaration", "method_declaration", "namespace_declaration"), True, "cpp"),
    Language("C++", (".cpp", ".h", ".hpp"), ("class_specifier", "function_definition", "namespace_definition"), True, "cpp"),
    Language("CSS", (".css",), ("rule_set",), False, "cpp"),
    Language("Go", (".go",), ("function_declaration", "type_declaration"), True, "cpp"),
    Language("Java", (".java",), ("class_declaration", "method_declaration"), True, "java"),
    Language("JavaScript", (".js", ".jsx"), ("class_declaration", "method_definition", "function_declaration"), True, "cpp"),
    Language("Julia", (".jl",), ("struct_definition", "function_definition"), True, "julia"),
    Language("Lua", (".lua",), ("function_declaration",), False, "lua"),
    Language("PHP", (".php",), ("function_definition", "class_declaration", "method_declaration"), True, "cpp"),
    Language("Python", (".py",), ("function_definition", "class_definition"), True, "py"),
    Language("R", (".R", ".r"), ("binary_operator",), False, "r"),
    Language("Ruby", (".rb",), ("class", "method"), True, "ruby"),
    Language("Rust", (".rs",), ("struct_item", "function_item", "impl_item"), True, "java"),
    Language("Scala", (".scala",), ("class_definition", "function_definition"), True, "scala"),
    Language("TypeScript", (".ts", ".tsx"), ("function_declaration", "class_declaration", "method_definition"), True, "cpp"),
)
BY_NAME = {x.name: x for x in LANGUAGES}


def table(spark: SparkSession) -> DataFrame:
    """The language table as rows."""
    return spark.createDataFrame([(x.name, list(x.extensions), list(x.snippets), x.scoped, x.comments) for x in LANGUAGES], "lang string, extensions array<string>, snippet_types array<string>, scoped boolean, comment_style string")
