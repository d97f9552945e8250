"""Pairs of comment and function mined from parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import PAIR_LANGUAGES, clean_brief, clean_multi_line_comment, clean_single_line_group, comment_to_query, extension, is_function, text_between
from .spans import blank_before, group_lines, join_comments, strip_spans


def with_bytes(files: DataFrame, *columns: str) -> DataFrame:
    """The columns and the content's bytes as _d, encoded once a file: what is cut out of them is cut in the file's row, so that no content is copied to each span."""
    return files.select(*columns, F.explode(F.array(F.encode("content", "UTF-8"))).alias("_d"))


def file_slices(files: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, pos, id, type, identifier, text) of each snippet; text is null where the bytes are no valid text."""
    cut = F.transform("snippets", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["identifier"].alias("identifier"), text_between(F.col("_d"), x["start_byte"], x["end_byte"]).alias("text")))
    return with_bytes(files, file, "snippets").select(file, F.posexplode(cut).alias("pos", "_x")).select(file, "pos", "_x.*")


def file_spans(files: DataFrame, what: str, file: str = "file_id", *more: str) -> DataFrame:
    """One row a snippet or comment of each file, with flat columns, and more fields if there are; its place in the list is pos."""
    flat = files.select(file, F.posexplode(what).alias("pos", "_x"))
    extra = ["scope", "type", "identifier"] if what == "snippets" else ["is_multi_line"]
    point = [F.col(f"_x.{p}_point")[i].alias(f"{p}_{n}") for p in ("start", "end") for i, n in enumerate(("row", "col"))]
    return flat.select(file, "pos", "_x.id", "_x.start_byte", "_x.end_byte", *point, *(f"_x.{x}" for x in (*extra, *more)))


def comment_groups(files: DataFrame, file: str = "file_id", strict: bool = True) -> DataFrame:
    """Block comments as they are, and runs of comment lines as one: (file, id, start_byte, end_byte, start_row, end_row, many)."""
    begins = F.transform("comments", lambda x: x.withField("line_start", blank_before(F.col("_d"), x["start_byte"], x["start_point"][1], strict)))
    c = file_spans(with_bytes(files, file, "comments").select(file, begins.alias("comments")), "comments", file, "line_start")
    blocks = c.filter("is_multi_line").select(file, "id", "start_byte", "end_byte", "start_row", "end_row", F.lit(True).alias("many"))
    lines = c.filter("NOT is_multi_line")
    return blocks.unionByName(group_lines(lines, file).select(file, "id", "start_byte", "end_byte", "start_row", "end_row", F.lit(False).alias("many")))


def mine_pairs(files: DataFrame, file: str = "file_id", strict: bool = True) -> DataFrame:
    """(file, repo_name, lang, path, comment, query, snippet, scope, identifier, type, comment_id, snippet_id) for each comment and function it documents.

    Languages without pairs, and null contents, have no rows. A pair whose query is empty is left out; one whose language has no rule for queries has a null query
    and is for rejects(). snippet is the function's text without the comments in it.
    """
    ready = files.filter(F.col("language").isin(*PAIR_LANGUAGES) & F.col("content").isNotNull())
    functions = file_spans(ready, "snippets", file).join(ready.select(file, "language"), file).filter(is_function(F.col("type"), F.col("language"))).drop("language")
    comments = comment_groups(ready, file, strict)
    hits = join_comments(comments, functions, file)
    f = functions.select(file, F.col("id").alias("function_id"), F.col("start_byte").alias("fa"), F.col("end_byte").alias("fb"), "scope", "identifier", "type")
    c = comments.select(file, F.col("id").alias("comment_id"), F.col("start_byte").alias("ca"), F.col("end_byte").alias("cb"), "many")
    full = hits.join(f, [file, "function_id"]).join(c, [file, "comment_id"])
    of_file = full.groupBy(file).agg(F.collect_list(F.struct(*(x for x in full.columns if x != file))).alias("_p"))
    texts = with_bytes(ready.withColumnRenamed("language", "lang"), file, "repo_name", "path", "lang", "comments")

    def cut(p):
        inside = F.transform(F.filter("comments", lambda x: (x["start_byte"] >= p["fa"]) & (x["end_byte"] <= p["fb"])), lambda x: F.struct((x["start_byte"] - p["fa"]).alias("start_byte"), (x["end_byte"] - p["fa"]).alias("end_byte")))
        body = text_between(F.col("_d"), p["fa"], p["fb"])
        return F.struct(*(p[x].alias(x) for x in ("comment_id", "function_id", "many", "scope", "identifier", "type")), text_between(F.col("_d"), p["ca"], p["cb"]).alias("_raw"), strip_spans(body, inside).alias("snippet"))

    full = of_file.join(texts, file).select(file, "repo_name", "path", "lang", F.explode(F.transform("_p", cut)).alias("_x")).select(file, "repo_name", "path", "lang", "_x.*")
    raw = F.col("_raw")
    lang = F.col("lang")
    cleaned = clean_brief(F.when(F.col("many"), clean_multi_line_comment(raw, lang)).otherwise(clean_single_line_group(raw, lang)))
    # exploded, not projected: what is filtered below would be pushed into the projections and evaluated again at each mention
    out = full.select("*", F.explode(F.array(cleaned)).alias("comment"))
    out = out.select("*", F.explode(F.array(comment_to_query(F.col("comment"), lang, F.col("identifier")))).alias("query"))
    return out.filter(F.col("query").isNull() & F.col("comment").isNotNull() | (F.col("query") != "")).select(
        file, "repo_name", "lang", "path", "comment", "query", "snippet", "scope", "identifier", "type", "comment_id", F.col("function_id").alias("snippet_id")
    )


def accepted(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("query").isNotNull())


def rejects(pairs: DataFrame) -> DataFrame:
    """The pairs of languages that have no rule for queries."""
    return pairs.filter(F.col("query").isNull())


def resolve_headers(pairs: DataFrame, bodies: DataFrame, by: str = "repo_name") -> DataFrame:
    """The pairs of header files with the implementation in place of the declaration: by a name that is unique among the repository's headers.

    bodies: (by, name, place, snippet, snippet_id) of the functions in .c and .cpp files; of several with one name, the last by place counts. Pairs of headers
    without one are dropped; pairs of other files stay.
    """
    header = extension(F.col("path")).isin(".h", ".hpp") & F.col("lang").isin("C", "C++")
    heads = pairs.filter(header)
    single = heads.groupBy(by, "identifier").agg(F.countDistinct("snippet_id").alias("n")).filter("n = 1").drop("n")
    last = bodies.groupBy(by, F.col("name").alias("identifier")).agg(F.max_by(F.struct("snippet", "snippet_id"), "place").alias("_b"))
    swapped = heads.join(single, [by, "identifier"]).join(last, [by, "identifier"]).withColumn("snippet", F.col("_b.snippet")).withColumn("snippet_id", F.col("_b.snippet_id")).drop("_b")
    return pairs.filter(~F.coalesce(header, F.lit(False))).unionByName(swapped.select(*pairs.columns))
