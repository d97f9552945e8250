"""Queries of text functions, spans and pair mining, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import evaluate, gate, pairs, spans


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def file_gate_status(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    status = gate.gate_status(c("language"), c("path"), c("length_bytes"), c("num_lines"), c("max_line_length"), c("src_encoding"), 8_000, 250, 140)
    return _table(spark, d, "parse_source_code").select("file_id", F.coalesce(status, F.lit("success")).alias("status"))


def file_text_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "parse_source_code").filter("content IS NOT NULL").select("file_id", *(v.alias(k) for k, v in gate.text_sizes(F.col("content")).items()))


def file_stats_describe(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.describe(_table(spark, d, "parse_source_code").filter("language IS NOT NULL"), "num_lines", ["language"])
    return s.select("language", *(F.round(F.col(x).cast("double"), 6).alias(x) for x in s.columns[1:]))


def path_extension(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "parse_source_code").select("file_id", T.extension(F.col("path")).alias("ext"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code").filter("content IS NOT NULL AND language IS NOT NULL")
    return t.select("file_id", "language", F.posexplode(F.split("content", "\n", -1)).alias("row", "line")).withColumn("row", F.col("row").cast("long"))


def clean_single_line(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(F.regexp_like("line", F.lit(r"^\s*(#|//|--)"))).select("file_id", "row", T.clean_single_line_comment(F.col("line"), F.col("language")).alias("cleaned"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code").filter("content IS NOT NULL").select("file_id", F.col("content"))
    return t.select("file_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"), F.lit(0))).alias("n", "block")).withColumn("n", F.col("n").cast("long"))


def clean_multi_line(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("file_id", "n", T.clean_multi_line_comment(F.col("block"), F.lit("C")).alias("cleaned"))


def clean_brief(spark: SparkSession, d: str) -> DataFrame:
    cleaned = T.clean_multi_line_comment(F.col("block"), F.lit("C"))
    return _blocks(spark, d).select("file_id", "n", T.clean_brief(cleaned).alias("cleaned"))


def comment_to_query_skip(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.query_skip(F.col("text"), F.lit("voucher")).alias("q"))


def comment_to_query_break(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.query_break(F.col("text"), T.PYTHON_STOPS).alias("q"))


def comment_to_query_summary(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("x <summary> "), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit(" </summary> rest")))
    return _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.query_summary(marked).alias("q"))


def group_lines_islands(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).filter(F.regexp_like("line", F.lit(r"^[ \t]*(#|//|--)")))
    comments = lines.select("file_id", F.col("row").cast("string").alias("id"), F.col("row").alias("start_byte"), (F.col("row") + 1).alias("end_byte"), F.col("row").alias("start_row"), F.col("row").alias("end_row"), F.regexp_like("line", F.lit(r"^[ \t]")).alias("line_start"))
    return spans.group_lines(comments).select("file_id", F.col("id").cast("long").alias("first_row"), F.col("end_row").alias("last_row"), "n")


def comment_group_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code").filter("content IS NOT NULL")
    return pairs.comment_groups(t, strict=False).select("file_id", F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"), "many")


def strip_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code").filter("content IS NOT NULL")
    return t.select("file_id", F.octet_length(spans.strip_spans(F.col("content"), F.col("comments"))).cast("long").alias("bytes_left"))


def byte_slice(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code").filter("content IS NOT NULL")
    return pairs.file_slices(t).select("file_id", F.col("pos").cast("long").alias("pos"), F.col("text").alias("snippet"))


def span_theta_join(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code")
    return spans.join_comments(pairs.file_spans(t, "comments"), pairs.file_spans(t, "snippets"))


def mined_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.accepted(pairs.mine_pairs(_table(spark, d, "parse_source_code"), strict=False))
    return p.select("file_id", "lang", "comment_id", "snippet_id", "query")


def mined_snippets(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.accepted(pairs.mine_pairs(_table(spark, d, "parse_source_code"), strict=False))
    return p.select("file_id", "comment_id", "snippet_id", "snippet", "scope")


def unique_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code")
    p = pairs.accepted(pairs.mine_pairs(t, strict=False))
    sources = t.filter(T.extension(F.col("path")).isin(".c", ".cpp"))
    f = pairs.file_slices(sources).filter("type = 'function_definition'").join(t.select("file_id", "repo_name"), "file_id")
    bodies = f.select("repo_name", F.col("identifier").alias("name"), F.struct("file_id", "pos").alias("place"), F.col("text").alias("snippet"), F.col("id").alias("snippet_id"))
    return pairs.resolve_headers(p, bodies).select("file_id", "comment_id", "snippet_id", "identifier")


def header_name_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "parse_source_code")
    f = pairs.file_spans(t, "snippets").join(t.select("file_id", "repo_name", "path"), "file_id").filter(T.extension(F.col("path")).isin(".h", ".hpp"))
    return f.groupBy("repo_name", "identifier").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")


def parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.parse import parse_files

    p = parse_files(_table(spark, d, "parse_source_code"))
    return p.select("file_id", "status", F.size("snippets").cast("long").alias("n_snippets"), F.size("comments").cast("long").alias("n_comments"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPLIT = r"string_split_regex({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _sql_lines(c: str) -> str:
    s = _SPLIT.format(c)
    return f"(CASE WHEN list_last({s}) = '' THEN list_slice({s}, 1, len({s}) - 1) ELSE {s} END)"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_any(c: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


_KNOWN = {"C": ".c .h", "C#": ".cs", "C++": ".cpp .h .hpp", "CSS": ".css", "Go": ".go", "Java": ".java", "JavaScript": ".js .jsx", "Julia": ".jl", "Lua": ".lua", "PHP": ".php", "Python": ".py", "R": ".R .r", "Ruby": ".rb", "Rust": ".rs", "Scala": ".scala", "TypeScript": ".ts .tsx"}
_EXT = r"regexp_extract(list_last(string_split(path, '/')), '(?s)^\.*[^.].*?(\.[^.]*)$', 1)"
_KNOWN_SQL = " OR ".join(f"(language = '{k}' AND {_EXT} IN ({', '.join(repr(x) for x in v.split())}))" for k, v in _KNOWN.items())
_ASCII = " || ".join(f"chr({c})" for c in (32, 9, 10, 13, 11, 12))
_LINES = "SELECT file_id, language, u.row - 1 AS row, u.line FROM (SELECT file_id, language, unnest(list_zip(range(1, len(l) + 1), l)) AS z, z[1] AS row, z[2] AS line FROM (SELECT file_id, language, string_split(content, chr(10)) AS l FROM parse_source_code WHERE content IS NOT NULL AND language IS NOT NULL)) u"
_BLOCKS = r"SELECT file_id, z[1] - 1 AS n, z[2] AS block FROM (SELECT file_id, unnest(list_zip(range(1, len(l) + 1), l)) AS z FROM (SELECT file_id, regexp_extract_all(content, '/\*[^*]*\*+(?:[^/*][^*]*\*+)*/') AS l FROM parse_source_code WHERE content IS NOT NULL))"
_CLEAN_BLOCK = "array_to_string(list_filter(list_transform(" + _sql_lines("block") + f", lambda x: trim(x, '/*' || {_ASCII})), lambda x: x <> ''), chr(10))"
_STRIPPED = f"list_transform({_sql_lines('text')}, lambda x: {_sql_strip('x')})"

_GROUPS = """c AS (SELECT file_id, content, x.id AS id, x.is_multi_line AS many, x.start_byte AS a, x.end_byte AS b, x.start_point[1] AS sr, x.start_point[2] AS sc, x.end_point[1] AS er FROM (SELECT file_id, content, unnest(comments) AS x FROM parse_source_code WHERE content IS NOT NULL)),
l AS (SELECT *, regexp_matches(coalesce(try(decode(encode(content)[a - sc + 1:a])), 'x'), '^\\s*$') AS s FROM c WHERE NOT many),
i AS (SELECT *, sum(g) OVER (PARTITION BY file_id ORDER BY a, id) AS island FROM (SELECT *, CASE WHEN s AND lag(s) OVER w AND sr - lag(sr) OVER w = 1 THEN 0 ELSE 1 END AS g FROM l WINDOW w AS (PARTITION BY file_id ORDER BY a, id))),
g AS (SELECT file_id, id, a, b, sr, er, true AS many FROM c WHERE many UNION ALL SELECT file_id, arg_min(id, (a, id)), min(a), arg_max(b, (a, id)), arg_min(sr, (a, id)), arg_max(er, (a, id)), false FROM i GROUP BY file_id, island)"""
_UNMARKED = "CASE WHEN lang IN ('Python', 'Julia', 'Ruby', 'R') THEN ltrim(x, '#' || {0}) WHEN lang = 'Lua' THEN ltrim(x, '-' || {0}) ELSE ltrim(x, '/' || {0}) END".format(_ASCII)
_CLEANED = f"""CASE WHEN NOT many THEN array_to_string(list_transform({_sql_lines('raw')}, lambda x: {_UNMARKED}), chr(10)) WHEN lang = 'Python' THEN trim(raw, '"' || chr(39) || {_ASCII}) WHEN lang = 'Lua' THEN rtrim(ltrim(raw, '-[' || {_ASCII}), '-]' || {_ASCII})
WHEN lang = 'Ruby' THEN CASE WHEN starts_with(raw, '=begin') AND ends_with(raw, '=end') THEN {_sql_strip('substr(raw, 7, greatest(length(raw) - 10, 0))')} ELSE raw END ELSE {_CLEAN_BLOCK.replace('block', 'raw')} END"""
_BRIEF = f"CASE WHEN starts_with(c, '@brief') THEN ltrim(substr(c, 7), {_ASCII}) WHEN starts_with(c, '\\brief') THEN ltrim(substr(c, 7), {_ASCII}) WHEN starts_with(c, '!' || chr(10) || '\\brief') THEN ltrim(substr(c, 9), {_ASCII}) ELSE c END"
_SKIPPED = f"""list_filter(CASE WHEN e > 0 THEN list_slice(l, 1, e - 1) ELSE l END, lambda x: x <> '' AND NOT (contains(lower(x), ident) OR {_sql_any('lower(x)', T.SKIP_PREFIXES)} OR (starts_with(lower(x), '@') AND NOT starts_with(lower(x), '@brief')) OR ends_with(list_first(string_split_regex(lower(x), '\\s+')), ':')))"""


def _sql_stop(stops: tuple[str, ...]) -> str:
    at = f"coalesce(list_position(list_transform(l, lambda x: {_sql_any('lower(x)', stops)}), true), 0)"
    return f"list_filter(CASE WHEN {at} > 0 THEN list_slice(l, 1, {at} - 1) ELSE l END, lambda x: x <> '')"


_MINED = f"""WITH {_GROUPS}, f AS (SELECT file_id, language AS lang, content, x.id AS fid, x.start_byte AS fa, x.end_byte AS fb, x.start_point[1] AS fr, x.identifier AS ident FROM (SELECT file_id, language, content, unnest(snippets) AS x FROM parse_source_code WHERE content IS NOT NULL AND language IN ({', '.join(repr(x) for x in T.PAIR_LANGUAGES)})) WHERE starts_with(x.type, 'function') OR starts_with(x.type, 'method')),
h AS (SELECT DISTINCT f.file_id, f.lang, g.id AS cid, f.fid, f.ident, g.many, try(decode(encode(f.content)[g.a + 1:g.b])) AS raw FROM g JOIN f ON g.file_id = f.file_id AND (f.fr - g.er = 1 OR (f.fa <= g.a AND g.b <= f.fb AND g.sr - f.fr BETWEEN 0 AND 3))),
b AS (SELECT file_id, lang, cid, fid, ident, {_BRIEF} AS t FROM (SELECT *, {_CLEANED} AS c FROM h)),
n AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: starts_with(lower(x), '-') AND contains(lower(x), 'example')), true), 0) AS e FROM (SELECT *, list_transform({_sql_lines('t')}, lambda x: {_sql_strip('x')}) AS l FROM b)),
q AS (SELECT file_id, lang, cid, fid, array_to_string(CASE WHEN lang = 'Python' THEN {_sql_stop(T.PYTHON_STOPS)} WHEN lang = 'Go' THEN {_sql_stop(T.GO_STOPS)} ELSE {_SKIPPED} END, chr(10)) AS query FROM n)
SELECT file_id, lang, cid AS comment_id, fid AS snippet_id, query FROM q WHERE query <> ''"""

_RESOLVED = f"""WITH m AS (SELECT * FROM ({_MINED})), s AS (SELECT file_id, repo_name, path, language, i - 1 AS pos, snippets[i].id AS id, snippets[i].identifier AS ident, snippets[i].type AS kind FROM (SELECT *, unnest(range(1, len(snippets) + 1)) AS i FROM parse_source_code)),
p AS (SELECT m.*, s.repo_name, s.ident, {_EXT.replace('path', 's.path')} IN ('.h', '.hpp') AND s.language IN ('C', 'C++') AS head FROM m JOIN s ON s.file_id = m.file_id AND s.id = m.snippet_id),
one AS (SELECT repo_name, ident FROM p WHERE head GROUP BY repo_name, ident HAVING count(DISTINCT snippet_id) = 1),
body AS (SELECT repo_name, ident, arg_max(id, (file_id, pos)) AS id FROM s WHERE kind = 'function_definition' AND {_EXT} IN ('.c', '.cpp') GROUP BY repo_name, ident)
SELECT file_id, comment_id, snippet_id, ident AS identifier FROM p WHERE NOT head UNION ALL SELECT p.file_id, p.comment_id, body.id, p.ident FROM p JOIN one USING (repo_name, ident) JOIN body USING (repo_name, ident) WHERE head"""

ORACLES = {
    "unique_name_resolution": _RESOLVED,
    "byte_slice": "SELECT file_id, CAST(i - 1 AS BIGINT) AS pos, try(decode(encode(content)[snippets[i].start_byte + 1:snippets[i].end_byte])) AS snippet FROM (SELECT *, unnest(range(1, len(snippets) + 1)) AS i FROM parse_source_code WHERE content IS NOT NULL)",
    "comment_group_spans": f"WITH {_GROUPS} SELECT file_id, CAST(a AS BIGINT) AS start_byte, CAST(b AS BIGINT) AS end_byte, many FROM g",
    "mined_pairs": _MINED,
    "file_gate_status": f"SELECT file_id, CASE WHEN NOT coalesce({_KNOWN_SQL}, false) THEN 'not_implemented' WHEN length_bytes > 8000 THEN 'too_long_file' WHEN num_lines > 250 THEN 'too_many_rows' WHEN max_line_length > 140 THEN 'too_long_line' WHEN coalesce(lower(src_encoding), '') <> 'utf-8' THEN 'bad_encoding' ELSE 'success' END AS status FROM parse_source_code",
    "file_text_sizes": "SELECT file_id, CAST(octet_length(encode(content)) AS BIGINT) AS length_bytes, CAST(len(string_split(content, chr(10))) AS BIGINT) AS num_lines, CAST(list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) AS BIGINT) AS max_line_length FROM parse_source_code WHERE content IS NOT NULL",
    "file_stats_describe": "SELECT language, CAST(min(num_lines) AS DOUBLE) AS stat_min, CAST(max(num_lines) AS DOUBLE) AS stat_max, round(avg(num_lines), 6) AS stat_mean, " + ", ".join(f"round(quantile_cont(num_lines, {q}), 6) AS p{str(q)[2:].ljust(2, '0')}" for q in evaluate.QUANTILES) + " FROM parse_source_code WHERE language IS NOT NULL GROUP BY language",
    "path_extension": f"SELECT file_id, {_EXT} AS ext FROM parse_source_code",
    "clean_single_line": f"SELECT file_id, row, CASE WHEN language IN ('Python', 'Julia', 'Ruby', 'R') THEN ltrim(line, '#' || {_ASCII}) WHEN language = 'Lua' THEN ltrim(line, '-' || {_ASCII}) ELSE ltrim(line, '/' || {_ASCII}) END AS cleaned FROM ({_LINES}) WHERE regexp_matches(line, '^\\s*(#|//|--)')",
    "clean_multi_line": f"SELECT file_id, n, {_CLEAN_BLOCK} AS cleaned FROM ({_BLOCKS})",
    "clean_brief": f"SELECT file_id, n, CASE WHEN starts_with(c, '@brief') THEN ltrim(substr(c, 7), {_ASCII}) WHEN starts_with(c, '\\brief') THEN ltrim(substr(c, 7), {_ASCII}) WHEN starts_with(c, '!' || chr(10) || '\\brief') THEN ltrim(substr(c, 9), {_ASCII}) ELSE c END AS cleaned FROM (SELECT file_id, n, {_CLEAN_BLOCK} AS c FROM ({_BLOCKS}))",
    "comment_to_query_skip": f"""SELECT doc_id, array_to_string(list_filter(l2, lambda x: x <> '' AND NOT (contains(lower(x), 'voucher') OR {_sql_any('lower(x)', T.SKIP_PREFIXES)} OR (starts_with(lower(x), '@') AND NOT starts_with(lower(x), '@brief')) OR ends_with(list_first(string_split_regex(lower(x), '\\s+')), ':'))), chr(10)) AS q
FROM (SELECT doc_id, CASE WHEN pos > 0 THEN list_slice(l, 1, pos - 1) ELSE l END AS l2 FROM (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: starts_with(lower(x), '-') AND contains(lower(x), 'example')), true), 0) AS pos FROM (SELECT doc_id, {_STRIPPED} AS l FROM documents WHERE text IS NOT NULL)))""",
    "comment_to_query_break": f"""SELECT doc_id, array_to_string(list_filter(CASE WHEN pos > 0 THEN list_slice(l, 1, pos - 1) ELSE l END, lambda x: x <> ''), chr(10)) AS q
FROM (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: {_sql_any('lower(x)', T.PYTHON_STOPS)}), true), 0) AS pos FROM (SELECT doc_id, {_STRIPPED} AS l FROM documents WHERE text IS NOT NULL))""",
    "comment_to_query_summary": f"SELECT doc_id, {_sql_strip('t')} AS q FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND NOT contains(text, '</summary>') THEN 'x <summary> ' || text ELSE split_part(' ' || text || ' </summary> rest', '</summary>', 1) END AS t FROM documents WHERE text IS NOT NULL)",
    "group_lines_islands": f"""SELECT file_id, min(row) AS first_row, max(row) AS last_row, count(*) AS n FROM (SELECT file_id, row, sum(b) OVER (PARTITION BY file_id ORDER BY row) AS g FROM (SELECT file_id, row, CASE WHEN s AND lag(s) OVER w AND row - lag(row) OVER w = 1 THEN 0 ELSE 1 END AS b FROM (SELECT file_id, row, regexp_matches(line, '^[ \\t]') AS s FROM ({_LINES}) WHERE regexp_matches(line, '^[ \\t]*(#|//|--)')) WINDOW w AS (PARTITION BY file_id ORDER BY row))) GROUP BY file_id, g""",
    "span_theta_join": """WITH c AS (SELECT file_id, unnest(comments) AS x FROM parse_source_code), f AS (SELECT file_id, unnest(snippets) AS x FROM parse_source_code)
SELECT DISTINCT c.file_id, c.x.id AS comment_id, f.x.id AS function_id FROM c JOIN f ON c.file_id = f.file_id AND (f.x.start_point[1] - c.x.end_point[1] = 1 OR (f.x.start_byte <= c.x.start_byte AND c.x.end_byte <= f.x.end_byte AND c.x.start_point[1] - f.x.start_point[1] BETWEEN 0 AND 3))""",
    "strip_spans": """WITH c AS (SELECT file_id, x.start_byte AS a, x.end_byte AS b FROM (SELECT file_id, unnest(comments) AS x FROM parse_source_code WHERE content IS NOT NULL)), m AS (SELECT file_id, a, b, max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT p.file_id, CAST(octet_length(encode(p.content)) - coalesce(s.n, 0) AS BIGINT) AS bytes_left FROM parse_source_code p LEFT JOIN (SELECT m.file_id, sum(greatest(0, least(b, n) - least(greatest(a, coalesce(before, 0)), n))) AS n FROM m JOIN (SELECT file_id, octet_length(encode(content)) AS n FROM parse_source_code) USING (file_id) GROUP BY m.file_id) s ON p.file_id = s.file_id WHERE p.content IS NOT NULL""",
    "header_name_counts": f"SELECT repo_name, identifier, count(*) AS n FROM (SELECT repo_name, x.identifier AS identifier FROM (SELECT repo_name, unnest(snippets) AS x FROM parse_source_code WHERE {_EXT} IN ('.h', '.hpp'))) GROUP BY repo_name, identifier HAVING count(*) = 1",
}
QUERIES = {f.__name__: f for f in (file_gate_status, file_text_sizes, file_stats_describe, path_extension, clean_single_line, clean_multi_line, clean_brief, comment_to_query_skip, comment_to_query_break, comment_to_query_summary, group_lines_islands, comment_group_spans, strip_spans, byte_slice, span_theta_join, mined_pairs, mined_snippets, unique_name_resolution, header_name_counts, parsed_functions)}
