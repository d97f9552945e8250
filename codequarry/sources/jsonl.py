"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTS = "start_byte INT, end_byte INT, start_point ARRAY<INT>, end_point ARRAY<INT>"
SNIPPET = "STRUCT<id STRING, scope STRING, type STRING, identifier STRING, start_byte INT, end_byte INT, start_point ARRAY<INT>, end_point ARRAY<INT>>"
COMMENT = "STRUCT<id STRING, is_multi_line BOOLEAN, start_byte INT, end_byte INT, start_point ARRAY<INT>, end_point ARRAY<INT>>"
FILE = "path STRING, language STRING, content STRING, length_bytes BIGINT, num_lines BIGINT, max_line_length BIGINT, src_encoding STRING"
REPO = f"repo_name STRING, files ARRAY<STRUCT<{FILE}>>"
PARSED_REPO = f"repo_name STRING, files ARRAY<STRUCT<{FILE}, status STRING, snippets ARRAY<{SNIPPET}>, comments ARRAY<{COMMENT}>>>"


def expand(spark: SparkSession, masks: str) -> list[str]:
    """The paths that comma-separated masks match, sorted, on whatever file system they name; a mask that matches nothing is an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for mask in filter(None, (x.strip() for x in masks.split(","))):
        path = jvm.org.apache.hadoop.fs.Path(mask)
        found = path.getFileSystem(conf).globStatus(path)
        if not found:
            raise FileNotFoundError(mask)
        out += sorted(str(x.getPath()) for x in found)
    return out


def read_jsonl(spark: SparkSession, masks: str, schema: str, keep_corrupt: bool = False) -> DataFrame:
    """The rows of all files that the masks match. A line that is no JSON of the schema ends the job with an error; with keep_corrupt, it's kept in _corrupt_record."""
    if not keep_corrupt:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(expand(spark, masks))
    return spark.read.schema(schema + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(expand(spark, masks))


def corrupt_lines(spark: SparkSession, masks: str, schema: str) -> DataFrame:
    """(path, line) of each line that is no JSON of the schema."""
    lines = spark.read.text(expand(spark, masks)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    read = F.from_json("line", schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter((F.trim("line") != "") & read["_corrupt_record"].isNotNull())


def read_repos(spark: SparkSession, masks: str, parsed: bool = False) -> DataFrame:
    """One row a file: (repo_name, file_pos, the file's fields, file_id), the id a hash of repository, path and place.

    A line that is no JSON gives no file; how many there are is told to listeners as the observed metric ``corrupt_lines``, and corrupt_lines() gives them.
    """
    repos = read_jsonl(spark, masks, PARSED_REPO if parsed else REPO, keep_corrupt=True).observe("read_repos", F.count("_corrupt_record").alias("corrupt_lines"))
    flat = repos.select("repo_name", F.posexplode("files").alias("file_pos", "_f")).select("repo_name", "file_pos", "_f.*")
    return flat.withColumn("file_id", F.sha2(F.concat_ws("\0", "repo_name", "path", F.col("file_pos").cast("string")), 256))


def nest_repos(files: DataFrame) -> DataFrame:
    """The files of each repository as one row again, in their order."""
    fields = [c for c in files.columns if c not in ("repo_name", "file_pos", "file_id")]
    rows = files.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("file_pos", F.struct(*fields).alias("f")))).alias("_f"))
    return rows.select("repo_name", F.transform("_f", lambda x: x["f"]).alias("files"))


def write_jsonl(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Write JSON lines into a new folder; one that exists is an error. limit: so many rows over all parts."""
    (df.limit(limit) if limit is not None else df).write.mode("errorifexists").json(path)


def replace_jsonl(spark: SparkSession, path: str, change, schema: str) -> None:
    """Read a folder of JSON lines, change its rows, and put the result in its place: written beside it first, then swapped.

    The old folder is moved aside and deleted only once the new one stands in its place; what goes wrong before leaves it, or puts it back.
    """
    beside, aside = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    change(read_jsonl(spark, path, schema)).write.mode("overwrite").json(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new, away = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, beside, aside))
    fs = old.getFileSystem(conf)
    if fs.exists(away):
        raise FileExistsError(aside)
    if not fs.rename(old, away):
        raise OSError(f"{path} can't be moved to {aside}")
    if not fs.rename(new, old):
        fs.rename(away, old)
        raise OSError(f"{beside} can't be moved to {path}")
    fs.delete(away, True)


def write_predictions(top, queries, path: str) -> None:
    """Nested predictions: one line a query, with its candidates in the order of their ranks. top: (query, rank, id, text, score); queries: (query, question, label, lang)."""
    write_jsonl(nest_candidates(top, queries).drop("query"), path)


def nest_candidates(top: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, question, label, lang, candidates); queries without candidates have an empty list."""
    kind = dict(top.dtypes)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", "score"))).alias("_c"))
    kept = F.transform("_c", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["score"].alias("score")))
    empty = F.array().cast(f"array<struct<id:{kind['id']},text:{kind['text']},score:{kind['score']}>>")
    return queries.join(lists, "query", "left").select("query", "question", "label", "lang", F.coalesce(kept, empty).alias("candidates"))
