"""Sources (S*): folders of text, Markdown, JSON, JSON Lines and logs as DataFrames of documents or records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.corpus import extract_json_text

TEXT_KEYS = ["text", "content", "body", "answer", "question", "description"]
#: suffix → kind of document
SUFFIXES = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "json": "json", "jsonl": "jsonl", "html": "html", "htm": "html"}

EVAL_LOG = (
    "eval_id string, run_id string, timestamp_utc string, session_id string, model_name string, prompt string, response string, expected_keywords array<string>, "
    "scores struct<accuracy:double,relevance:double,coherence:double>, composite_score double, grade string, grade_label string, is_bad_response boolean, retrain_candidate boolean, "
    "failure_reasons array<string>, ttft_seconds double, total_time_seconds double, human_review_notes string"
)
EVAL_CASE = "id string, category string, difficulty string, prompt string, expected_keywords array<string>"


def _whole(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    df = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, recursiveFileLookup=recursive)
    return df.select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def _stamped(df: DataFrame, fmt: str) -> DataFrame:
    return df.select("source", "text", F.create_map(F.lit("format"), F.lit(fmt), F.lit("file_path"), F.col("file_path")).alias("metadata"))


def read_text_docs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """source (file name), text, metadata; one row a file."""
    return _stamped(_whole(spark, path, recursive), "text")


def read_markdown_docs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return _stamped(_whole(spark, path, recursive).withColumn("text", X.strip_markdown(F.col("text"))), "markdown")


def read_json_docs(spark: SparkSession, path: str, keys: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """The texts under ``keys`` of one JSON value a file; files that aren't JSON are skipped."""
    df = extract_json_text(_whole(spark, path, recursive), keys or TEXT_KEYS).filter("json_text is not null")
    return _stamped(df.withColumn("text", F.col("json_text")), "json")


def read_jsonl_docs(spark: SparkSession, path: str, keys: list[str] | None = None, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """One document a file: the texts of its lines in order; blank and malformed lines are skipped. Files are read by lines and split like
    any large file; only a file's texts are joined."""
    reader = spark.read.option("ignoreCorruptFiles", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = reader.text(path, recursiveFileLookup=recursive).select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("file_path"), pos.alias("pos"), F.col("value").alias("text"))
    texts = extract_json_text(lines.filter(~X.blank(F.col("text"))), keys or TEXT_KEYS).filter("json_text is not null")
    rows = texts.groupBy("source", "file_path").agg(F.array_sort(F.collect_list(F.struct("pos", "json_text"))).alias("r"))
    return _stamped(rows.withColumn("text", F.array_join(F.transform("r", lambda x: x["json_text"]), "\n")), "jsonl")


def read_corpus_dir(spark: SparkSession, path: str, extensions: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """All files of known suffixes (in any case) under ``path``; corrupt ones are skipped. One scan of whole files, and one of the lines of
    JSON Lines files."""
    suffix = F.lower(F.substring_index("source", ".", -1))
    wanted = {s: k for s, k in SUFFIXES.items() if not extensions or s in {e.lower().lstrip(".") for e in extensions}}
    kinds = F.create_map(*(F.lit(x) for kv in (wanted or {"": ""}).items() for x in kv))
    reader = spark.read.option("ignoreCorruptFiles", True)
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in s) for s, k in wanted.items() if k != "jsonl")
    files = reader.option("pathGlobFilter", f"*.{{{either}}}").text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")).withColumn("kind", kinds[suffix])
    files = extract_json_text(files, keys or TEXT_KEYS)
    text = F.when(F.col("kind") == "markdown", X.strip_markdown(F.col("text"))).when(F.col("kind") == "html", X.html_main_text(F.col("text")))
    text = text.when(F.col("kind") == "json", F.col("json_text")).otherwise(F.col("text"))
    meta = F.create_map(F.lit("format"), F.col("kind"), F.lit("file_path"), F.col("file_path")).alias("metadata")
    whole = files.select("source", text.alias("text"), meta, "kind").filter("kind is not null and text is not null").drop("kind")
    return whole.unionByName(read_jsonl_docs(spark, path, keys, glob="*.[jJ][sS][oO][nN][lL]")) if "jsonl" in wanted else whole


def read_html_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages that a table holds already: source is the URL."""
    return df.select(F.col(url).alias("source"), X.html_main_text(F.col(html)).alias("text"), F.create_map(F.lit("format"), F.lit("html"), F.lit("url"), F.col(url)).alias("metadata"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of cases, or an object that holds one under test_cases; anything else is an error."""
    df = spark.read.option("multiLine", True).json(path)
    if "test_cases" in df.columns:
        df = df.select(F.inline("test_cases"))
    if "prompt" not in df.columns:
        raise ValueError("neither a list of cases nor an object with test_cases")
    return df


def read_eval_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Log records; malformed lines are skipped. Laid out by run_id, only that run's files are read."""
    df = spark.read.schema(EVAL_LOG).option("mode", "DROPMALFORMED").json(path)
    return df if run_id is None else df.filter(F.col("run_id") == run_id)


def read_scenario_results(spark: SparkSession, path: str) -> DataFrame:
    """scenario, turn, user, bot of a file that maps scenarios to turns."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,array<struct<turn:int,user:string,bot:string>>>").alias("m"))
    return parsed.select(F.explode("m").alias("scenario", "turns")).select("scenario", F.inline("turns"))


def read_instruction_rows(df: DataFrame, instruction: str = "instruction", context: str = "context", response: str = "response") -> DataFrame:
    """instruction, context, response of any table, cleaned."""
    clean = lambda c: X.clean_instruction(F.col(c))
    return df.select(clean(instruction).alias("instruction"), clean(context).alias("context"), clean(response).alias("response"))


def read_chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of server-sent events as a stream."""
    return spark.readStream.text(path).select(F.col("value").alias("line"))
