"""Sinks (K*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.feedback import review_rows


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_review_csv(bad: DataFrame, path: str, key: str = "eval_id") -> None:
    """The human-review sheet: eight columns with a header, quotes doubled."""
    review_rows(bad, key).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_eval_log(log: DataFrame, path: str) -> None:
    """The log by run, and its bad rows again beside it."""
    log.write.mode("append").partitionBy("run_id").json(f"{path}/eval_log")
    log.filter("is_bad_response").write.mode("append").partitionBy("run_id").json(f"{path}/bad_responses")


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def overwrite_kb_empty(like: DataFrame, path: str) -> None:
    """Clear a knowledge base, keeping its schema."""
    like.limit(0).write.mode("overwrite").parquet(path)


def write_messages_jsonl(df: DataFrame, path: str) -> None:
    """{"messages": [...]} a line."""
    df.select("messages").write.json(path)


def write_instruction_json(df: DataFrame, path: str, rows_a_file: int = 10_000) -> None:
    """Files that each hold one JSON array of at most ``rows_a_file`` rows, in folders by number. Rows are numbered within their partition, so
    an array's rows are few and stand together."""
    row = F.struct("instruction", "input", "output").alias("row")
    at = F.monotonically_increasing_id()
    numbered = df.select(row, at.alias("at")).withColumn("file", F.concat_ws("-", F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND(2**33 - 1) / rows_a_file)))
    arrays = numbered.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]).alias("rows"))
    arrays.select("file", F.to_json("rows").alias("value")).write.partitionBy("file").text(path)


def append_reasoning_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """A table's next version in a folder of its own; readers take the greatest."""
    at = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(at)
    return at


def with_eval_ids(log: DataFrame, run_id: str, at) -> DataFrame:
    """Stamps a run's rows: eval_id, run_id, timestamp_utc; latencies rounded to 4 places."""
    out = log.withColumn("eval_id", F.expr("uuid()")).withColumn("run_id", F.lit(run_id)).withColumn("timestamp_utc", at)
    return out.withColumns({c: F.round(F.col(c), 4) for c in ("ttft_seconds", "total_time_seconds") if c in out.columns})
