"""Structured Streaming forms of the stateful operators (Z*). Each takes a streaming DataFrame and returns one, or runs a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules, text as X
from ..operators import corpus, feedback, memory, responses, scoring


def assemble_responses(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """conv_id, response, n_chunks, ttft_seconds, total_seconds from chunks (conv_id, seq, content, ts, started_at). The watermark stands on the
    response's start: its state goes, and chunks of it are late, once others have started ``late`` after it."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "content")))
    out = chunks.withWatermark("started_at", late).groupBy("conv_id", "started_at").agg(rows.alias("c"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    secs = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6
    return out.select("conv_id", F.array_join(F.transform("c", lambda x: x["content"]), "").alias("response"), F.size("c").alias("n_chunks"), secs("started_at", "first").alias("ttft_seconds"), secs("started_at", "last").alias("total_seconds"))


def net_scores(votes: DataFrame) -> DataFrame:
    """Running net score of each turn; update or complete mode."""
    return votes.groupBy("conv_id", "turn").agg(F.sum("vote").alias("net"))


def session_activity(events: DataFrame, gap: str = "1 hour", late: str = "1 day", by: str = "user_id") -> DataFrame:
    """by, started_at, ends_at, n_events of sessions that end after ``gap`` without an event. An event is late when it lies ``gap`` and ``late`` or more behind
    the newest (by the watermark, in whole milliseconds). Until then it may join a session that has ended, so a session is given out, once and whole, when
    its end lies that far behind. Counts by (key, time) come first: they drop late events by their own times and hand on the others in order of time."""
    counts = events.filter("ts is not null").withWatermark("ts", f"{late} {gap}").groupBy(by, "ts").agg(F.count("*").alias("n"))
    out = counts.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.sum("n").alias("n_events"))
    return out.select(by, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "n_events")


def windowed_votes(votes: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window start, up, down over tumbling or sliding windows; later rows than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = votes.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count_if(F.col("vote") == 1).alias("up"), F.count_if(F.col("vote") == -1).alias("down"))
    return out.select(F.col("w.start").alias("window_start"), "up", "down")


def scores(turns: DataFrame) -> DataFrame:
    """Each answered turn (prompt, response) scored and flagged on arrival; no state."""
    return scoring.flag_bad(scoring.evaluate_responses(turns))


def audit(turns: DataFrame) -> DataFrame:
    """Per request (conv_id, turn, prompt, response): intent, issues, whether the response was refined."""
    out = scoring.classify_intent(turns, "prompt")
    return responses.refine(scoring.validate_response(out)).select("conv_id", "turn", "category", "issues", "was_refined")


def with_lines_and_facts(messages: DataFrame) -> DataFrame:
    """What ``session_memory`` reads: the summary line and the facts of each message (conv_id, turn, role, text, ts), by the batch rules."""

    def finds(name: str, pattern: str):
        return F.transform(F.regexp_extract_all(X.nz(F.col("text")), F.lit(pattern), F.lit(1)), lambda v: F.concat(F.lit(name + "\t"), X.strip(v)))

    found = F.flatten(F.array(*(finds(name, p) for name, p in rules.KEY_INFO)))
    fine = lambda v: (F.length(F.substring_index(v, "\t", -1)) > 0) & (F.length(F.substring_index(v, "\t", -1)) < 100)
    facts = F.when(F.col("role") == "user", F.filter(found, fine)).otherwise(F.array().cast("array<string>"))
    return messages.select("conv_id", "turn", "role", "ts", memory.turn_line(F.col("role"), F.col("text")).alias("line"), facts.alias("facts"))


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes changed rows to a folder of their batch's number (a repeated batch overwrites itself)."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The latest row of each key that ``upsert_sink`` or ``collect_batches`` wrote."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*key, "r.*")


def failed_queue(downvoted: DataFrame, scored: DataFrame) -> DataFrame:
    """The queue of ``feedback.failed_queue`` from its down-voted rows (``keyed.downvoted``, the latest of each key): automatic rows, and user rows of
    prompts that have none, with the scores of their turns."""
    auto = feedback.enqueue_auto(scored).withColumn("vote_id", F.lit(None).cast("long"))
    fresh = downvoted.join(auto.select("conv_id", "prompt").distinct(), ["conv_id", "prompt"], "left_anti")
    user = feedback.attach_scores_to_votes(fresh, scored)
    why = F.array_append("failure_reasons", F.lit(rules.USER_REASON))
    user = user.select("conv_id", "turn", "prompt", "response", "composite_score", "grade", why.alias("failure_reasons"), F.lit("user").alias("source"), "resolved", "vote_id")
    return auto.unionByName(user)


def document_key() -> Column:
    """A document's identity in the manifest: its source, id and text."""
    part = lambda c: F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-"))
    return F.sha2(F.concat(part("source"), part("doc_id"), part("text")), 256)


def ingest_sink(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that chunks the documents that the manifest under ``path`` doesn't hold, then adds them to it. A document is its
    source, id and text: a known source may bring new documents, and one that comes again, in the same batch or later, is left out. A
    repeated batch overwrites what it wrote."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            manifest = spark.read.schema("document string, source string, batch long").parquet(f"{path}/manifest").filter(F.col("batch") != number).select("document")
        except AnalysisException as e:  # the first batch finds no manifest
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            manifest = spark.createDataFrame([], "document string")
        keyed = batch.withColumn("document", document_key())
        keyed = keyed.join(manifest, "document", "left_anti").dropDuplicates(["document"]).persist()
        try:
            corpus.ingest(keyed.drop("document"), **options).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
            keyed.select("document", "source").write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
        finally:
            keyed.unpersist()

    return apply


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available as Parquet and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()


def collect_batches(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """As ``run_to_end`` for update and complete mode: batch n's rows in the folder batch=n, so the latest row of a key is that of the
    greatest n."""
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_of(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)
