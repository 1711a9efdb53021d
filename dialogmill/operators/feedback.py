"""Votes, the failed-response queue and dashboards (F*, J3-J7), preference pairs and retraining runs (P*)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, text as X
from .memory import pair_turns
from .scoring import evaluate_responses, flag_bad


def valid_votes(votes: DataFrame) -> DataFrame:
    return votes.filter(F.col("vote").isin(1, -1))


def rejected_votes(votes: DataFrame) -> DataFrame:
    return votes.filter(F.coalesce(~F.col("vote").isin(1, -1), F.lit(True)))


def net_score(votes: DataFrame) -> DataFrame:
    return votes.groupBy("conv_id", "turn").agg(F.sum("vote").alias("net"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x.cast("double")))


def feedback_score(votes: DataFrame) -> DataFrame:
    return net_score(votes).withColumn("feedback_score", F.round(sigmoid(F.col("net")), 4))


def vote_labels(votes: DataFrame) -> DataFrame:
    return votes.withColumn("label", F.when(F.col("vote") == 1, "thumbs_up").when(F.col("vote") == -1, "thumbs_down"))


def promote_by_net(votes: DataFrame, threshold: int = -2) -> DataFrame:
    return net_score(votes).filter(F.col("net") <= threshold)


def recent_votes(votes: DataFrame, limit: int, vote: int | None = None) -> DataFrame:
    return (votes if vote is None else votes.filter(F.col("vote") == vote)).orderBy(F.desc("vote_id")).limit(limit)


def enrich_feedback_score(votes: DataFrame) -> DataFrame:
    """Each vote with its turn's net score and sigmoid: aggregate, then join."""
    return votes.join(feedback_score(votes), ["conv_id", "turn"])


def log_turns(conv: DataFrame) -> DataFrame:
    """Assistant turns with prompts, scored and flagged."""
    return flag_bad(evaluate_responses(pair_turns(conv)))


def enqueue_auto(scored: DataFrame) -> DataFrame:
    """Queue rows of bad turns."""
    return scored.filter("is_bad_response").select("conv_id", "turn", "prompt", "response", "composite_score", "grade", "failure_reasons", F.lit("auto").alias("source"), F.lit(False).alias("resolved"))


def new_downvotes(votes: DataFrame, failed: DataFrame) -> DataFrame:
    """The first down-vote of each (conv_id, prompt) that the queue doesn't hold, whatever its source or state."""
    first = votes.filter("vote = -1").groupBy("conv_id", "prompt").agg(F.min(F.struct("vote_id", "turn", "response")).alias("f"))
    return first.select("conv_id", "prompt", "f.*").join(failed.select("conv_id", "prompt").distinct(), ["conv_id", "prompt"], "left_anti")


def attach_scores_to_votes(votes: DataFrame, scored: DataFrame) -> DataFrame:
    """Score, grade and reasons of the turn voted on; null, "?" and none if there is no such turn."""
    own = scored.select("conv_id", "turn", "composite_score", "grade", "failure_reasons")
    out = votes.join(own, ["conv_id", "turn"], "left")
    return out.withColumn("grade", F.coalesce("grade", F.lit("?"))).withColumn("failure_reasons", F.coalesce("failure_reasons", F.array().cast("array<string>")))


def enqueue_user(votes: DataFrame, scored: DataFrame, failed: DataFrame) -> DataFrame:
    out = attach_scores_to_votes(new_downvotes(votes, failed), scored)
    why = F.array_append("failure_reasons", F.lit(rules.USER_REASON))
    return out.select("conv_id", "turn", "prompt", "response", "composite_score", "grade", why.alias("failure_reasons"), F.lit("user").alias("source"), F.lit(False).alias("resolved"), "vote_id")


def recoveries(votes: DataFrame) -> DataFrame:
    """conv_id, vote_id of up-votes at which the turn's running net is above 0."""
    w = Window.partitionBy("conv_id", "turn").orderBy("vote_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return votes.withColumn("running", F.sum("vote").over(w)).filter("vote = 1 and running > 0").select("conv_id", "vote_id")


def resolve_recovered(failed: DataFrame, votes: DataFrame) -> DataFrame:
    """User rows of a conversation are resolved by a recovery that comes after them: compared with the conversation's last."""
    last = recoveries(votes).groupBy("conv_id").agg(F.max("vote_id").alias("recovered"))
    hit = (F.col("source") == "user") & (F.col("recovered") > F.col("vote_id"))
    return failed.join(last, "conv_id", "left").withColumn("resolved", F.col("resolved") | F.coalesce(hit, F.lit(False))).drop("recovered")


def failed_queue(votes: DataFrame, scored: DataFrame) -> DataFrame:
    """The queue after all votes: automatic rows and user rows, recovered ones resolved. ``failed_id`` is a hash of its key."""
    auto = enqueue_auto(scored).withColumn("vote_id", F.lit(None).cast("long"))
    user = enqueue_user(votes, scored, auto)
    return resolve_recovered(auto.unionByName(user), votes)


def enrich_downvotes(failed: DataFrame, votes: DataFrame) -> DataFrame:
    """Adds downvotes: those of the row's conversation."""
    down = votes.filter("vote = -1").groupBy("conv_id").agg(F.count("*").alias("downvotes"))
    return failed.join(down, "conv_id", "left").fillna(0, ["downvotes"])


def open_failed(failed: DataFrame, limit: int, source: str | None = None, unresolved_only: bool = True, order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    out = failed.filter(~F.col("resolved")) if unresolved_only else failed
    out = out.filter(F.col("source") == source) if source else out
    return out.orderBy(*(F.desc(c) for c in order)).limit(limit)


def apply_annotations(failed: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    """The latest annotation (ann_id) of each row: its preferred_response is set and the row is open again."""
    latest = annotations.groupBy(*key).agg(F.max_by("preferred_response", "ann_id").alias("preferred_response"))
    out = failed.join(latest, key, "left")
    return out.withColumn("resolved", F.col("resolved") & F.col("preferred_response").isNull())


def unknown_annotations(failed: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    return annotations.join(failed.select(*key).distinct(), key, "left_anti")


def feedback_summary(votes: DataFrame, failed: DataFrame, scored: DataFrame) -> DataFrame:
    """One row of dashboard numbers; a mean score of 0 counts as none."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    v = votes.agg(F.count("*").alias("total_votes"), n(F.col("vote") == 1).alias("thumbs_up"), n(F.col("vote") == -1).alias("thumbs_down"))
    f = failed.agg(F.count("*").alias("failed_total"), n(F.col("source") == "auto").alias("auto_flagged"), n(F.col("source") == "user").alias("user_flagged"), n(F.col("resolved")).alias("resolved"))
    s = scored.agg(F.avg("composite_score").alias("a"))
    out = v.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(s))
    out = out.withColumn("satisfaction_rate", F.col("thumbs_up") / F.greatest(F.col("total_votes"), F.lit(1)))
    return out.withColumn("avg_composite_score", F.when(F.col("a") != 0, F.col("a"))).drop("a")


def conversation(conv: DataFrame, conv_id) -> DataFrame:
    return conv.filter(F.col("conv_id") == conv_id).orderBy("turn")


def session_conversations(events: DataFrame, session: str, conv: str, limit: int, value) -> DataFrame:
    """conv, last_ts of a session's conversations, newest first."""
    return events.filter(F.col(session) == value).groupBy(conv).agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), conv).limit(limit)


# ---- preference pairs and runs ----


def priority_score(failed: DataFrame, votes: DataFrame) -> DataFrame:
    """Adds downvotes and priority_score; a missing or zero score counts as 0.5. The largest count is a one-row aggregate."""
    rows = enrich_downvotes(failed, votes)
    top = rows.agg(F.greatest(F.coalesce(F.max("downvotes"), F.lit(1)), F.lit(1)).alias("top"))
    score = F.when(F.coalesce(F.col("composite_score"), F.lit(0.0)) == 0, 0.5).otherwise(F.col("composite_score"))
    value = 0.6 * (1.0 - score) + 0.4 * F.least(F.col("downvotes") / F.col("top"), F.lit(1.0))
    return rows.crossJoin(F.broadcast(top)).withColumn("priority_score", F.round(value, 4)).drop("top")


def export_dpo(failed: DataFrame, votes: DataFrame) -> DataFrame:
    rows = priority_score(failed, votes)
    chosen = F.col("preferred_response") if "preferred_response" in rows.columns else F.lit("")
    return rows.select(
        "prompt", F.col("response").alias("rejected"), F.coalesce(chosen, F.lit("")).alias("chosen"), "priority_score", "composite_score", F.coalesce("grade", F.lit("?")).alias("grade"),
        "failure_reasons", "source", "conv_id", "turn",
    ).orderBy(F.desc("priority_score"), F.desc("conv_id"), F.desc("turn"))


def export_dpo_from_log(bad: DataFrame) -> DataFrame:
    return bad.select("prompt", F.col("response").alias("rejected"), F.lit("").alias("chosen"), "composite_score", "accuracy", "relevance", "coherence", "grade", "failure_reasons")


def select_candidates(failed: DataFrame, limit: int = 500, least: int = 10) -> DataFrame:
    """One row: how many open rows the run takes, and what it does with them."""
    n = open_failed(failed, limit).agg(F.count("*").alias("n_found"))
    return n.withColumn("decision", F.when(F.col("n_found") == 0, "skipped").when(F.col("n_found") < least, "export_only").otherwise("train"))


def mark_resolved(failed: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """A new snapshot in which the exported rows are resolved."""
    done = exported.select(*key).distinct().withColumn("done", F.lit(True))
    return failed.join(done, key, "left").withColumn("resolved", F.col("resolved") | F.coalesce("done", F.lit(False))).drop("done")


def run_audit(events: DataFrame) -> DataFrame:
    """run_id, started, last status and its time, from an append-only log (event_id, run_id, ts, status)."""
    return events.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max_by("status", "event_id").alias("status"), F.max_by("ts", "event_id").alias("updated_at"))


def avg_score_before(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.when(F.col("composite_score") != 0, F.col("composite_score"))).alias("avg_score_before"))


def latest_run(runs: DataFrame, order: str) -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(1)


def run_summary_row(failed: DataFrame, limit: int = 500, least: int = 10) -> DataFrame:
    """found, exported, trained, resolved, status of a run over the queue as it stands."""
    row = select_candidates(failed, limit, least)
    train = F.col("decision") == "train"
    return row.select(
        "n_found", F.col("n_found").alias("n_exported"), F.when(train, F.col("n_found")).otherwise(0).alias("n_trained"), F.when(train, F.col("n_found")).otherwise(0).alias("n_resolved"),
        F.when(train, "done").otherwise(F.col("decision")).alias("status"),
    )


def review_rows(bad: DataFrame, key: str) -> DataFrame:
    """The columns of the human-review sheet."""
    return bad.select(
        key, "prompt", F.col("response").alias("bad_response"), "composite_score", "grade", F.array_join("failure_reasons", "; ").alias("failure_reasons"),
        F.lit("").alias("preferred_response"), F.lit("").alias("annotator_notes"),
    )


# ---- fine-tuning data ----


def to_messages(df: DataFrame) -> DataFrame:
    """Adds ``messages`` to rows with instruction, context, response."""
    ctx = X.nz(F.col("context"))
    user = F.concat(F.col("instruction"), F.when(ctx != "", F.concat(F.lit("\n\nContext: "), ctx)).otherwise(""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(message("user", user), message("assistant", F.col("response"))))


def inject_system(df: DataFrame, pick: Column) -> DataFrame:
    """A system message, chosen by ``pick`` (a whole number), before messages that have none."""
    prompts = F.array(*map(F.lit, rules.SYSTEM_PROMPTS))
    one = F.struct(F.lit("system").alias("role"), F.get(prompts, F.pmod(pick, F.lit(len(rules.SYSTEM_PROMPTS))).cast("int")).alias("content"))
    return df.withColumn("messages", F.when(F.exists("messages", lambda m: m["role"] == "system"), F.col("messages")).otherwise(F.concat(F.array(one), F.col("messages"))))


def sample_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def split_preference(df: DataFrame) -> DataFrame:
    """prompt, chosen, rejected of dialogue texts: cut at the last assistant mark; the prompt is the chosen text's."""
    m = rules.ASSISTANT_MARK
    tail = lambda c: F.substring_index(c, m, -1)
    head = F.when(F.contains("chosen", F.lit(m)), F.expr(f"left(chosen, length(chosen) - length(substring_index(chosen, '{m}', -1)) - {len(m)})".replace("\n", "\\n"))).otherwise("")
    return df.withColumns({"prompt": F.concat(head, F.lit(m)), "chosen": tail(F.col("chosen")), "rejected": tail(F.col("rejected"))})


def to_inst_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.concat(F.lit("<s>[INST] "), "prompt", F.lit(" [/INST] "), "response", F.lit(" </s>")))


def char_vocab(df: DataFrame) -> DataFrame:
    """char, id: distinct characters by code point. The alphabet is small (at most a few thousand), whatever the corpus, so its numbering
    may be one window."""
    chars = df.select(F.explode(F.split(X.nz(F.col("text")), "")).alias("char")).filter("char <> ''").distinct()
    return chars.withColumn("id", F.row_number().over(Window.orderBy(F.ascii("char"), "char")) - 1)


def encode_chars(df: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, ids: the id of each character, null for those that ``vocab`` lacks. The vocabulary is at most the number of code points, so it is
    sent as one array by code point, in which whole texts are looked up at once."""
    rows = vocab.select(F.ascii("char").alias("c"), F.col("id").cast("int").alias("id")).toPandas()
    ids = np.full(max(rows["c"], default=0) + 2, -1, np.int32)
    ids[rows["c"].to_numpy(np.int64)] = rows["id"].to_numpy(np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in batch.column("text").to_pylist()]
            found = ids[np.minimum(np.concatenate([np.zeros(0, "<u4"), *points]), len(ids) - 1)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in points])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32(), mask=found < 0))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "ids"])

    return df.select(key, X.nz(F.col("text")).alias("text")).mapInArrow(encode, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_chars(df: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, text: ``vocab`` (ids from 0, without gaps) is one array by id."""
    chars = F.array(*(F.lit(r.char) for r in sorted(vocab.select("char", "id").collect(), key=lambda r: r.id)))
    return df.select(key, F.array_join(F.transform("ids", lambda i: F.get(chars, i)), "").alias("text"))


def train_val_split(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """Adds is_train: rows, by ``order`` (nulls first), up to the first ``share`` of all characters. Offsets are summed per range of the order
    first, so no window spans the table; ranges hold about as many rows each, and equal keys in one range are summed together."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = F.coalesce(F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (F.col(order) > c).cast("int")), F.lit(-1)) if cuts else F.lit(0)
    rows = df.withColumn("part", part).withColumn("len", F.length(X.nz(F.col("text"))))
    sums = rows.groupBy("part").agg(F.sum("len").alias("s"))
    total = sums.agg(F.sum("s")).first()[0] or 0
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    rows = rows.join(F.broadcast(before), "part")
    end = F.col("before") + F.sum("len").over(Window.partitionBy("part").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("is_train", end <= int(share * total)).drop("part", "len", "before")


def block_examples(encoded: DataFrame, key: str, block: int = 128) -> DataFrame:
    """key, start, x, y: strided blocks and the same shifted by one."""
    starts = F.expr(f"case when size(ids) > {block} then sequence(0, size(ids) - {block} - 1, {block}) else array() end")
    out = encoded.select(key, "ids", F.explode(starts).alias("start"))
    return out.select(key, "start", F.slice("ids", F.col("start") + 1, F.lit(block)).alias("x"), F.slice("ids", F.col("start") + 2, F.lit(block)).alias("y"))


def union_instructions(*parts: DataFrame) -> DataFrame:
    """instruction, input ("" where missing), output of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "input" not in out.columns:
        out = out.withColumn("input", F.lit(""))
    return out.select("instruction", F.coalesce("input", F.lit("")).alias("input"), "output")
