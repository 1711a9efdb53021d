"""Votes, queue, dashboards, preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as FB
from .base import QUEUE, SCORED, TALK_PAIRS, VOTES, query, queue, read, scored, talk, votes



@query(f"with {VOTES}, x as (select *, case when vote_id % 7 = 0 then 0 else vote end as v2 from votes) select vote_id, v2 as vote from x where v2 in (1, -1)")
def valid_votes(spark, sf_dir):
    return FB.valid_votes(votes(spark, sf_dir).withColumn("vote", F.when(F.col("vote_id") % 7 == 0, 0).otherwise(F.col("vote")))).select("vote_id", "vote")


@query(f"with {VOTES} select vote_id from votes where vote_id % 7 = 0")
def rejected_votes(spark, sf_dir):
    return FB.rejected_votes(votes(spark, sf_dir).withColumn("vote", F.when(F.col("vote_id") % 7 == 0, 0).otherwise(F.col("vote")))).select("vote_id")


@query(f"with {VOTES} select conv_id, turn, sum(vote)::bigint as net from votes group by all")
def net_score(spark, sf_dir):
    return FB.net_score(votes(spark, sf_dir))


@query(f"with {VOTES} select conv_id, turn, sum(vote)::bigint as net, round(1 / (1 + exp(-sum(vote)::double)), 4) as feedback_score from votes group by all")
def feedback_score(spark, sf_dir):
    return FB.feedback_score(votes(spark, sf_dir))


@query(f"with {VOTES} select vote_id, case when vote = 1 then 'thumbs_up' else 'thumbs_down' end as label from votes")
def vote_labels(spark, sf_dir):
    return FB.vote_labels(votes(spark, sf_dir)).select("vote_id", "label")


@query(f"with {VOTES} select conv_id, turn, sum(vote)::bigint as net from votes group by all having sum(vote) <= -2")
def promote_by_net(spark, sf_dir):
    return FB.promote_by_net(votes(spark, sf_dir))


@query(f"with {VOTES} select vote_id, conv_id, turn, vote, ts from votes where vote = -1 order by vote_id desc limit 100")
def recent_votes(spark, sf_dir):
    return FB.recent_votes(votes(spark, sf_dir), 100, -1).select("vote_id", "conv_id", "turn", "vote", "ts")


@query(f"with {VOTES}, n as (select conv_id, turn, sum(vote)::bigint as net, round(1 / (1 + exp(-sum(vote)::double)), 4) as feedback_score from votes group by all) select v.vote_id, n.net, n.feedback_score from votes v join n using (conv_id, turn)")
def enrich_feedback_score(spark, sf_dir):
    return FB.enrich_feedback_score(votes(spark, sf_dir)).select("vote_id", "net", "feedback_score")


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, composite_score, grade, is_bad_response, failure_reasons from scored")
def log_turns(spark, sf_dir):
    return FB.log_turns(talk(spark, sf_dir)).select("conv_id", "turn", "composite_score", "grade", "is_bad_response", "failure_reasons")


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, prompt, response, composite_score, grade, failure_reasons, 'auto' as source, false as resolved from scored where is_bad_response")
def enqueue_auto(spark, sf_dir):
    return FB.enqueue_auto(scored(spark, sf_dir))


@query(f"with {QUEUE} select conv_id, turn, vote_id, prompt, response from fresh")
def new_downvotes(spark, sf_dir):
    return FB.new_downvotes(votes(spark, sf_dir), FB.enqueue_auto(scored(spark, sf_dir)))


@query(f"with {QUEUE}, cast_ as (select * replace (case when vote_id % 10 = 0 then turn + 1000 else turn end as turn) from votes) select v.vote_id, s.composite_score, coalesce(s.grade, '?') as grade, coalesce(s.failure_reasons, []) as failure_reasons from cast_ v left join scored s on v.conv_id = s.conv_id and v.turn = s.turn")
def attach_scores_to_votes(spark, sf_dir):
    """Every tenth vote is on a turn that doesn't exist."""
    cast = votes(spark, sf_dir).withColumn("turn", F.when(F.col("vote_id") % 10 == 0, F.col("turn") + 1000).otherwise(F.col("turn")))
    return FB.attach_scores_to_votes(cast, scored(spark, sf_dir)).select("vote_id", "composite_score", "grade", "failure_reasons")


@query(f"with {QUEUE} select conv_id, turn, prompt, response, composite_score, grade, failure_reasons, source, false as resolved, vote_id from usr")
def enqueue_user(spark, sf_dir):
    s = scored(spark, sf_dir)
    return FB.enqueue_user(votes(spark, sf_dir), s, FB.enqueue_auto(s))


@query(f"with {QUEUE} select * from queue")
def resolve_recovered(spark, sf_dir):
    return queue(spark, sf_dir)


@query(f"with {QUEUE} select q.conv_id, q.turn, q.source, coalesce(d.n, 0) as downvotes from queue q left join (select conv_id, count(*) as n from votes where vote = -1 group by conv_id) d on q.conv_id = d.conv_id")
def enrich_downvotes(spark, sf_dir):
    return FB.enrich_downvotes(queue(spark, sf_dir), votes(spark, sf_dir)).select("conv_id", "turn", "source", "downvotes")


@query(f"with {QUEUE} select conv_id, turn, source from queue where not resolved and source = 'user' order by conv_id desc, turn desc limit 20")
def open_failed(spark, sf_dir):
    return FB.open_failed(queue(spark, sf_dir), 20, "user").select("conv_id", "turn", "source")


_ANN = "ann as (select event_id as ann_id, event_id % 40 as conv_id, 1 as turn, 'better ' || event_id as preferred_response from events where event_type = 'signup')"


def _annotations(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type = 'signup'")
    return e.select(F.col("event_id").alias("ann_id"), (F.col("event_id") % 40).alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.concat(F.lit("better "), F.col("event_id")).alias("preferred_response"))


@query(f"with {QUEUE}, {_ANN}, latest as (select conv_id, turn, max_by(preferred_response, ann_id) as preferred_response from ann group by all) select q.conv_id, q.turn, q.source, q.resolved and l.preferred_response is null as resolved, l.preferred_response from queue q left join latest l on q.conv_id = l.conv_id and q.turn = l.turn")
def apply_annotations(spark, sf_dir):
    return FB.apply_annotations(queue(spark, sf_dir), _annotations(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "source", "resolved", "preferred_response")


@query(f"with {QUEUE}, {_ANN} select ann_id, conv_id from ann a where not exists (select 1 from queue q where q.conv_id = a.conv_id and q.turn = a.turn)")
def unknown_annotations(spark, sf_dir):
    return FB.unknown_annotations(queue(spark, sf_dir), _annotations(spark, sf_dir), ["conv_id", "turn"]).select("ann_id", "conv_id")


@query(
    f"""with {QUEUE} select (select count(*) from votes) as total_votes, (select count(*) from votes where vote = 1) as thumbs_up, (select count(*) from votes where vote = -1) as thumbs_down,
 count(*) as failed_total, count(*) filter (source = 'auto') as auto_flagged, count(*) filter (source = 'user') as user_flagged, count(*) filter (resolved) as resolved,
 (select count(*) from votes where vote = 1) / greatest((select count(*) from votes), 1) as satisfaction_rate, (select nullif(avg(composite_score), 0) from scored) as avg_composite_score from queue""",
    ("satisfaction_rate", "avg_composite_score"),
)
def feedback_summary(spark, sf_dir):
    return FB.feedback_summary(votes(spark, sf_dir), queue(spark, sf_dir), scored(spark, sf_dir))


@query("select * from conversations where conv_id = 5")
def conversation(spark, sf_dir):
    return FB.conversation(read(spark, sf_dir, "conversations"), 5)


@query("select event_type, max(ts) as last_ts from events where user_id = (select min(user_id) from events) group by event_type order by last_ts desc, event_type limit 3")
def session_conversations(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return FB.session_conversations(e, "user_id", "event_type", 3, e.agg(F.min("user_id")).first()[0])


_PRIORITY = f"""{QUEUE}, down as (select conv_id, count(*) as n from votes where vote = -1 group by conv_id), dq as (select q.*, coalesce(d.n, 0) as downvotes from queue q left join down d on q.conv_id = d.conv_id),
ranked as (select *, round(0.6::double * (1 - coalesce(nullif(composite_score, 0), 0.5)) + 0.4::double * least(downvotes / (select greatest(max(downvotes), 1) from dq), 1), 4) as priority_score from dq)"""


@query(f"with {_PRIORITY} select conv_id, turn, source, downvotes, priority_score from ranked")
def priority_score(spark, sf_dir):
    return FB.priority_score(queue(spark, sf_dir), votes(spark, sf_dir)).select("conv_id", "turn", "source", "downvotes", "priority_score")


@query(f"with {_PRIORITY} select prompt, response as rejected, '' as chosen, priority_score, composite_score, grade, failure_reasons, source, conv_id, turn from ranked")
def export_dpo(spark, sf_dir):
    return FB.export_dpo(queue(spark, sf_dir), votes(spark, sf_dir))


@query(f"with {TALK_PAIRS}, {SCORED} select prompt, response as rejected, '' as chosen, composite_score, accuracy, relevance, coherence, grade, failure_reasons from scored where is_bad_response", ("relevance",))
def export_dpo_from_log(spark, sf_dir):
    return FB.export_dpo_from_log(scored(spark, sf_dir).filter("is_bad_response"))


_FOUND = "(select least(count(*), 500) as n_found from queue where not resolved)"


@query(f"with {QUEUE} select n_found, case when n_found = 0 then 'skipped' when n_found < 10 then 'export_only' else 'train' end as decision from {_FOUND}")
def select_candidates(spark, sf_dir):
    return FB.select_candidates(queue(spark, sf_dir))


@query(f"with {QUEUE}, done as (select distinct conv_id, turn from queue where not resolved and source = 'user') select q.conv_id, q.turn, q.source, q.resolved or d.conv_id is not null as resolved from queue q left join done d on q.conv_id = d.conv_id and q.turn = d.turn")
def mark_resolved(spark, sf_dir):
    q = queue(spark, sf_dir)
    return FB.mark_resolved(q, q.filter("not resolved and source = 'user'"), ["conv_id", "turn"]).select("conv_id", "turn", "source", "resolved")


_RUNS = "runs as (select event_id, 'run' || (user_id % 50) as run_id, ts, event_type as status from events)"


def _runs(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("run"), F.col("user_id") % 50).alias("run_id"), "ts", F.col("event_type").alias("status"))


@query(f"with {_RUNS} select run_id, min(ts) as started_at, max_by(status, event_id) as status, max_by(ts, event_id) as updated_at from runs group by run_id")
def run_audit(spark, sf_dir):
    return FB.run_audit(_runs(spark, sf_dir))


@query(f"with {TALK_PAIRS}, {SCORED} select avg(nullif(composite_score, 0)) as avg_score_before from scored", ("avg_score_before",))
def avg_score_before(spark, sf_dir):
    return FB.avg_score_before(scored(spark, sf_dir))


@query(f"with {_RUNS} select event_id, run_id, status from runs order by event_id desc limit 1")
def latest_run(spark, sf_dir):
    return FB.latest_run(_runs(spark, sf_dir), "event_id").select("event_id", "run_id", "status")


@query(f"with {QUEUE} select n_found, n_found as n_exported, case when n_found >= 10 then n_found else 0 end as n_trained, case when n_found >= 10 then n_found else 0 end as n_resolved, case when n_found = 0 then 'skipped' when n_found < 10 then 'export_only' else 'done' end as status from {_FOUND}")
def run_summary_row(spark, sf_dir):
    return FB.run_summary_row(queue(spark, sf_dir))
