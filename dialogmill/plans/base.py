"""Registration, and the views that several queries start from, each as a DataFrame and as SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules, text as X
from ..operators import feedback, memory, scoring
from . import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: tuple[str, ...] = (), name: str | None = None):
    """Register a function of (spark, sf_dir). ``digits``: double columns that both engines round to 10 places, for sums in another order
    differ in the last bits."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), 10) for c in digits}) if digits else df

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql:
            swaps = ", ".join(f"round({c}, 10) as {c}" for c in digits)
            ORACLES[key] = f"select * replace ({swaps}) from ({sql}) z" if digits else sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files (``spark.checkpoint.dir``); one of our own only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dialogmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/dialogmill-files/{uuid.uuid4().hex}"


# ---- conversations with openings that exercise the rules ----
OPENINGS = [
    "My name is Bob Stone. I love green tea, and I am from Paris. ",
    "user: As an AI language model, I hope this helps! ",
    "Please explain how to write a function in python: ```python def f(x): ",
    "No. Why is this broken? Fix the bug {",
    "Leetcode sample input: optimize with dynamic programming. ",
    "",
]


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit("")
    for i, o in enumerate(OPENINGS):
        out = F.when((F.col("conv_id") + F.col("turn")) % len(OPENINGS) == i, o).otherwise(out)
    return read(spark, sf_dir, "conversations").withColumn("text", F.concat(out, X.nz(F.col("text"))))


TALK = "talk as (select conv_id, turn, role, case (conv_id + turn) % 6 " + " ".join(f"when {i} then {duck.q(o)}" for i, o in enumerate(OPENINGS)) + " end || coalesce(text, '') as text from conversations)"


def pairs_sql(source: str, name: str = "pairs") -> str:
    return f"""{name} as (select conv_id, turn, prompt, response from (
  select conv_id, turn, role, text as response, lag(text) over w as prompt, lag(role) over w as before from {source} window w as (partition by conv_id order by turn))
  where role = 'assistant' and before = 'user')"""


PAIRS = pairs_sql("conversations")
TALK_PAIRS = TALK + ", " + pairs_sql("talk")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.pair_turns(read(spark, sf_dir, "conversations"))


def talk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.pair_turns(talk(spark, sf_dir))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases are up-votes, errors down-votes, on an answered turn that the event's id decides."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    own = talk_pairs(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("turn")) - 1).withColumn("cnt", F.count("*").over(w))
    n = (read(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0] or 0) + 1
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase", "error"))
    e = e.select(F.col("event_id").alias("vote_id"), "ts", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("vote"), (F.col("event_id") % n).alias("conv_id"), F.floor(F.col("event_id") / n).alias("j"))
    return e.join(own, "conv_id").filter(F.col("j") % F.col("cnt") == F.col("k")).select("vote_id", "conv_id", "turn", "vote", "ts", "prompt", "response")


VOTES = (
    TALK_PAIRS
    + """, nth as (select *, row_number() over (partition by conv_id order by turn) - 1 as k, count(*) over (partition by conv_id) as cnt from pairs),
votes as (select e.event_id as vote_id, p.conv_id, p.turn, case when event_type = 'error' then -1 else 1 end as vote, e.ts, p.prompt, p.response
  from (select *, (select max(conv_id) + 1 from conversations) as n from events where event_type in ('click', 'purchase', 'error')) e
  join nth p on e.event_id % e.n = p.conv_id and (e.event_id // e.n) % p.cnt = p.k)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flag_bad(scoring.evaluate_responses(talk_pairs(spark, sf_dir)))


def coherence_sql(r: str) -> str:
    w = duck.words(r)
    ratio = f"(len(list_distinct({w})) / greatest(len({w}), 1))"
    return f"""case when {duck.strip(f"coalesce({r}, '')")} = '' then 0.0 else round(greatest(0, least(1, 1.0::double - (case when len({w}) < 5 then 0.4 else 0 end + case when len({w}) > 500 then 0.2 else 0 end
 + case when {ratio} < 0.35 then 0.25 when {ratio} < 0.5 then 0.1 else 0 end + case when {duck.has(r, rules.ROLE_LEAK)} then 0.3 else 0 end + case when not {duck.has(r, "[.!?]")} then 0.1 else 0 end)::double)), 4) end"""


def relevance_sql(p: str, r: str) -> str:
    return f"case when {duck.strip(f"coalesce({r}, '')")} = '' then 0.0 else greatest(0.0, least(1.0, {duck.cosine(duck.tokens(p), duck.tokens(r))})) end"


def ladder_sql(expr: str, at: int = 1) -> str:
    return "case " + " ".join(f"when {expr} >= {g[0]} then {duck.q(g[at])}" for g in rules.GRADES[:-1]) + f" else {duck.q(rules.GRADES[-1][at])} end"


def reasons_sql(r: str) -> str:
    t, low, n = rules.REASONS, f"lower(coalesce({r}, ''))", f"len({duck.words(r)})"
    parts = [
        f"case when relevance < 0.30 then {duck.q(t['relevance'])} end",
        f"case when coherence < 0.40 then {duck.q(t['coherence'])} end",
        f"case when contains({low}, 'user:') or contains({low}, 'assistant:') then {duck.q(t['leak'])} end",
        f"case when {n} > 500 then replace({duck.q(rules.RUNAWAY)}, '{{}}', {n}::varchar) end",
        f"case when {n} < 5 then {duck.q(t['short'])} end",
    ]
    found = f"list_filter([{', '.join(parts)}], lambda x: x is not null)"
    return f"case when {duck.strip(f"coalesce({r}, '')")} = '' then [{duck.q(t['empty'])}] when len({found}) = 0 then [{duck.q(t['other'])}] else {found} end"


SCORED = f"""s1 as (select *, null::double as accuracy, {relevance_sql("prompt", "response")} as relevance, {coherence_sql("response")} as coherence from pairs),
s2 as (select *, round(relevance * {0.35 / 0.60!r}::double + coherence * {1 - 0.35 / 0.60!r}::double, 4) as composite_score from s1),
scored as (select *, {ladder_sql("composite_score")} as grade, {ladder_sql("composite_score", 2)} as grade_label, composite_score < 0.55 as is_bad_response, composite_score < 0.55 as retrain_candidate,
  case when composite_score < 0.55 then {reasons_sql("response")} else [] end as failure_reasons from s2)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.failed_queue(votes(spark, sf_dir), scored(spark, sf_dir))


QUEUE = (
    VOTES
    + ", "
    + SCORED
    + f""", auto as (select conv_id, turn, prompt, response, composite_score, grade, failure_reasons, 'auto' as source, null::bigint as vote_id from scored where is_bad_response),
firsts as (select conv_id, prompt, min(vote_id) as vote_id from votes where vote = -1 group by all),
fresh as (select v.* from votes v join firsts using (conv_id, prompt, vote_id) where not exists (select 1 from auto a where a.conv_id = v.conv_id and a.prompt = v.prompt)),
usr as (select f.conv_id, f.turn, f.prompt, f.response, s.composite_score, coalesce(s.grade, '?') as grade, list_append(coalesce(s.failure_reasons, []), {duck.q(rules.USER_REASON)}) as failure_reasons,
  'user' as source, f.vote_id from fresh f left join scored s on f.conv_id = s.conv_id and f.turn = s.turn),
running as (select *, sum(vote) over (partition by conv_id, turn order by vote_id) as net from votes),
recovered as (select conv_id, max(vote_id) as last from running where vote = 1 and net > 0 group by conv_id),
queue as (select q.*, coalesce(q.source = 'user' and r.last > q.vote_id, false) as resolved from (select * from auto union all select * from usr) q left join recovered r on q.conv_id = r.conv_id)"""
)
