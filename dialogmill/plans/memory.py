"""Conversational memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import memory as M
from . import duck
from .base import PAIRS, TALK, pairs, query, read, talk

# A window of 2 that is cut when it holds more than 4: conversations here have at most 8 turns.
W, A = 2, 4
_S = A + 1 - W
EVICT = f"""numbered as (select *, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n from talk),
evict as (select *, rn > n - case when n <= {A} then n else {W} + (n - {A} - 1) % {_S} end as in_window from numbered)"""
_LINE = f"""case when role = 'user' then 'User asked: ' || case when length({duck.strip("text")}) > 200 then substr({duck.strip("text")}, 1, 200) || '…' else {duck.strip("text")} end
 when role = 'assistant' then 'Assistant said: ' || case when length(fs) > 180 then substr(fs, 1, 180) || '…' else fs end end"""
_FIRST = rf"case when regexp_matches({duck.strip('text')}, '[.!?][\s\p{{Z}}]') then regexp_extract({duck.strip('text')}, '^(.*?[.!?])[\s\p{{Z}}]', 1, 's') else {duck.strip('text')} end"
BATCHES = f"{EVICT}, lined as (select *, {_LINE} as line from (select *, {_FIRST} as fs, ((rn - 1) // {_S})::int as batch from evict where not in_window)), batches as (select conv_id, batch, coalesce(string_agg(line, ' | ' order by rn), '') as summary from lined group by all)"


@query(f"with {PAIRS} select * from pairs")
def pair_turns(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"with {TALK}, {EVICT} select conv_id, turn, rn::int as rn, role from evict where in_window")
def memory_window(spark, sf_dir):
    return M.memory_window(talk(spark, sf_dir), W, A).drop("text")


@query(f"with {TALK}, {EVICT} select conv_id, turn, rn::int as rn, in_window, case when not in_window then ((rn - 1) // {_S})::int end as batch from evict")
def eviction_batches(spark, sf_dir):
    return M.eviction_batches(talk(spark, sf_dir), W, A).select("conv_id", "turn", "rn", "in_window", "batch")


@query(f"with {TALK}, {BATCHES} select conv_id, batch, summary from batches")
def summarize_batches(spark, sf_dir):
    return M.summarize_batches(talk(spark, sf_dir), W, A)


@query(
    f"""with recursive {TALK}, {BATCHES}, ordered as (select *, row_number() over (partition by conv_id order by batch) as k, count(*) over (partition by conv_id) as m from batches),
roll as (select conv_id, k, m, summary as s from ordered where k = 1 union all
 select o.conv_id, o.k, o.m, case when r.s = '' then o.summary when length(r.s) > 300 and length(r.s) + 1 + length(o.summary) > 400 then '…' || right(r.s || chr(10) || o.summary, 400) else r.s || chr(10) || o.summary end
 from roll r join ordered o on o.conv_id = r.conv_id and o.k = r.k + 1)
select conv_id, s as rolling_summary from roll where k = m"""
)
def rolling_summary(spark, sf_dir):
    return M.rolling_summary(talk(spark, sf_dir), W, A, long=300, keep=400)


def _found(i, name, p):
    return f"select conv_id, turn, {i} as k, '{name}' as category, unnest(v) as value, generate_subscripts(v, 1) - 1 as pos from (select conv_id, turn, regexp_extract_all(text, {duck.q(p)}, 1) as v from talk where role = 'user')"


FACTS = "found as (" + " union all ".join(_found(i, n, p) for i, (n, p) in enumerate(rules.KEY_INFO)) + f"), facts as (select * from (select * replace ({duck.strip('value')} as value) from found) where value <> '' and length(value) < 100)"


@query(f"with {TALK}, {FACTS} select conv_id, turn, k::int as k, category, pos::int as pos, value from facts")
def extract_key_info(spark, sf_dir):
    return M.extract_key_info(talk(spark, sf_dir))


@query(f"with {TALK}, {FACTS}, firsts as (select conv_id, category, value, min((turn, k, pos)) as spot from facts group by all) select conv_id, category, list(value order by spot) as vals from firsts group by all")
def key_info_state(spark, sf_dir):
    """No conversation here has more than 5 values of a category, so the oracle needs no eviction; tests cover that."""
    return M.key_info_state(talk(spark, sf_dir))


@query(f"with {TALK}, {FACTS}, firsts as (select conv_id, category, value, min((turn, k, pos)) as spot from facts group by all), vals as (select conv_id, category, list(value order by spot) as v from firsts group by all) select conv_id, category, '  ' || category || ': ' || array_to_string(list_slice(v, greatest(1, len(v) - 2), len(v)), ', ') as line from vals")
def key_info_lines(spark, sf_dir):
    return M.key_info_lines(M.key_info_state(talk(spark, sf_dir)))


_COS = duck.cosine("u.bag", "p.bag")


@query(
    f"""with {TALK}, users as (select conv_id, turn, text, {duck.tokens("text")} as bag from talk where role = 'user'),
scored as (select u.conv_id, u.turn, p.turn as past_turn, u.text, p.text as past_text, {_COS} as score from users u join users p on u.conv_id = p.conv_id and p.turn <= u.turn),
near as (select *, row_number() over (partition by conv_id, turn order by score desc, past_turn) as r from scored)
select conv_id, turn, past_turn, score, case when length(past_text) > 180 then substr(past_text, 1, 180) || '…' else past_text end as snippet from near where r <= 3 and score > 0.3 and {duck.strip("past_text")} <> {duck.strip("text")}""",
    ("score",),
)
def episodic_recall(spark, sf_dir):
    return M.episodic_recall(talk(spark, sf_dir), 3, 0.3)


@query(
    f"""with {TALK}, numbered as (select *, row_number() over (partition by conv_id order by turn) as rn, {duck.tokens("text")} as bag from talk), a as (select * from numbered where role = 'assistant'),
best as (select u.conv_id, u.turn, max({_COS}) as s from a u join a p on u.conv_id = p.conv_id and p.rn < u.rn and p.rn >= u.rn - 6 group by all)
select a.conv_id, a.turn, coalesce(s, 0.0) as max_similarity, coalesce(s, 0.0) >= 0.5 as is_repetitive from a left join best b on a.conv_id = b.conv_id and a.turn = b.turn""",
    ("max_similarity",),
)
def repetitive_answers(spark, sf_dir):
    return M.repetitive_answers(talk(spark, sf_dir), 0.5)


@query(f"with {TALK}, s as (select *, sum(length(text)) over (partition by conv_id order by turn rows between current row and unbounded following) as chars_from_here from talk) select conv_id, turn, chars_from_here::bigint as chars_from_here from s where (chars_from_here + 100) // 4 <= 300")
def trim_to_budget(spark, sf_dir):
    return M.trim_to_budget(talk(spark, sf_dir), 300, 100).select("conv_id", "turn", "chars_from_here")


_SNIPPET = "case when length(past_text) > 180 then substr(past_text, 1, 180) || '…' else past_text end"


@query(
    f"""with recursive {TALK}, {BATCHES}, {FACTS}, ordered as (select *, row_number() over (partition by conv_id order by batch) as k, count(*) over (partition by conv_id) as m from batches),
roll as (select conv_id, k, m, summary as s from ordered where k = 1 union all
 select o.conv_id, o.k, o.m, case when r.s = '' then o.summary when length(r.s) > 1500 and length(r.s) + 1 + length(o.summary) > 1800 then '…' || right(r.s || chr(10) || o.summary, 1800) else r.s || chr(10) || o.summary end
 from roll r join ordered o on o.conv_id = r.conv_id and o.k = r.k + 1),
firsts as (select conv_id, category, value, min((turn, k, pos)) as spot from facts group by all), vals as (select conv_id, category, list(value order by spot) as v from firsts group by all),
lines as (select conv_id, '  ' || category || ': ' || array_to_string(list_slice(v, greatest(1, len(v) - 2), len(v)), ', ') as line from vals),
known as (select conv_id, string_agg(line, chr(10) order by line) as part from lines group by conv_id),
users as (select conv_id, turn, text, {duck.tokens("text")} as bag from talk where role = 'user'), last_ as (select conv_id, max(turn) as turn from users group by conv_id),
pairs_ as (select u.conv_id, u.turn, p.turn as past_turn, u.text, p.text as past_text, {_COS} as score from users u join last_ using (conv_id, turn) join users p on u.conv_id = p.conv_id and p.turn <= u.turn),
near as (select *, row_number() over (partition by conv_id order by score desc, past_turn) as r from pairs_),
recalled as (select conv_id, string_agg('  - ' || {_SNIPPET}, chr(10) order by score desc, past_turn) as part from near where r <= 3 and score > 0.55 and {duck.strip("past_text")} <> {duck.strip("text")} group by conv_id),
heads as (select c.conv_id, array_to_string(list_filter(['You are a helpful AI assistant.', '[Persistent user facts]' || chr(10) || known.part, '[Conversation summary so far]' || chr(10) || roll.s,
  '[Relevant past user statements]' || chr(10) || recalled.part], lambda x: x is not null), chr(10) || chr(10)) as system from (select distinct conv_id from talk) c
  left join known using (conv_id) left join (select * from roll where k = m) roll using (conv_id) left join recalled using (conv_id)),
held as (select e.conv_id, e.turn, e.role, e.text, system, length(system) + sum(length(e.text)) over (partition by e.conv_id order by e.turn rows between current row and unbounded following) as size from evict e join heads using (conv_id) where in_window)
select conv_id, list_prepend({{'role': 'system', 'content': first(system)}}, coalesce(list({{'role': role, 'content': text}} order by turn) filter (size // 4 <= 2048), [])) as messages from held group by conv_id"""
)
def assemble_messages(spark, sf_dir):
    return M.assemble_messages(talk(spark, sf_dir), "You are a helpful AI assistant.", W, A)


@query(
    f"""with {TALK}, {BATCHES}, {FACTS}, sm as (select conv_id, sum(length(summary)) + count(*) - 1 as summary_chars from batches group by conv_id), fc as (select conv_id, count(distinct category) as fact_categories from facts group by conv_id),
e as (select conv_id, count(*) as total_turns, count(*) filter (in_window) as window_size, count(*) filter (role = 'user') as episodic_count from evict group by conv_id)
select e.*, coalesce(summary_chars, 0)::int as summary_chars, coalesce(fact_categories, 0) as fact_categories from e left join sm on e.conv_id = sm.conv_id left join fc on e.conv_id = fc.conv_id"""
)
def session_stats(spark, sf_dir):
    return M.session_stats(talk(spark, sf_dir), W, A)


@query("select user_id, max(ts) as last_accessed from events group by user_id having max(ts) < (select max(ts) from events) - interval 6 hour")
def idle_sessions(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return M.idle_sessions(events, F.lit(now), 6 * 3600)
