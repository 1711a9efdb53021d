"""Scoring, intents, validation and clean-up of responses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import rules, text as X
from ..operators import feedback as FB, responses as R, scoring as S
from . import duck
from .base import SCORED, TALK, TALK_PAIRS, coherence_sql, query, read, relevance_sql, scored, talk, talk_pairs

_KEYS = "['the', 'python', 'of', 'zebra']"


def _keys():
    return F.array(*map(F.lit, ["the", "python", "of", "zebra"]))


@query(f"with {TALK_PAIRS} select conv_id, turn, round(len(list_filter({_KEYS}, lambda k: contains(lower(response), k))) / 4, 4) as accuracy from pairs")
def score_accuracy(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select("conv_id", "turn", S.accuracy(F.col("response"), _keys()).alias("accuracy"))


@query(f"with {TALK_PAIRS} select conv_id, turn, {relevance_sql('prompt', 'response')} as relevance from pairs", ("relevance",))
def score_relevance(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select("conv_id", "turn", S.relevance(F.col("prompt"), F.col("response")).alias("relevance"))


@query(f"with {TALK_PAIRS} select conv_id, turn, {coherence_sql('response')} as coherence from pairs")
def score_coherence(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select("conv_id", "turn", S.coherence(F.col("response")).alias("coherence"))


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, composite_score, grade, grade_label from scored")
def composite_grade(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", "composite_score", "grade", "grade_label")


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, prompt, response, accuracy, relevance, coherence, composite_score, grade, grade_label from scored", ("relevance",))
def evaluate_responses(spark, sf_dir):
    return S.evaluate_responses(talk_pairs(spark, sf_dir))


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, is_bad_response, retrain_candidate, failure_reasons from scored")
def flag_bad(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", "is_bad_response", "retrain_candidate", "failure_reasons")


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, unnest(failure_reasons) as reason from scored")
def failure_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", F.explode("failure_reasons").alias("reason"))


_RUNS = "(select *, 'run' || (conv_id % 3) as run_id from scored)"


@query(
    f"""with {TALK_PAIRS}, {SCORED}, g as (select run_id, grade, count(*) as n from {_RUNS} group by all),
m as (select run_id, string_agg(grade || ':' || n, ', ' order by grade) as grade_distribution from g group by run_id)
select t.*, grade_distribution from (select run_id, count(*) as total_evaluated, count(*) filter (is_bad_response) as bad_responses, count(*) filter (is_bad_response) / count(*) as bad_response_rate,
  avg(accuracy) as avg_accuracy, avg(relevance) as avg_relevance, avg(coherence) as avg_coherence, avg(composite_score) as avg_composite, count(*) filter (is_bad_response) as retrain_candidates from {_RUNS} group by run_id) t join m using (run_id)""",
    ("bad_response_rate", "avg_relevance", "avg_coherence", "avg_composite"),
)
def run_summary(spark, sf_dir):
    """The flagship: grades, mean scores and bad rate per run over all assistant turns."""
    out = S.run_summary(scored(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run"), F.col("conv_id") % 3)))
    # a map has no order that two engines share
    entries = F.transform(F.array_sort(F.map_entries("grade_distribution")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return out.withColumn("grade_distribution", F.array_join(entries, ", "))


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id * 100 + turn as eval_id, grade from scored where is_bad_response order by eval_id desc limit 50")
def recent_bad(spark, sf_dir):
    return S.recent_bad(scored(spark, sf_dir).withColumn("eval_id", F.col("conv_id") * 100 + F.col("turn")), 50).select("eval_id", "grade")


@query(f"with {TALK_PAIRS}, {SCORED} select reason, count(*) as n, round(count(*) / (select count(*) from scored where is_bad_response) * 100, 1) as percentage from (select unnest(failure_reasons) as reason from scored where is_bad_response) group by reason")
def failure_modes(spark, sf_dir):
    return S.failure_modes(scored(spark, sf_dir).filter("is_bad_response"))


@query(
    f"""with {TALK_PAIRS}, {SCORED}, m as (select reason, count(*) as n from (select unnest(failure_reasons) as reason from scored where is_bad_response) group by reason order by n desc, reason limit 5)
select count(*) as total_bad, avg(composite_score) as avg_composite, (select list(reason order by n desc, reason) from m) as top_reasons from scored where is_bad_response""",
    ("avg_composite",),
)
def bad_report(spark, sf_dir):
    return S.bad_report(scored(spark, sf_dir).filter("is_bad_response"))


@query("select item_id, text from benchmark order by item_id limit 15")
def limit_cases(spark, sf_dir):
    return S.limit_cases(read(spark, sf_dir, "benchmark"), 15, "item_id")


_LAT = "(select event_type as model_name, abs(value) / 10 as ttft_seconds, abs(value) as total_time_seconds from events)"
_LAT_AGG = ", ".join(f"avg({c}) as avg_{c}, min({c}) as min_{c}, max({c}) as max_{c}, quantile_cont({c}, 0.5) as p50_{c}" for c in ("ttft_seconds", "total_time_seconds"))
_LAT_COLS = tuple(f"{a}_{c}" for c in ("ttft_seconds", "total_time_seconds") for a in ("avg", "min", "max", "p50"))


@query(f"select model_name, count(*) as n, {_LAT_AGG} from {_LAT} group by model_name", _LAT_COLS)
def latency_summary(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("model_name"), (F.abs("value") / 10).alias("ttft_seconds"), F.abs("value").alias("total_time_seconds"))
    return S.latency_summary(log, "model_name")


@query(f"select model_name, count(*) as n, {_LAT_AGG} from {_LAT} group by model_name", _LAT_COLS)
def latency_rollup(spark, sf_dir):
    """States by day and model, merged to models."""
    log = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("model_name"), (F.abs("value") / 10).alias("ttft_seconds"), F.abs("value").alias("total_time_seconds"))
    merged = S.merge_latencies(S.latency_sketches(log, "day", "model_name"), "model_name")
    return merged.select("model_name", "n", *(x for c in S.LATENCIES for x in ((F.col(f"sum_{c}") / F.col(f"count_{c}")).alias(f"avg_{c}"), f"min_{c}", f"max_{c}", S.latency_quantile(c, 0.5).alias(f"p50_{c}"))))


@query(f"with {TALK_PAIRS}, {SCORED} select category, difficulty, count(*) as n, avg(composite_score) as avg_composite from (select *, 'c' || (conv_id % 4) as category, 'd' || (turn % 3) as difficulty from scored) group by rollup(category, difficulty)", ("avg_composite",))
def score_by(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), F.col("conv_id") % 4)).withColumn("difficulty", F.concat(F.lit("d"), F.col("turn") % 3))
    return S.score_by(rows, ["category", "difficulty"])


@query(f"with {TALK_PAIRS} select b.item_id as id, b.text as case_text, p.response from benchmark b join pairs p on b.item_id = p.conv_id")
def join_cases_responses(spark, sf_dir):
    cases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("case_text"))
    return S.join_cases_responses(cases, talk_pairs(spark, sf_dir).select(F.col("conv_id").alias("id"), "response"))


# ---- intents ----
def _any(expr, patterns):
    return "(" + " or ".join(duck.has(expr, p) for p in patterns) + ")"


_CODE = f"(contains(text, '```') or {_any('text', rules.CODE_SIGNATURES)})"
_HIT = "case " + " ".join(f"when {duck.has('lower(text)', p)} then '{n}'" for p, n in rules.INTENTS) + " end"
INTENT = f"""h as (select *, {_CODE} as has_code, {_HIT} as hit from talk),
intent as (select conv_id, turn, role, text, has_code, case when hit is not null and has_code and hit not in ('coding', 'debugging') then 'debugging' when hit is not null then hit when has_code then 'coding' else 'general' end as category,
 case when hit is not null and has_code and hit not in ('coding', 'debugging') then {duck.q(rules.INTENT_SUMMARY['upgraded'])} when hit is not null then {duck.fill(rules.INTENT_SUMMARY['named'], 'hit')}
 when has_code then {duck.q(rules.INTENT_SUMMARY['code'])} else {duck.q(rules.INTENT_SUMMARY['general'])} end as intent_summary from h)"""
_POINTS = {n: " + ".join(f"{duck.has('lower(text)', p)}::int" for p in ps) for n, ps in rules.CODING.items()}
_SNIP = f"({duck.has('lower(text)', rules.SNIPPET)} or {duck.has('lower(text)', rules.CHALLENGE)})"
_POINTS["direct_solution"] += f" + case when {_SNIP} then 1.5 else 0 end"
_ROWS = ", ".join(f"({{'s': ({p})::double, 'i': {-i}, 'name': '{n}'}})" for i, (n, p) in enumerate(_POINTS.items()))
CODING = f"""pts as (select *, list_max([{_ROWS}]) as best from intent),
coding as (select conv_id, turn, role, text, has_code, category, intent_summary, best.s > 0 as is_coding, case when best.s > 0 then best.name else 'none' end as sub_intent,
 best.s > 0 and ({duck.has("lower(text)", rules.CHALLENGE)} or (best.name = 'direct_solution' and {duck.has("lower(text)", rules.SNIPPET)})) as is_coding_challenge from pts)"""


@query(f"with {TALK} select conv_id, turn, {_CODE} as has_code from talk")
def detect_code(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", S.has_code(F.col("text")).alias("has_code"))


@query(f"with {TALK}, {INTENT} select * from intent")
def classify_intent(spark, sf_dir):
    return S.classify_intent(talk(spark, sf_dir))


@query(f"with {TALK}, {INTENT}, {CODING} select conv_id, turn, is_coding, sub_intent, is_coding_challenge from coding")
def classify_coding(spark, sf_dir):
    return S.classify_coding(talk(spark, sf_dir)).select("conv_id", "turn", "is_coding", "sub_intent", "is_coding_challenge")


_SIMPLE = "case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{n}'" for n, ws in rules.SIMPLE_INTENTS) + " else 'general' end"


@query(f"with {TALK} select conv_id, turn, {_SIMPLE} as simple_intent from talk")
def simple_intent(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", S.simple_intent(F.col("text")).alias("simple_intent"))


_STEPS = "steps(key, steps) as (values " + ", ".join(f"('{k}', [{', '.join(map(duck.q, v))}])" for k, v in rules.STEPS.items()) + ")"
PREPARED = f"""own as (select * replace (case when category in ('coding', 'debugging') then sub_intent else 'none' end as sub_intent, category in ('coding', 'debugging') and is_coding_challenge as is_coding_challenge) from coding),
{_STEPS}, prepared as (select o.*, s.steps from own o join steps s on s.key = case when category in ('coding', 'debugging') and is_coding_challenge then 'coding:direct_solution'
 when category in ('coding', 'debugging') and 'coding:' || sub_intent in (select key from steps) then 'coding:' || sub_intent when category in (select key from steps) then category else 'general' end)"""


@query(f"with {TALK}, {INTENT}, {CODING}, {PREPARED} select conv_id, turn, category, sub_intent, is_coding_challenge, steps from prepared")
def attach_steps(spark, sf_dir):
    return S.prepare_turns(talk(spark, sf_dir)).select("conv_id", "turn", "category", "sub_intent", "is_coding_challenge", "steps")


@query(f"with {TALK}, {INTENT}, {CODING}, {PREPARED} select * from prepared")
def prepare_turns(spark, sf_dir):
    return S.prepare_turns(talk(spark, sf_dir))


@query(f"with {TALK}, {INTENT}, {CODING}, {PREPARED} select conv_id, turn, case when role = 'system' then text || chr(10) || chr(10) || '[Reasoning Context]' || chr(10) || 'Goal: ' || intent_summary || chr(10) || 'Strategy: ' || array_to_string(steps, ', ') || chr(10) else text end as first_content from prepared")
def augment_system(spark, sf_dir):
    rows = S.prepare_turns(talk(spark, sf_dir)).withColumn("messages", F.array(F.struct("role", F.col("text").alias("content"))))
    return S.augment_system(rows).select("conv_id", "turn", F.col("messages")[0]["content"].alias("first_content"))


def _language_sql(t):
    cases = " ".join(f"when regexp_matches({t}, {duck.q(re.sub(r'^[(][?](m|i)[)]', '', p))}{', ' + repr('i') if p.startswith('(?i)') else ''}) then '{n}'" for n, p in rules.LANGUAGES)
    for a, b in ((f"{t}, '^(const", f"{t}, '(?m)^(const"), (f"{t}, '^(def", f"{t}, '(?m)^(def"), (f"{t}, '^(public", f"{t}, '(?m)^(public"), (f"{t}, '^(#", f"{t}, '(?m)^(#")):
        cases = cases.replace(a, b)
    lines = f"string_split({t}, chr(10))"
    return rf"""case when len({lines}) = 1 and length({t}) < 20 then null else case {cases} when len(list_filter({lines}, lambda x: regexp_matches(x, '^( {{2,}}|\t)'))) / len({lines}) > 0.4
 or len(regexp_extract_all({t}, '[{{}}\[\]();=+\-*/&|!<>]')) / greatest(length({t}), 1) > 0.1 then 'code' end end"""


@query(f"select page_id as id, {_language_sql('html')} as language from pages union all select doc_id, {_language_sql('text')} from documents")
def detect_language(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), S.detect_language(F.col("html")).alias("language"))
    return pages.union(read(spark, sf_dir, "documents").select("doc_id", S.detect_language(F.col("text"))))


# ---- responses ----
_VALID_IN = f"{TALK_PAIRS}, vin as (select conv_id, turn, response, (['general', 'coding', 'greeting', 'complaint'])[1 + (conv_id % 4)] as category from pairs)"
_W = duck.words("response")
_RATIO = f"(len(list_distinct({_W})) / greatest(len({_W}), 1))"
_CODED = "contains(category, 'coding')"
_FENCE, _OPENB, _CLOSEB = duck.count_of("response", "```"), duck.count_of("response", "{"), duck.count_of("response", "}")
_SAID = {k: duck.q(v) for k, v in rules.ISSUES.items()}
_CHECKS = [
    (f"category <> 'greeting' and len({_W}) < 8", 0.35, duck.fill(rules.ISSUES["short"], f"len({_W})")),
    (duck.has("response", rules.ROLE_LEAK), 0.30, _SAID["leak"]),
    (f"{_RATIO} < 0.35", 0.25, duck.fill(rules.ISSUES["repetition"], f"printf('%.2f', {_RATIO})")),
    (f"not {duck.has('response', '[.!?]')}", 0.10, _SAID["ending"]),
    (f"{_CODED} and {_FENCE} = 0", 0.15, _SAID["no_block"]),
    (f"{_CODED} and {_FENCE} % 2 <> 0", 0.40, _SAID["open_block"]),
    (f"{_CODED} and {_FENCE} > 0 and {_OPENB} <> {_CLOSEB}", 0.30, _SAID["braces"]),
]
VALID = f"""{_VALID_IN}, v1 as (select *, list_filter([{", ".join(f"case when {c} then {t} end" for c, _, t in _CHECKS)}], lambda x: x is not null) as issues,
 round(greatest(0, least(1, 1.0::double - ({" + ".join(f"case when {c} then {m} else 0 end" for c, m, _ in _CHECKS)})::double)), 4) as valid_score from vin),
valid as (select *, valid_score >= 0.55 as passed from v1)"""


#: Per answered turn: the intent of its prompt, then the checks of its response.
AUDIT = (
    f"{TALK_PAIRS}, asked as (select conv_id, turn, 'user' as role, prompt as text from pairs), {INTENT.replace('from talk)', 'from asked)')}, "
    "vin as (select p.conv_id, p.turn, p.response, i.category from pairs p join intent i on p.conv_id = i.conv_id and p.turn = i.turn)" + VALID.removeprefix(_VALID_IN)
)


def _validated(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["general", "coding", "greeting", "complaint"]))
    return S.validate_response(talk_pairs(spark, sf_dir).select("conv_id", "turn", "response", F.get(kinds, (F.col("conv_id") % 4).cast("int")).alias("category")))


@query(f"with {VALID} select conv_id, turn, issues, valid_score, passed from valid")
def validate_response(spark, sf_dir):
    return _validated(spark, sf_dir).select("conv_id", "turn", "issues", "valid_score", "passed")


_BASIC = duck.capitalise(duck.chain(duck.chain(duck.strip("coalesce(response, '')"), rules.ROBOTIC), rules.SPACING))


@query(f"with {TALK_PAIRS} select conv_id, turn, {_BASIC} as cleaned from pairs")
def basic_cleanup(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select("conv_id", "turn", R.basic_cleanup(F.col("response")).alias("cleaned"))


_R1 = duck.capitalise(duck.chain(duck.chain(duck.chain(duck.strip("coalesce(response, '')"), rules.ROBOTIC), rules.LEAKS), rules.OPENERS))
REFINED = f"""r1 as (select *, {_R1} as a from valid), r2 as (select *, case when a <> '' and not regexp_matches(a, '[.!?]\\z') then a || '.' else a end as b from r1),
r3 as (select *, case when category = 'complaint' and not starts_with(lower(b), 'i understand') then {duck.q(rules.COMPLAINT_HEADER)} || b else b end as c from r2),
refined as (select *, {duck.strip(duck.chain("c", rules.SPACING))} as rewritten, {_BASIC} as tidied from r3)"""


@query(f"with {VALID}, {REFINED} select conv_id, turn, rewritten from refined")
def rewrite_response(spark, sf_dir):
    return _validated(spark, sf_dir).select("conv_id", "turn", R.rewrite_response(F.col("response"), F.col("category")).alias("rewritten"))


@query(f"with {VALID}, {REFINED} select conv_id, turn, case when len(issues) > 0 then rewritten else tidied end as refined, not passed as was_refined from refined")
def refine(spark, sf_dir):
    return R.refine(_validated(spark, sf_dir)).select("conv_id", "turn", "refined", "was_refined")


def _parts(t):
    return f"string_split(regexp_replace({duck.strip(t)}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


_TWICE = "response || ' ' || response"
_KEY = "regexp_replace(lower(x), '[^a-z0-9]', '', 'g')"
_DEDUP = f"""parts as (select conv_id, turn, prompt, unnest(p) as x, generate_subscripts(p, 1) as i from (select conv_id, turn, prompt, {_parts("(" + _TWICE + ")")} as p from pairs)),
firsts as (select * from (select *, row_number() over (partition by conv_id, turn, {_KEY} order by i) as r from parts where {_KEY} <> '') where r = 1),
dedup as (select p.conv_id, p.turn, p.prompt, coalesce(d.text, '') as text from pairs p left join (select conv_id, turn, string_agg(x, ' ' order by i) as text from firsts group by all) d using (conv_id, turn))"""


def _twice(spark, sf_dir):
    return talk_pairs(spark, sf_dir).withColumn("response", F.concat("response", F.lit(" "), "response"))


@query(f"with {TALK_PAIRS}, {_DEDUP} select conv_id, turn, text from dedup")
def dedup_sentences(spark, sf_dir):
    return _twice(spark, sf_dir).select("conv_id", "turn", R.dedup_sentences(F.col("response")).alias("text"))


_SIMPLE_P = _SIMPLE.replace("lower(text)", "lower(prompt)")
_MOST = "case si " + " ".join(f"when '{k}' then {v}" for k, v in rules.MAX_SENTENCES.items()) + " end"
_CAPPED = f"{_DEDUP}, si as (select *, {_SIMPLE_P} as si from dedup), capped as (select conv_id, turn, si, array_to_string(case when si = 'coding' then {_parts('text')} else list_slice({_parts('text')}, 1, {_MOST}) end, ' ') as text from si)"


@query(f"with {TALK_PAIRS}, {_CAPPED} select conv_id, turn, text from capped")
def cap_sentences(spark, sf_dir):
    return _twice(spark, sf_dir).select("conv_id", "turn", R.cap_sentences(R.dedup_sentences(F.col("response")), S.simple_intent(F.col("prompt"))).alias("text"))


def _tone(t):
    e = duck.strip(f"regexp_replace({duck.chain(t, rules.TONE)}, '[\\s\\p{{Z}}]+', ' ', 'g')")
    return duck.capitalise(f"regexp_replace({e}, '^[\\s\\p{{Z}}]*[,.][\\s\\p{{Z}}]*', '')")


@query(f"with {TALK_PAIRS} select conv_id, turn, {_tone('response')} as text from pairs")
def polish_tone(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select("conv_id", "turn", R.polish_tone(F.col("response")).alias("text"))


@query(f"with {TALK_PAIRS}, {_CAPPED} select conv_id, turn, si as simple_intent, {_tone('text')} as polished from capped")
def refine_bulk(spark, sf_dir):
    return R.refine_bulk(_twice(spark, sf_dir)).select("conv_id", "turn", "simple_intent", "polished")


_TAGS = "regexp_extract_all(text, '```(\\w*)', 1)"
_LINES = "string_split(text, chr(10))"
COMPLETE = f"""c1 as (select *, len({_TAGS}) % 2 <> 0 as incomplete_code_block, case when len({_TAGS}) % 2 <> 0 then lower({_TAGS}[-1]) else '' end as open_language,
 greatest(0, {duck.count_of("text", "{")} - {duck.count_of("text", "}")})::int as unclosed_braces, case when len({_LINES}) > 1 then {duck.strip(_LINES + "[-2]")} else '' end as last_complete_line from talk),
complete as (select *, not incomplete_code_block and unclosed_braces = 0 and not (open_language in ('python', 'py') and regexp_matches({_LINES}[-1], ':[\\s\\p{{Z}}]*\\z')) as is_complete from c1)"""


@query(f"with {TALK}, {COMPLETE} select conv_id, turn, incomplete_code_block, open_language, unclosed_braces, last_complete_line, is_complete from complete")
def completeness(spark, sf_dir):
    return R.completeness(talk(spark, sf_dir), "text").drop("text", "role")


_ASK = {k: duck.q(v) for k, v in rules.RECOVERY.items()}


@query(
    f"""with {TALK}, {COMPLETE} select conv_id, turn, {_ASK['head']} || case when turn % 2 = 0 then array_to_string(list_filter([
 {_ASK['mode']}, case when last_complete_line <> '' then {duck.fill(rules.RECOVERY['line'], 'last_complete_line')} else {_ASK['where']} end,
 case when incomplete_code_block then {_ASK['block']} end, case when unclosed_braces > 0 and open_language not in ('python', 'py') then {duck.fill(rules.RECOVERY['braces'], 'unclosed_braces')} end,
 case when open_language in ('python', 'py') then {_ASK['python']} end, {_ASK['end']}], lambda x: x is not null), ' ') else {_ASK['plain']} end as recovery_prompt
from complete where conv_id % 5 = 0 or incomplete_code_block or unclosed_braces > 0"""
)
def recovery_prompts(spark, sf_dir):
    checked = R.completeness(talk(spark, sf_dir), "text")
    return R.recovery_prompts(checked, F.col("conv_id") % 5 == 0, F.col("turn") % 2 == 0).select("conv_id", "turn", "recovery_prompt")


_REVIEW = f"with {TALK_PAIRS}, {SCORED} select conv_id * 100 + turn as eval_id, prompt, response as bad_response, composite_score, grade, array_to_string(failure_reasons, '; ') as failure_reasons, '' as preferred_response, '' as annotator_notes from scored where is_bad_response"


@query(_REVIEW)
def review_csv_rows(spark, sf_dir):
    return FB.review_rows(scored(spark, sf_dir).filter("is_bad_response").withColumn("eval_id", F.col("conv_id") * 100 + F.col("turn")), "eval_id")


@query(f"with {TALK}, {INTENT} select conv_id, turn, category, category in ({', '.join(map(duck.q, rules.RETRIEVAL_INTENTS))}) and turn % 3 <> 0 as use_retrieval from intent")
def route_retrieval(spark, sf_dir):
    from ..operators.vectors import route_retrieval as route

    return route(S.classify_intent(talk(spark, sf_dir)).withColumn("is_continuation", F.col("turn") % 3 == 0)).select("conv_id", "turn", "category", "use_retrieval")
