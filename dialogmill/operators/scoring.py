"""Response scoring and evaluation (E*), intents (I*) and validation (R1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text as X


def _or(column: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike(p)
    return out


# ---- scores ----


def accuracy(response: Column, keywords: Column) -> Column:
    """Share of the expected keywords that the response contains, whatever the case; null without keywords."""
    low = F.lower(X.nz(response))
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0, F.round(hits / F.size(keywords), 4))


def relevance(prompt: Column, response: Column) -> Column:
    """Lexical cosine of prompt and response, 0 to 1; blank response 0."""
    return F.when(X.blank(response), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.bag_cosine(X.tokens(prompt), X.tokens(response)))))


def _unique_ratio(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))


def coherence(response: Column) -> Column:
    def minus(w: Column) -> Column:
        n, ratio = F.size(w), _unique_ratio(w)
        return F.when(n < 5, 0.4).otherwise(0.0) + F.when(n > 500, 0.2).otherwise(0.0) + F.when(ratio < 0.35, 0.25).when(ratio < 0.50, 0.10).otherwise(0.0)

    less = X.let(X.words(response), minus) + F.when(response.rlike(rules.ROLE_LEAK), 0.30).otherwise(0.0) + F.when(~response.rlike("[.!?]"), 0.10).otherwise(0.0)
    return F.when(X.blank(response), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - less)), 4))


def composite(acc: Column, rel: Column, coh: Column) -> Column:
    """Weighted; without an accuracy the other two are re-weighted."""
    w = rules.WEIGHTS
    share = w["relevance"] / (w["relevance"] + w["coherence"])
    return F.round(F.when(acc.isNull(), rel * share + coh * (1.0 - share)).otherwise(acc * w["accuracy"] + rel * w["relevance"] + coh * w["coherence"]), 4)


def grade(score: Column, at: int = 1) -> Column:
    """The letter (``at`` 1) or the label (2)."""
    out = F.lit(rules.GRADES[-1][at])
    for row in reversed(rules.GRADES[:-1]):
        out = F.when(score >= row[0], row[at]).otherwise(out)
    return out


def evaluate_responses(df: DataFrame, keywords: str | None = None) -> DataFrame:
    """Adds accuracy, relevance, coherence, composite_score, grade, grade_label to rows with prompt and response."""
    kw = F.col(keywords) if keywords else F.array().cast("array<string>")
    out = df.withColumn("accuracy", accuracy(F.col("response"), kw)).withColumn("relevance", relevance(F.col("prompt"), F.col("response")))
    out = out.withColumn("coherence", coherence(X.nz(F.col("response"))))
    out = out.withColumn("composite_score", composite(F.col("accuracy"), F.col("relevance"), F.col("coherence")))
    return out.withColumn("grade", grade(F.col("composite_score"))).withColumn("grade_label", grade(F.col("composite_score"), 2))


def failure_reasons(response: Column, acc: Column, rel: Column, coh: Column) -> Column:
    r, low, n = rules.REASONS, F.lower(X.nz(response)), F.size(X.words(response))
    found = F.array_compact(
        F.array(
            F.when(acc < 0.30, r["accuracy"]),
            F.when(rel < 0.30, r["relevance"]),
            F.when(coh < 0.40, r["coherence"]),
            F.when(F.contains(low, F.lit("user:")) | F.contains(low, F.lit("assistant:")), r["leak"]),
            F.when(n > 500, X.fill(rules.RUNAWAY, n.cast("string"))),
            F.when(n < 5, r["short"]),
        )
    )
    return F.when(X.blank(response), F.array(F.lit(r["empty"]))).when(F.size(found) == 0, F.array(F.lit(r["other"]))).otherwise(found)


def flag_bad(scored: DataFrame, threshold: float = rules.BAD_BELOW) -> DataFrame:
    """Adds is_bad_response, retrain_candidate and failure_reasons (empty unless bad)."""
    bad = F.col("composite_score") < threshold
    why = failure_reasons(F.col("response"), F.col("accuracy"), F.col("relevance"), F.col("coherence"))
    out = scored.withColumn("is_bad_response", bad).withColumn("retrain_candidate", bad)
    return out.withColumn("failure_reasons", F.when(bad, why).otherwise(F.array().cast("array<string>")))


def run_summary(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run: totals, bad rate, mean scores without nulls, and grade_distribution as a map. Grades are counted first, so a run of any size
    meets as a few partial rows."""
    sums = log.groupBy(by, "grade").agg(
        F.count("*").alias("n"), F.sum(F.col("is_bad_response").cast("long")).alias("bad"),
        *(F.sum(c).alias(f"s_{c}") for c in ("accuracy", "relevance", "coherence", "composite_score")),
        *(F.count(c).alias(f"c_{c}") for c in ("accuracy", "relevance", "coherence", "composite_score")),
    )
    mean = lambda c: F.sum(f"s_{c}") / F.when(F.sum(f"c_{c}") > 0, F.sum(f"c_{c}"))
    return sums.groupBy(by).agg(
        F.sum("n").alias("total_evaluated"), F.sum("bad").alias("bad_responses"), (F.sum("bad") / F.sum("n")).alias("bad_response_rate"),
        mean("accuracy").alias("avg_accuracy"), mean("relevance").alias("avg_relevance"), mean("coherence").alias("avg_coherence"), mean("composite_score").alias("avg_composite"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "n")))).alias("grade_distribution"), F.sum("bad").alias("retrain_candidates"),
    )


def recent_bad(log: DataFrame, limit: int = 500, order: str = "eval_id") -> DataFrame:
    return log.filter("is_bad_response").orderBy(F.desc(order)).limit(limit)


def failure_modes(bad: DataFrame) -> DataFrame:
    """reason, n, percentage of the records, ranked."""
    total = bad.agg(F.count("*").alias("total"))
    counts = bad.select(F.explode("failure_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("percentage")).orderBy(F.desc("n"), "reason")


def bad_report(bad: DataFrame, top: int = 5) -> DataFrame:
    """One row: total, mean composite, the most common reasons in order."""
    modes = failure_modes(bad).limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))).alias("m"))
    return bad.agg(F.count("*").alias("total_bad"), F.avg("composite_score").alias("avg_composite")).crossJoin(F.broadcast(modes)).select("total_bad", "avg_composite", F.transform("m", lambda x: x["reason"]).alias("top_reasons"))


def limit_cases(cases: DataFrame, n: int, order: str) -> DataFrame:
    return cases.orderBy(order).limit(n)


LATENCIES = ("ttft_seconds", "total_time_seconds")
#: A sketch holds up to this many values as they are; beyond, a rank is wrong by about 0.05 % of the rows (2.3 / SKETCH_K^0.9), in a few hundred KB.
SKETCH_K = 8192


def latency_sketches(log: DataFrame, *by: str) -> DataFrame:
    """``by``, n, and of each latency its sum, count, least and greatest value and a KLL sketch: a state of bounded size."""
    out = []
    for c in LATENCIES:
        x = F.col(c).cast("double")
        out += [F.sum(x).alias(f"sum_{c}"), F.count(x).alias(f"count_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias(f"sketch_{c}")]
    return log.groupBy(*by).agg(F.count("*").alias("n"), *out)


def merge_latencies(sketches: DataFrame, *by: str) -> DataFrame:
    """States of parts (days, hosts, finer groups) as states of ``by``."""
    out = []
    for c in LATENCIES:
        out += [F.sum(f"sum_{c}").alias(f"sum_{c}"), F.sum(f"count_{c}").alias(f"count_{c}"), F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"), F.kll_merge_agg_double(f"sketch_{c}", F.lit(SKETCH_K)).alias(f"sketch_{c}")]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *out)


def latency_quantile(c: str, q: float) -> Column:
    """The least value that at least the share ``q`` of a state's values don't exceed; where that falls between two values, as the median of
    an even number does, their mean. Exact while the sketch holds all values; null if there are none."""
    value = lambda rank: F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(min(1.0, rank)))
    return F.when(F.col(f"count_{c}") > 0, (value(q) + value(q + 1e-9)) / 2)


def latency_summary(log: DataFrame, *by: str) -> DataFrame:
    """by, n, and of each latency mean, least, greatest value and median (see ``SKETCH_K``)."""
    out = []
    for c in LATENCIES:
        out += [(F.col(f"sum_{c}") / F.col(f"count_{c}")).alias(f"avg_{c}"), f"min_{c}", f"max_{c}", latency_quantile(c, 0.5).alias(f"p50_{c}")]
    return latency_sketches(log, *by).select(*by, "n", *out)


def score_by(scored: DataFrame, dims: list[str]) -> DataFrame:
    return scored.rollup(*dims).agg(F.count("*").alias("n"), F.avg("composite_score").alias("avg_composite"))


def join_cases_responses(cases: DataFrame, responses: DataFrame, on: str = "id") -> DataFrame:
    return cases.join(responses, on)


# ---- intents ----


def has_code(text: Column) -> Column:
    return F.contains(X.nz(text), F.lit("```")) | _or(X.nz(text), rules.CODE_SIGNATURES)


def classify_intent(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds has_code, category and intent_summary; the first pattern that matches the lower-cased text decides."""
    low = F.lower(X.nz(F.col(col)))
    hit = F.lit(None).cast("string")
    for pattern, name in reversed(rules.INTENTS):
        hit = F.when(low.rlike(pattern), name).otherwise(hit)
    out = df.withColumn("has_code", has_code(F.col(col))).withColumn("hit", hit)
    upgraded = F.col("has_code") & ~F.col("hit").isin("coding", "debugging")
    category = F.when(F.col("hit").isNotNull(), F.when(upgraded, "debugging").otherwise(F.col("hit"))).when(F.col("has_code"), "coding").otherwise("general")
    said = rules.INTENT_SUMMARY
    named = F.when(F.col("hit").isNotNull() & upgraded, said["upgraded"]).when(F.col("hit").isNotNull(), X.fill(said["named"], F.col("hit")))
    summary = named.when(F.col("has_code"), said["code"]).otherwise(said["general"])
    return out.withColumn("category", category).withColumn("intent_summary", summary).drop("hit")


def classify_coding(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds is_coding, sub_intent, is_coding_challenge: a point a pattern, 1.5 for a challenge or snippet; ties go to the first intent."""
    low = F.lower(X.nz(F.col(col)))
    out = df.withColumn("snippet", low.rlike(rules.SNIPPET)).withColumn("challenge", low.rlike(rules.CHALLENGE))
    scores = []
    for i, (name, patterns) in enumerate(rules.CODING.items()):
        s = sum((low.rlike(p).cast("double") for p in patterns), F.lit(0.0))
        if name == "direct_solution":
            s = s + F.when(F.col("snippet") | F.col("challenge"), 1.5).otherwise(0.0)
        scores.append(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    out = out.withColumn("best", F.array_max(F.array(*scores)))
    coding = F.col("best.s") > 0
    return (
        out.withColumn("is_coding", coding)
        .withColumn("sub_intent", F.when(coding, F.col("best.name")).otherwise("none"))
        .withColumn("is_coding_challenge", coding & (F.col("challenge") | ((F.col("best.name") == "direct_solution") & F.col("snippet"))))
        .drop("best", "snippet", "challenge")
    )


def simple_intent(text: Column) -> Column:
    low, out = F.lower(X.nz(text)), F.lit("general")
    for name, parts in reversed(rules.SIMPLE_INTENTS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def attach_steps(df: DataFrame) -> DataFrame:
    """Adds ``steps`` for category, sub_intent and is_coding_challenge: the challenge's template, else the sub-intent's, else the
    category's, else the general one. The templates are a small fixed dimension."""
    table = df.sparkSession.createDataFrame(list(rules.STEPS.items()), "key string, steps array<string>")
    coding = F.col("category").isin("coding", "debugging")
    sub = F.concat(F.lit("coding:"), F.col("sub_intent"))
    key = F.when(coding & F.col("is_coding_challenge"), "coding:direct_solution").when(coding & sub.isin(list(rules.STEPS)), sub)
    key = F.coalesce(key, F.when(F.col("category").isin(list(rules.STEPS)), F.col("category")), F.lit("general"))
    return df.withColumn("key", key).join(F.broadcast(table), "key").drop("key")


def reasoning_block(summary: Column, steps: Column) -> Column:
    return F.concat(F.lit("\n\n[Reasoning Context]\nGoal: "), summary, F.lit("\nStrategy: "), F.array_join(steps, ", "), F.lit("\n"))


def augment_system(df: DataFrame) -> DataFrame:
    """Appends the goal and strategy to ``messages[0]`` if that is a system message."""
    first = F.get("messages", F.lit(0))
    more = F.struct(first["role"].alias("role"), F.concat(first["content"], reasoning_block(F.col("intent_summary"), F.col("steps"))).alias("content"))
    new = F.concat(F.array(more), F.slice("messages", 2, X_MANY))
    return df.withColumn("messages", F.when(first["role"] == "system", new).otherwise(F.col("messages")))


X_MANY = 1_000_000


def prepare_turns(df: DataFrame, col: str = "text") -> DataFrame:
    """Intent, coding intent (only for coding and debugging) and steps of each turn."""
    out = classify_coding(classify_intent(df, col), col)
    own = F.col("category").isin("coding", "debugging")
    out = out.withColumn("sub_intent", F.when(own, F.col("sub_intent")).otherwise("none")).withColumn("is_coding_challenge", own & F.col("is_coding_challenge"))
    return attach_steps(out)


def detect_language(text: Column) -> Column:
    """The first language whose pattern matches, else "code" for indented or symbol-rich text, else null; a single short line is null."""
    lines = F.split(text, "\n", -1)
    indented = F.size(F.filter(lines, lambda x: x.rlike(r"^( {2,}|\t)"))) / F.size(lines)
    density = F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[{}\[\]();=+\-*/&|!<>]")) / F.length(text)).otherwise(F.lit(0.0))
    out = F.when((indented > 0.4) | (density > 0.1), "code")
    # a style rule's pattern tries every start up to the next brace, so it only sees what a brace ends
    braced = F.left(text, F.length(text) - F.length(F.substring_index(text, "}", -1)))
    for name, pattern in reversed(rules.LANGUAGES):
        hit = (F.contains(text, F.lit("{")) & braced.rlike(pattern)) if name == "css" else text.rlike(pattern)
        out = F.when(hit, name).otherwise(out)
    return F.when((F.size(lines) == 1) & (F.length(text) < 20), F.lit(None).cast("string")).otherwise(out)


# ---- validation ----


def validate_response(df: DataFrame) -> DataFrame:
    """Adds issues, valid_score, passed to rows with response and category."""
    r = X.nz(F.col("response"))
    w, n = X.words(r), F.size(X.words(r))
    ratio = _unique_ratio(w)
    coding = F.contains(X.nz(F.col("category")), F.lit("coding"))
    fences, opens, closes = X.count_of(r, "```"), X.count_of(r, "{"), X.count_of(r, "}")
    said = rules.ISSUES
    checks = [
        (~F.col("category").eqNullSafe("greeting") & (n < rules.MIN_WORDS), 0.35, X.fill(said["short"], n.cast("string"))),
        (r.rlike(rules.ROLE_LEAK), 0.30, F.lit(said["leak"])),
        (ratio < 0.35, 0.25, X.fill(said["repetition"], F.format_string("%.2f", ratio))),
        (~r.rlike("[.!?]"), 0.10, F.lit(said["ending"])),
        (coding & (fences == 0), 0.15, F.lit(said["no_block"])),
        (coding & (fences % 2 != 0), 0.40, F.lit(said["open_block"])),
        (coding & (fences > 0) & (opens != closes), 0.30, F.lit(said["braces"])),
    ]
    issues = F.array_compact(F.array(*(F.when(c, text) for c, _, text in checks)))
    minus = sum((F.when(c, m).otherwise(0.0) for c, m, _ in checks), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - minus)), 4)
    return df.withColumn("issues", issues).withColumn("valid_score", score).withColumn("passed", F.col("valid_score") >= 0.55)
