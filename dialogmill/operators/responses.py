"""Clean-up of responses (R2-R11) and stream text (Z1 in batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, text as X
from .scoring import simple_intent


def basic_cleanup(text: Column) -> Column:
    return X.capitalise(X.chain(X.chain(X.strip(X.nz(text)), rules.ROBOTIC), rules.SPACING))


def rewrite_response(text: Column, category: Column) -> Column:
    """Robotic phrases, leaked roles and curt openers go; a capital, an end mark and, for complaints, an opening line come."""
    out = X.capitalise(X.chain(X.chain(X.chain(X.strip(X.nz(text)), rules.ROBOTIC), rules.LEAKS), rules.OPENERS))
    out = F.when((out != "") & ~out.rlike(r"[.!?]\z"), F.concat(out, F.lit("."))).otherwise(out)
    out = F.when((category == "complaint") & ~F.lower(out).startswith("i understand"), F.concat(F.lit(rules.COMPLAINT_HEADER), out)).otherwise(out)
    return X.strip(X.chain(out, rules.SPACING))


def refine(validated: DataFrame) -> DataFrame:
    """Adds refined and was_refined to rows with response, category, issues: rewritten if there are issues, else tidied."""
    out = F.when(F.size("issues") > 0, rewrite_response(F.col("response"), F.col("category"))).otherwise(basic_cleanup(F.col("response")))
    return validated.withColumn("refined", out).withColumn("was_refined", ~F.col("passed"))


def _parts(text: Column) -> Column:
    return F.split(X.strip(text), r"(?<=[.!?]) +", -1)


def dedup_sentences(text: Column) -> Column:
    """Sentences whose letters and digits came before go, and those without any."""
    keyed = F.transform(_parts(X.nz(text)), lambda s: F.struct(F.regexp_replace(F.lower(s), "[^a-z0-9]", "").alias("k"), s.alias("s")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        keyed,
        start,
        lambda acc, x: F.when((x["k"] == "") | F.array_contains(acc["seen"], x["k"]), acc).otherwise(
            F.struct(F.array_append(acc["seen"], x["k"]).alias("seen"), F.array_append(acc["out"], x["s"]).alias("out"))
        ),
        lambda acc: F.array_join(acc["out"], " "),
    )


def cap_sentences(text: Column, intent: Column) -> Column:
    """The intent's most sentences; code is not cut."""
    most = F.lit(rules.MAX_SENTENCES["general"])
    for name, n in rules.MAX_SENTENCES.items():
        most = F.when(intent == name, n).otherwise(most)
    return F.when(intent == "coding", F.array_join(_parts(text), " ")).otherwise(F.array_join(F.slice(_parts(text), F.lit(1), most), " "))


def polish_tone(text: Column) -> Column:
    out = X.strip(F.regexp_replace(X.chain(text, rules.TONE), X.SPACE + "+", " "))
    return X.capitalise(F.regexp_replace(out, rf"^{X.SPACE}*[,.]{X.SPACE}*", ""))


def refine_bulk(df: DataFrame) -> DataFrame:
    """Adds simple_intent and polished: repeated sentences go, the rest is capped by the prompt's intent and its tone polished."""
    out = df.withColumn("simple_intent", simple_intent(F.col("prompt")))
    return out.withColumn("polished", polish_tone(cap_sentences(dedup_sentences(F.col("response")), F.col("simple_intent"))))


def completeness(df: DataFrame, col: str = "response") -> DataFrame:
    """Adds incomplete_code_block, open_language, unclosed_braces, last_complete_line, is_complete."""
    t = X.nz(F.col(col))
    tags = F.regexp_extract_all(t, F.lit(r"```(\w*)"), F.lit(1))
    lines = F.split(t, "\n", -1)
    out = df.withColumn("incomplete_code_block", F.size(tags) % 2 != 0)
    out = out.withColumn("open_language", F.when(F.col("incomplete_code_block"), F.lower(F.element_at(tags, -1))).otherwise(""))
    out = out.withColumn("unclosed_braces", F.greatest(F.lit(0), X.count_of(t, "{") - X.count_of(t, "}")))
    out = out.withColumn("last_complete_line", F.when(F.size(lines) > 1, X.strip(F.get(lines, F.size(lines) - 2))).otherwise(""))
    waits = F.col("open_language").isin("python", "py") & X.rstrip(F.element_at(lines, -1)).endswith(":")
    return out.withColumn("is_complete", ~F.col("incomplete_code_block") & (F.col("unclosed_braces") == 0) & ~waits)


def recovery_prompts(checked: DataFrame, interrupted: Column, coding: Column) -> DataFrame:
    """Of responses that were interrupted or left code open: the instruction to go on."""
    python = F.col("open_language").isin("python", "py")
    line = F.col("last_complete_line")
    said = rules.RECOVERY
    solver = F.array_compact(
        F.array(
            F.lit(said["mode"]),
            F.when(line != "", X.fill(said["line"], line)).otherwise(said["where"]),
            F.when(F.col("incomplete_code_block"), said["block"]),
            F.when((F.col("unclosed_braces") > 0) & ~python, X.fill(said["braces"], F.col("unclosed_braces").cast("string"))),
            F.when(python, said["python"]),
            F.lit(said["end"]),
        )
    )
    text = F.when(coding, F.array_join(solver, " ")).otherwise(said["plain"])
    head = F.lit(said["head"])
    return checked.filter(interrupted | F.col("incomplete_code_block") | (F.col("unclosed_braces") > 0)).withColumn("recovery_prompt", F.concat(head, text))


def truncate_at_stop(chunks: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, text: chunks (seq, content) joined up to, without, the first whose arrival puts a stop token into the last 50 characters. Only
    the last 50 characters before a chunk are looked at, so the window holds a bounded number of earlier chunks if they aren't empty."""
    w = Window.partitionBy(key).orderBy("seq")
    some = chunks.filter(F.length("content") > 0)
    tail = F.right(F.array_join(F.collect_list("content").over(w.rowsBetween(-50, 0)), ""), F.lit(50))
    low, stop = F.lower(tail), F.lit(False)
    for token in rules.STOP_TOKENS:
        stop = stop | F.contains(low, F.lit(token))
    cut = some.withColumn("stop", stop).withColumn("stopped", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("stopped"), F.struct("seq", "content")))).alias("c"))
    return kept.select(key, F.array_join(F.transform("c", lambda x: x["content"]), "").alias("text"))


def parse_sse(lines: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, response: the contents of ``data:`` lines (seq, line) up to [DONE], in order; a refined version replaces them all. Bad JSON is
    skipped."""
    body = X.strip(F.substring("line", 6, 1_000_000_000))
    rows = lines.filter(F.col("line").startswith("data:")).select(key, "seq", body.alias("d"))
    ends = rows.groupBy(key).agg(F.min(F.when(F.col("d") == "[DONE]", F.col("seq"))).alias("end"))
    rows = rows.join(ends, key).filter(F.col("end").isNull() | (F.col("seq") < F.col("end"))).filter("d <> '[DONE]'")
    parsed = rows.withColumn("j", F.from_json("d", "content string, refined boolean, full string"))
    agg = parsed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("j.content").isNotNull(), F.struct("seq", F.col("j.content").alias("c"))))).alias("parts"),
        F.max_by("j.full", F.when(F.col("j.refined") & (F.length("j.full") > 0), F.col("seq"))).alias("full"),
    )
    return agg.select(key, F.coalesce("full", X.strip(F.array_join(F.transform("parts", lambda x: x["c"]), ""))).alias("response"))
