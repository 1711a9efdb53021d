"""Conversational memory (M*): windows and folds over a conversation's turns, and turn pairs (J2).

All window functions share one specification, so Spark sorts a conversation once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, text as X

KEY, ORDER = "conv_id", "turn"


def _w():
    return Window.partitionBy(KEY).orderBy(ORDER)


def pair_turns(conv: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, response: an assistant turn with the user turn just before it."""
    out = conv.select(KEY, ORDER, "role", F.col("text").alias("response"), F.lag("text").over(_w()).alias("prompt"), F.lag("role").over(_w()).alias("before"))
    return out.filter("role = 'assistant' and before = 'user'").select(KEY, ORDER, "prompt", "response")


def eviction_batches(conv: DataFrame, window: int = 8, after: int = 12) -> DataFrame:
    """Adds rn (from 1), batch (null if never evicted) and in_window. When more than ``after`` messages are held, the oldest go until
    ``window`` are left: the closed form of that loop."""
    a = max(after, window)
    s = a + 1 - window
    n = F.count("*").over(Window.partitionBy(KEY))
    size = F.when(F.col("n") <= a, F.col("n")).otherwise(window + (F.col("n") - a - 1) % s)
    out = conv.withColumn("rn", F.row_number().over(_w())).withColumn("n", n).withColumn("in_window", F.col("rn") > F.col("n") - size)
    return out.withColumn("batch", F.when(~F.col("in_window"), F.floor((F.col("rn") - 1) / s).cast("int"))).drop("n")


def memory_window(conv: DataFrame, window: int = 8, after: int = 12) -> DataFrame:
    """The messages that the window holds at the end."""
    return eviction_batches(conv, window, after).filter("in_window").drop("batch", "in_window")


def turn_line(role: Column, text: Column) -> Column:
    """A turn's part of a summary; null for other roles."""
    first = F.element_at(F.split(X.strip(X.nz(text)), rf"(?<=[.!?]){X.SPACE}+", 2), 1)
    return F.when(role == "user", F.concat(F.lit("User asked: "), X.snippet(X.strip(X.nz(text)), 200))).when(role == "assistant", F.concat(F.lit("Assistant said: "), X.snippet(first, 180)))


def summarize_batches(conv: DataFrame, window: int = 8, after: int = 12) -> DataFrame:
    """conv_id, batch, summary of each eviction."""
    lines = eviction_batches(conv, window, after).filter("batch is not null").withColumn("line", turn_line(F.col("role"), F.col("text")))
    rows = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rn", "line"))))
    return lines.groupBy(KEY, "batch").agg(F.array_join(F.transform(rows, lambda x: x["line"]), " | ").alias("summary"))


def rolling_summary(conv: DataFrame, window: int = 8, after: int = 12, long: int = 1500, keep: int = 1800) -> DataFrame:
    """conv_id, rolling_summary: batches joined by line feeds; once the summary is longer than ``long``, the last ``keep`` characters behind
    an ellipsis."""
    rows = summarize_batches(conv, window, after).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("batch", "summary"))).alias("b"))
    fold = F.aggregate(
        "b",
        F.lit(""),
        lambda s, x: F.when(s == "", x["summary"])
        .when((F.length(s) > long) & (F.length(s) + 1 + F.length(x["summary"]) > keep), F.concat(F.lit("…"), F.right(F.concat(s, F.lit("\n"), x["summary"]), F.lit(keep))))
        .otherwise(F.concat(s, F.lit("\n"), x["summary"])),
    )
    return rows.select(KEY, fold.alias("rolling_summary"))


def extract_key_info(conv: DataFrame) -> DataFrame:
    """conv_id, turn, k, pos, category, value: what the patterns find in user turns, in order of pattern and match."""
    found = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("category"), F.regexp_extract_all(X.nz(F.col("text")), F.lit(p), F.lit(1)).alias("v")) for k, (name, p) in enumerate(rules.KEY_INFO)))
    rows = conv.filter("role = 'user'").select(KEY, ORDER, F.explode(found).alias("f")).select(KEY, ORDER, "f.k", "f.category", F.posexplode("f.v").alias("pos", "value"))
    return rows.withColumn("value", X.strip(F.col("value"))).filter((F.col("value") != "") & (F.length("value") < 100))


def key_info_state(conv: DataFrame, most: int = 5) -> DataFrame:
    """conv_id, category, vals: distinct values in order, the last ``most``; one that fell out may come in again."""
    rows = extract_key_info(conv).groupBy(KEY, "category").agg(F.array_sort(F.collect_list(F.struct(ORDER, "k", "pos", "value"))).alias("r"))
    fold = F.aggregate(
        "r",
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.array_contains(acc, x["value"]), acc).otherwise(
            F.when(F.size(acc) < most, F.array_append(acc, x["value"])).otherwise(F.array_append(F.slice(acc, 2, most), x["value"]))
        ),
    )
    return rows.select(KEY, "category", fold.alias("vals"))


def key_info_lines(state: DataFrame, last: int = 3) -> DataFrame:
    """conv_id, category, line."""
    some = F.when(F.size("vals") > last, F.slice("vals", -last, last)).otherwise(F.col("vals"))
    return state.select(KEY, "category", F.concat(F.lit("  "), F.col("category"), F.lit(": "), F.array_join(some, ", ")).alias("line"))


def similar_bags(bags: DataFrame, floor: float, key: str = KEY) -> DataFrame:
    """key, bag_id, past_id, score of the pairs (both ways, and each with itself) whose cosine is above ``floor``; ``bags`` holds key, bag_id and tokens, one row a bag.

    Terms are ordered by how few bags of the key hold them. Of each bag only the first terms are met with others: those before which the
    weight of the rest is at least ``floor``. Bags that share none of them share only terms of one bag's rest, and the product with that is
    below ``floor``. So a frequent term joins only bags that hold little else, and the work grows with the pairs that are alike."""
    if not 0 <= floor <= 1:
        raise ValueError("floor must be from 0 to 1")
    terms = bags.select(key, "bag_id", F.inline(X.term_counts(F.col("tokens"))))
    held = terms.groupBy(key, "t").agg(F.count("*").alias("df"))
    order = Window.partitionBy(key, "bag_id").orderBy(F.desc("df"), F.desc("t"))
    rest = F.sqrt(F.sum(F.col("n") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key, "bag_id")))
    first = terms.join(held, [key, "t"]).withColumn("rest", rest).filter(F.col("rest") >= floor - 1e-9).select(key, "bag_id", "t")
    pairs = first.join(first.withColumnRenamed("bag_id", "past_id"), [key, "t"]).select(key, "bag_id", "past_id").distinct()
    met = pairs.join(bags, [key, "bag_id"]).join(bags.select(key, F.col("bag_id").alias("past_id"), F.col("tokens").alias("past_tokens")), [key, "past_id"])
    return met.withColumn("score", X.bag_cosine(F.col("tokens"), F.col("past_tokens"))).filter(F.col("score") > floor).select(key, "bag_id", "past_id", "score")


def episodic_recall(conv: DataFrame, k: int = 3, floor: float = 0.55, only: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, past_turn, score, snippet: of the k user turns so far (the turn itself included) most like a user turn, those above
    the floor with another text. ``only`` (conv_id, turn): for these turns alone.

    Turns of one bag of words are one bag: its first k turns stand for the others, as those come first among equal scores."""
    users = conv.filter("role = 'user'").select(KEY, ORDER, "text", F.array_sort(X.tokens(F.col("text"))).alias("tokens"))
    users = users.withColumn("bag_id", F.md5(F.to_json("tokens")))
    first = users.withColumn("nth", F.row_number().over(Window.partitionBy(KEY, "bag_id").orderBy(ORDER))).filter(F.col("nth") <= k)
    alike = similar_bags(first.filter("nth = 1").select(KEY, "bag_id", "tokens"), floor)
    past = first.select(KEY, F.col("bag_id").alias("past_id"), F.col(ORDER).alias("past_turn"), F.col("text").alias("past_text"))
    now = users.drop("tokens") if only is None else users.drop("tokens").join(only.select(KEY, ORDER), [KEY, ORDER], "left_semi")
    scored = now.join(alike, [KEY, "bag_id"]).join(past, [KEY, "past_id"]).filter(F.col("past_turn") <= F.col(ORDER))
    near = scored.withColumn("r", F.row_number().over(Window.partitionBy(KEY, ORDER).orderBy(F.desc("score"), "past_turn"))).filter(F.col("r") <= k)
    kept = near.filter(X.strip(X.nz(F.col("past_text"))) != X.strip(X.nz(F.col("text"))))
    return kept.select(KEY, ORDER, "past_turn", "score", X.snippet(F.col("past_text"), 180).alias("snippet"))


def repetitive_answers(conv: DataFrame, threshold: float = 0.92, back: int = 6) -> DataFrame:
    """conv_id, turn, max_similarity, is_repetitive of assistant turns against those among the ``back`` messages before."""
    before = F.collect_list(F.when(F.col("role") == "assistant", F.struct(X.tokens(F.col("text")).alias("bag")))).over(_w().rowsBetween(-back, -1))
    rows = conv.withColumn("before", before).filter("role = 'assistant'").withColumn("bag", X.tokens(F.col("text")))
    best = F.array_max(F.transform("before", lambda p: X.bag_cosine(F.col("bag"), p["bag"])))
    out = rows.select(KEY, ORDER, F.coalesce(best, F.lit(0.0)).alias("max_similarity"))
    return out.withColumn("is_repetitive", F.col("max_similarity") >= threshold)


def trim_to_budget(conv: DataFrame, budget: int = 2048, system_chars: int = 0, chars_per_token: int = 4) -> DataFrame:
    """The newest turns whose characters, with the system text's, stay within the budget."""
    later = F.sum(F.length(X.nz(F.col("text")))).over(_w().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return conv.withColumn("chars_from_here", later).filter(F.floor((F.col("chars_from_here") + system_chars) / chars_per_token) <= budget)


def assemble_messages(conv: DataFrame, identity: str, window: int = 8, after: int = 12, budget: int = 2048) -> DataFrame:
    """conv_id, messages: a system message (identity, facts, summary, recalled statements for the last user turn), then the window, within
    the budget. The system message always stays."""
    facts = key_info_lines(key_info_state(conv)).groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("facts"))
    last = conv.filter("role = 'user'").groupBy(KEY).agg(F.max(ORDER).alias(ORDER))
    recall = episodic_recall(conv, only=last)
    recall = recall.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "past_turn", "snippet"))).alias("r"))
    recall = recall.select(KEY, F.array_join(F.transform("r", lambda x: F.concat(F.lit("  - "), x["snippet"])), "\n").alias("recalled"))
    rows = memory_window(conv, window, after).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("t"), "role", X.nz(F.col("text")).alias("content")))).alias("h"))
    out = rows.join(facts, KEY, "left").join(rolling_summary(conv, window, after), KEY, "left").join(recall, KEY, "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"[{head}]\n"), F.col(c)))
    system = F.concat_ws("\n\n", F.lit(identity), part("Persistent user facts", "facts"), part("Conversation summary so far", "rolling_summary"), part("Relevant past user statements", "recalled"))
    out = out.withColumn("system", system)
    suffix = lambda i: F.aggregate(F.slice("h", i + 1, F.size("h")), F.length("system"), lambda s, x: s + F.length(x["content"]))
    kept = F.filter("h", lambda x, i: F.floor(suffix(i) / 4) <= budget)
    return out.select(KEY, F.concat(F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content"))), F.transform(kept, lambda x: F.struct(x["role"], x["content"]))).alias("messages"))


def session_stats(conv: DataFrame, window: int = 8, after: int = 12) -> DataFrame:
    """conv_id, total_turns, window_size, episodic_count, summary_chars, fact_categories."""
    rows = eviction_batches(conv, window, after).groupBy(KEY).agg(
        F.count("*").alias("total_turns"), F.sum(F.col("in_window").cast("long")).alias("window_size"), F.sum((F.col("role") == "user").cast("long")).alias("episodic_count")
    )
    summary = rolling_summary(conv, window, after).select(KEY, F.length("rolling_summary").alias("summary_chars"))
    facts = key_info_state(conv).groupBy(KEY).agg(F.count("*").alias("fact_categories"))
    out = rows.join(summary, KEY, "left").join(facts, KEY, "left")
    return out.fillna(0, ["summary_chars", "fact_categories"])


def idle_sessions(events: DataFrame, now: Column, idle_seconds: int = 3600, by: str = "user_id") -> DataFrame:
    """Sessions whose last event is strictly older than ``idle_seconds``."""
    last = events.groupBy(by).agg(F.max("ts").alias("last_accessed"))
    return last.filter(F.col("last_accessed") < now - F.make_dt_interval(secs=F.lit(float(idle_seconds))))
