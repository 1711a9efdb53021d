"""Recall by prefix filtering, quantile states, character codes and lexical search against plain versions."""

import math
import random
import statistics
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialogmill.operators import blocks, feedback, memory, scoring, vectors

CONV = "conv_id long, turn long, role string, text string"


def cosine(a, b):
    a, b = Counter(a), Counter(b)
    n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(a[t] * b[t] for t in a) / n if n else 0.0


def recalled(rows, k, floor):
    out = []
    for c, t, role, text in rows:
        if role == "user":
            past = sorted((-round(cosine((text or "").lower().split(), (p or "").lower().split()), 12), u, p or "") for d, u, r, p in rows if d == c and r == "user" and u <= t)
            out += [(c, t, u) for s, u, p in past[:k] if -s > floor and p.strip() != (text or "").strip()]
    return sorted(out)


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.55, 0.9])
def test_recall_against_all_pairs(spark, floor):
    rng = random.Random(3)
    words = [f"w{int(rng.expovariate(0.2))}" for _ in range(400)]
    rows = [(c, t, rng.choice(["user", "user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for c in (1, 2, 3) for t in range(1, 70)]
    rows += [(1, 100 + i, "user", "the very same text") for i in range(9)] + [(1, 120, "user", "text same very the"), (1, 121, "user", None), (None, 1, "user", "alone")]
    got = memory.episodic_recall(spark.createDataFrame(rows, CONV), 3, floor)
    assert sorted((r.conv_id, r.turn, r.past_turn) for r in got.collect() if r.conv_id) == [x for x in recalled([r for r in rows if r[0]], 3, floor)]


def test_recall_of_a_long_conversation(spark):
    """Twice the turns take about twice the time, and frequent words join next to nothing."""
    rng = random.Random(4)

    def talk(n):
        return spark.createDataFrame([(1, t, "user", "the and of " + " ".join(f"w{rng.randrange(n)}" for _ in range(9))) for t in range(n)], CONV).repartition(4).persist()

    took = []
    memory.episodic_recall(talk(300)).count()
    for n in (1_500, 3_000):
        rows = talk(n)
        rows.count()
        began = time.time()
        memory.episodic_recall(rows).count()
        took.append(time.time() - began)
    assert took[1] < 3.5 * took[0] + 5
    with pytest.raises(ValueError):
        memory.episodic_recall(talk(5), floor=-0.1)


def test_latency_states(spark):
    rng = random.Random(5)
    rows = [(f"m{i % 3}", f"d{i % 7}", rng.random() if i % 11 else None, float(rng.randrange(50))) for i in range(900)]
    log = spark.createDataFrame(rows, "model string, day string, ttft_seconds double, total_time_seconds double")
    merged = scoring.merge_latencies(scoring.latency_sketches(log, "model", "day"), "model")
    for df in (scoring.latency_summary(log, "model"), merged.withColumns({f"p50_{c}": scoring.latency_quantile(c, 0.5) for c in scoring.LATENCIES})):
        for r in df.collect():
            for c, i in (("ttft_seconds", 2), ("total_time_seconds", 3)):
                assert r[f"p50_{c}"] == pytest.approx(statistics.median(x[i] for x in rows if x[0] == r.model and x[i] is not None), abs=1e-12)
    none = log.filter("ttft_seconds is null")
    assert scoring.latency_summary(none, "model").select("p50_ttft_seconds", "avg_ttft_seconds").distinct().collect() == [(None, None)]
    assert scoring.latency_summary(log.limit(0), "model").count() == 0
    # a state stays small and its ranks near the truth
    big = spark.range(400_000).select(F.lit("m").alias("model"), F.xxhash64("id").cast("double").alias("ttft_seconds"), (F.col("id") % 1000).cast("double").alias("total_time_seconds"))
    state = scoring.latency_sketches(big, "model").withColumns({"q": scoring.latency_quantile("ttft_seconds", 0.9), "size": F.octet_length("sketch_ttft_seconds")}).first()
    assert state.size < 400_000
    rank = big.filter(F.col("ttft_seconds") <= state.q).count() / 400_000
    assert abs(rank - 0.9) < 0.003


def test_character_codes(spark):
    texts = ["abc", "", None, "ünï \U0001f600\n", "zz\x00a", "\U0010ffff"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    vocab = feedback.char_vocab(df)
    ids = {r.char: r.id for r in vocab.collect()}
    coded = feedback.encode_chars(df.withColumn("ids", F.lit(1)), vocab, "key")
    assert {r.key: r.ids for r in coded.collect()} == {i: [ids[c] for c in t or ""] for i, t in enumerate(texts)}
    assert {r.key: r.text for r in feedback.decode_chars(coded, vocab, "key").collect()} == {i: t or "" for i, t in enumerate(texts)}
    few = vocab.filter("char in ('a', 'b')")
    assert feedback.encode_chars(df.filter("key = 0"), few, "key").first().ids == [ids["a"], ids["b"], None]
    assert feedback.encode_chars(df.filter("key = 0"), vocab.limit(0), "key").first().ids == [None] * 3
    assert feedback.encode_chars(df.limit(0), vocab, "key").count() == 0


def test_lexical_search_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    make = lambda n: [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    asked, held = make(70), make(90) + [(500, None), (501, "the the")]
    want = {}
    for q, t in asked:
        rows = sorted((-round(cosine(t.split(), (p or "").split()), 10), i) for i, p in held if set(t.split()) & set((p or "").split()))
        want[q] = [i for _, i in rows[:4]]
    bags = lambda rows, key: vectors.embed_text(spark.createDataFrame(rows, f"{key} long, text string")).select(key, "bag")
    for terms, meetings in ((10**6, 10**6), (100, 50)):
        monkeypatch.setattr(blocks, "PASSAGE_TERMS", terms)
        monkeypatch.setattr(blocks, "MEETINGS", meetings)
        got = {}
        for r in vectors.lexical_search(bags(asked, "query_id"), bags(held, "id"), 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: x for q, x in want.items() if x}
    assert vectors.lexical_search(bags(asked, "query_id"), bags([], "id"), 4).count() == 0
