"""Keyed streaming state against the batch operators: rows in any order, changed rows only, late and idle rows, documents by content."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dialogmill import registry
from dialogmill.operators import corpus, feedback, memory
from dialogmill.streaming import keyed, streams

SF = "/root/testdata/sf0.001"
VOTE = "vote_id long, conv_id long, turn long, vote int, prompt string, response string, ts timestamp"


def fed(spark, path, files, start):
    """Write each of ``files`` in turn, running the query to the end after each."""
    for df in files:
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        with keyed.keyed_state(spark):
            start(streams.stream_of(spark, f"{path}/in", files[0].schema))


def queue_of(spark, path, scored):
    rows = streams.failed_queue(streams.latest(spark, f"{path}/out", ["conv_id", "prompt"]), scored)
    return sorted(map(repr, rows.select("conv_id", "turn", "prompt", "response", "composite_score", "grade", "failure_reasons", "source", "resolved", "vote_id").collect()))


@pytest.fixture(scope="module")
def scored(spark):
    turns = spark.createDataFrame([(c, t, f"p{t}", "fine answer that says quite a lot. Yes." if c else "no") for c in range(4) for t in (2, 4, 6)], "conv_id long, turn long, prompt string, response string")
    return feedback.flag_bad(feedback.evaluate_responses(turns)).persist()


def test_queue_whatever_the_arrival(spark, scored, tmp_path):
    rng = random.Random(1)
    votes = [(i, rng.randrange(6), rng.choice([2, 4, 6]), rng.choice([1, 1, -1]), None, "r", 1_700_000_000 + 60 * i) for i in range(240)]
    votes = [(*v[:4], f"p{v[2]}", *v[5:]) for v in votes]
    frame = lambda rows: spark.createDataFrame(rows, VOTE.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batch = feedback.failed_queue(frame(votes), scored)
    want = sorted(map(repr, batch.select("conv_id", "turn", "prompt", "response", "composite_score", "grade", "failure_reasons", "source", "resolved", "vote_id").collect()))
    mixed = votes[:]
    for a in range(0, 240, 80):  # any order within 80 minutes, in several files
        part = mixed[a : a + 80]
        rng.shuffle(part)
        mixed[a : a + 80] = part
    files = [frame(mixed[a : a + 40]) for a in range(0, 240, 40)]
    files[2] = files[2].union(frame([(None, 1, 2, -1, "p2", "r", 1_700_000_000), (999, 1, 2, -1, "p2", "r", None), (998, 1, 2, None, "p2", "r", 1_700_000_000), (997, 1, 2, 7, "p2", "r", 1_700_000_000)]))
    sink = streams.upsert_sink(f"{tmp_path}/out")
    start = lambda s: keyed.downvoted(s, "2 hours").writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    fed(spark, tmp_path, files, start)
    assert queue_of(spark, tmp_path, scored) == want
    # a batch writes the rows that it changes, and none that stay
    rows = spark.read.parquet(f"{tmp_path}/out")
    steps = rows.groupBy("conv_id", "prompt").agg(F.array_sort(F.collect_list(F.struct("batch", "turn", "response", "vote_id", "resolved"))).alias("r")).collect()
    assert all(a[1:] != b[1:] for s in steps for a, b in zip(s.r, s.r[1:])) and rows.count() < 0.5 * 240


MESSAGE = "conv_id long, turn long, role string, text string, s long"
TALK = [(c, t, ("user", "assistant", "system")[t % 3], f"I love thing{t % 7}{c}. My name is Bob{'abcdefgh'[t % 8]}. And more of it?", 1_700_000_000 + 30 * t) for c in range(5) for t in range(1, 40 - c)]


def memories(spark, path, files, **options):
    rows = [streams.with_lines_and_facts(spark.createDataFrame(f, MESSAGE).withColumn("ts", F.timestamp_seconds("s"))) for f in files]
    sink = streams.upsert_sink(f"{path}/out")
    start = lambda s: keyed.session_memory(s, 2, 4, 300, 400, **options).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    fed(spark, path, rows, start)
    return {r.conv_id: r for r in streams.latest(spark, f"{path}/out", ["conv_id"]).collect()}


def test_memory_whatever_the_arrival(spark, tmp_path):
    rows = TALK[:]
    random.Random(2).shuffle(rows)
    got = memories(spark, tmp_path, [rows[a::3] for a in range(3)], late="1 hour")
    conv = spark.createDataFrame(TALK, MESSAGE).drop("s")
    window = {r.conv_id: r.w for r in memory.memory_window(conv, 2, 4).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("w")).collect()}
    summary = {r.conv_id: r.rolling_summary for r in memory.rolling_summary(conv, 2, 4, 300, 400).collect()}
    facts = {}
    for r in memory.key_info_state(conv).orderBy("category").collect():
        facts.setdefault(r.conv_id, []).append(f"{r.category}: {', '.join(r.vals)}")
    assert len(got) == 5
    for c, r in got.items():
        assert (r.total_turns, r.window_turns, r.rolling_summary, r.facts) == (39 - c, window[c], summary[c], facts[c])


def test_memory_drops_late_rows_and_forgets_idle_conversations(spark, tmp_path):
    at = lambda c, t, minute: (c, t, "user", "I like tea.", 1_700_000_000 + 60 * minute)
    files = [[at(1, 1, 0), at(2, 1, 0)], [at(1, 2, 200)], [at(1, 3, 201), at(2, 2, 5)], [at(2, 3, 202)]]
    files[1] += [(None, 1, None, None, 1_700_000_000 + 12_000), (None, 2, "user", None, 1_700_000_000 + 12_000), (1, None, "user", "no turn", 1_700_012_000), (1, 9, "user", "no time", None)]
    got = memories(spark, tmp_path, files, late="10 minutes", idle_seconds=3600)
    assert got[1].window_turns[-1] == 3 and got[None].total_turns == 2 and got[None].facts == []
    assert got[2].total_turns == 1 and got[2].window_turns == [3]  # turn 2 came too late; turn 1 was forgotten


def test_ingest_by_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, "No id. " * 9, "src1"), (-1, None, None), (-2, "", "src1"), (-3, "Twice here, and long enough to be kept.", "src1"), (-3, "Twice here, and long enough to be kept.", "src1")], docs.schema)
    apply = streams.ingest_sink(f"{tmp_path}/kb")
    parts = [docs.filter(f"pmod(doc_id, 3) = {i}") for i in range(3)]
    for n, part in enumerate([parts[0], parts[1].union(odd), parts[1].union(parts[2]), odd]):
        apply(part, n)
    apply(parts[1].union(parts[2]), 2)  # a batch that is repeated after a failure
    rows = lambda df: sorted(map(repr, df.select("doc_id", "source", "chunk_index", "text").collect()))
    got = rows(spark.read.parquet(f"{tmp_path}/kb/chunks"))
    assert got == rows(corpus.ingest(docs.union(odd.distinct())))
    changed = docs.limit(1).withColumn("text", F.lit("A new text of a known document, long enough to be a chunk."))
    apply(changed, 4)
    assert spark.read.parquet(f"{tmp_path}/kb/chunks/batch=4").count() == 1


def test_late_events_join_sessions_that_ended(spark, tmp_path):
    at = lambda user, minute: (user, 1_700_000_000 + 60 * minute)
    # after minute 80 the mark stands at 70: the event of minute 30 isn't late and joins the session that ended at 60; that of minute 5 is late
    files = [[at(1, 0)], [at(2, 80), (4, None)], [at(1, 30), at(3, 5)], [at(2, 300)]]
    frames = [spark.createDataFrame(f, "user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s") for f in files]
    fed(spark, tmp_path, frames, lambda s: streams.run_to_end(streams.session_activity(s, late="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    rows = spark.read.parquet(f"{tmp_path}/out").select("user_id", *(((F.unix_seconds(c) - 1_700_000_000) / 60).cast("int") for c in ("started_at", "ends_at")), "n_events").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 90, 2), (2, 80, 140, 1)]


def test_session_query_where_late_events_are_kept(spark, tmp_path):
    rng = random.Random(3)
    hour = 3_600_000_000
    events = [(rng.choice([1, 2, 3, None]), rng.randrange(90 * hour)) for _ in range(300)]
    events += [(rng.randrange(10, 60), rng.randrange(86 * hour, 90 * hour)) for _ in range(200)]  # late events of the last two hours still count
    events = [(i, user, 1_700_000_000_000_000 + us) for i, (user, us) in enumerate(events)] + [(500, 1, None)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, us long").selectExpr("event_id", "user_id", "cast(timestamp_micros(us) as timestamp_ntz) as ts")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["session_activity"](spark, str(tmp_path)).select("user_id", "started_at", "ends_at", "n_events").collect()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select user_id, started_at, ends_at, n_events from ({registry.ORACLES['session_activity']}) z").fetchall()
    assert len(want) > 100 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
