"""Streaming queries: the tables are laid out as a folder of files, streamed to the end with availableNow, and the sink is read back, so the
batch oracle applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import responses as R
from ..streaming import keyed as K, streams as Z
from . import duck
from .corpus import INGESTED
from .evaluation import AUDIT
from .base import QUEUE, SCORED, TALK, TALK_PAIRS, VOTES, folder, query, read, scored, talk, talk_pairs, votes
from .memory import A, BATCHES, FACTS, W


def _streamed(spark, df, files: int = 4):
    """The rows as a stream of ``files`` files, and a folder for its sink and checkpoint."""
    at = folder(spark)
    df.repartition(files).write.parquet(f"{at}/in")
    return Z.stream_of(spark, f"{at}/in", df.schema, maxFilesPerTrigger="2"), at


def _sliced(spark, df, last):
    """Rows (with ``slice``, from 0 to ``last``) as a stream that brings one slice a batch, in order, and a folder for its sink and checkpoint."""
    at = folder(spark)
    df.write.partitionBy("slice").parquet(f"{at}/slices")
    rows = df.drop("slice")
    for n in range(last + 1):
        spark.read.schema(df.schema).parquet(f"{at}/slices").filter(F.col("slice") == n).drop("slice").coalesce(1).write.mode("append").parquet(f"{at}/in")
    return Z.stream_of(spark, f"{at}/in", rows.schema, maxFilesPerTrigger="1"), at


def _start(stream, sink, at, mode="update"):
    with K.keyed_state(stream.sparkSession):
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()


@query(f"with {VOTES} select conv_id, turn, sum(vote)::bigint as net from votes group by all")
def stream_net_scores(spark, sf_dir):
    stream, at = _streamed(spark, votes(spark, sf_dir).select("conv_id", "turn", "vote"))
    Z.collect_batches(Z.net_scores(stream), f"{at}/out", f"{at}/cp", "update")
    return Z.latest(spark, f"{at}/out", ["conv_id", "turn"])


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, composite_score, grade, is_bad_response from scored")
def stream_scores(spark, sf_dir):
    stream, at = _streamed(spark, talk_pairs(spark, sf_dir))
    Z.run_to_end(Z.scores(stream), f"{at}/out", f"{at}/cp")
    return spark.read.parquet(f"{at}/out").select("conv_id", "turn", "composite_score", "grade", "is_bad_response")


@query(f"with {AUDIT} select conv_id, turn, category, issues, not passed as was_refined from valid")
def audit_stream(spark, sf_dir):
    stream, at = _streamed(spark, talk_pairs(spark, sf_dir))
    Z.run_to_end(Z.audit(stream), f"{at}/out", f"{at}/cp")
    return spark.read.parquet(f"{at}/out")


# ---- late rows ----
# A row's batch is the sixth of the whole time that it lies in, but every seventh row comes three batches later. In a batch, rows are dropped
# whose window has ended at the watermark of the batch before: the greatest time up to the batch before that one, less LATE. In the end
# windows up to the greatest time of all less LATE have been closed and given out, once each.
SLICES, LATE = 6, "1 hour"
_SLICE = "least(floor((epoch(ts) - lo) * 6 / (hi - lo)), 5)::bigint"
ARRIVED = f"""spanned as (select *, min(epoch(ts)) over () as lo, max(epoch(ts)) over () as hi from rows_),
arrived as (select *, {_SLICE} + case when id % 7 = 0 then 3 else 0 end as batch from spanned),
marks as (select b.batch, (select max(ts) from arrived a where a.batch <= b.batch - 2) - interval {LATE} as mark, (select max(ts) from arrived) - interval {LATE} as closed from (select distinct batch from arrived) b)"""


def _ends(rows):
    return rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()


def _arriving(spark, rows, ends=None, beat=None):
    """``rows`` (id, ts, ...) in the batches above; with ``beat``: and then, in a batch of its own, a row of nothing but a time, that long after the last one."""
    ends = ends or _ends(rows)
    sec = lambda c: F.unix_micros(c) / 1e6
    lo, hi = (F.lit(ends[i]).cast("timestamp") for i in (0, 1))
    batch = F.least(F.floor((sec(F.col("ts")) - sec(lo)) * SLICES / (sec(hi) - sec(lo))), F.lit(SLICES - 1)) + F.when(F.col("id") % 7 == 0, 3).otherwise(0)
    sliced, last = rows.withColumn("slice", batch.cast("int")), SLICES + 2
    if beat:
        last += 1
        sliced = sliced.unionByName(rows.agg((F.max("ts") + F.expr(f"interval {beat}")).alias("ts"), F.lit(last).alias("slice")), allowMissingColumns=True)
    return _sliced(spark, sliced, last)


@query(
    f"""with rows_ as (select event_id as id, user_id, ts from events), {ARRIVED},
kept as (select a.* from arrived a join marks m using (batch) where m.mark is null or a.ts + interval 1 hour > m.mark),
e as (select user_id, ts, case when ts > lag(ts) over w + interval 1 hour or lag(ts) over w is null then 1 else 0 end as fresh from kept window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from e),
g as (select user_id, min(ts) as started_at, max(ts) + interval 1 hour as ends_at, count(*) as n_events from s group by user_id, session)
select * from g where ends_at <= (select max(closed) from marks)"""
)
def session_activity(spark, sf_dir):
    """Closed sessions, without the rows that came too late. A session waits one gap longer than its end, for rows that may still join it, so the
    source's last sign of life comes one gap (and the millisecond that watermarks are cut to) after the last row."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = _ends(rows)
    stream, at = _arriving(spark, rows, ends, "1 hour 1 millisecond")
    Z.run_to_end(Z.session_activity(stream, late=LATE), f"{at}/out", f"{at}/cp")
    found = spark.read.parquet(f"{at}/out").filter(F.col("ends_at") <= F.lit(ends.hi).cast("timestamp") - F.expr(f"interval {LATE}"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ends_at")})


def _windows(spark, sf_dir, slide):
    v = votes(spark, sf_dir).select(F.col("vote_id").alias("id"), "vote", F.col("ts").cast("timestamp").alias("ts"))
    stream, at = _arriving(spark, v)
    Z.run_to_end(Z.windowed_votes(stream, "1 hour", slide, LATE), f"{at}/out", f"{at}/cp")
    return spark.read.parquet(f"{at}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _windows_sql(start, steps):
    return f"""with {VOTES}, rows_ as (select vote_id as id, vote, ts from votes), {ARRIVED},
opened as (select a.vote, {start} as window_start, m.mark from arrived a join marks m using (batch), range(0, {steps}) r(k))
select window_start, count(*) filter (vote = 1) as up, count(*) filter (vote = -1) as down from opened where (mark is null or window_start + interval 1 hour > mark)
  and window_start + interval 1 hour <= (select max(closed) from marks) group by 1"""


@query(_windows_sql("date_trunc('hour', a.ts)", 1))
def windowed_votes(spark, sf_dir):
    """Closed windows, without the votes that came too late."""
    return _windows(spark, sf_dir, None)


@query(_windows_sql("time_bucket(interval '15 minutes', a.ts) - k * interval '15 minutes'", 4))
def sliding_votes(spark, sf_dir):
    return _windows(spark, sf_dir, "15 minutes")


@query(f"with {QUEUE} select conv_id, turn, source, resolved, grade from queue")
def stream_failed_queue(spark, sf_dir):
    """Votes come a quarter of the time at a time, each quarter in any order."""
    rows = votes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    quarter = F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(3))
    stream, at = _sliced(spark, rows.withColumn("slice", quarter.cast("int")), 3)
    _start(K.downvoted(stream), Z.upsert_sink(f"{at}/out"), at)
    rows = Z.failed_queue(Z.latest(spark, f"{at}/out", ["conv_id", "prompt"]), scored(spark, sf_dir))
    return rows.select("conv_id", "turn", "source", "resolved", "grade")


@query(
    f"""with {TALK}, {BATCHES}, {FACTS}, w as (select conv_id, list(turn order by rn) as window_turns, max(n) as total_turns from evict where in_window group by conv_id),
s as (select conv_id, string_agg(summary, chr(10) order by batch) as rolling_summary from batches group by conv_id),
firsts as (select conv_id, category, value, min((turn, k, pos)) as spot from facts group by all),
lines as (select conv_id, category || ': ' || string_agg(value, ', ' order by spot) as line from firsts group by conv_id, category),
f as (select conv_id, list(line order by line) as facts from lines group by conv_id)
select w.conv_id, total_turns::bigint as total_turns, window_turns, coalesce(rolling_summary, '') as rolling_summary, coalesce(f.facts, []) as facts from w left join s on w.conv_id = s.conv_id left join f on w.conv_id = f.conv_id"""
)
def stream_memory(spark, sf_dir):
    """A conversation's messages, a minute apart, are spread over files in any order."""
    at = folder(spark)
    timed = talk(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60))
    rows = Z.with_lines_and_facts(timed)
    rows.repartition(4, F.xxhash64("conv_id", "turn")).write.parquet(f"{at}/in")
    stream = Z.stream_of(spark, f"{at}/in", rows.schema, maxFilesPerTrigger="1")
    _start(K.session_memory(stream, W, A, late="1 hour"), Z.upsert_sink(f"{at}/out"), at)
    return Z.latest(spark, f"{at}/out", ["conv_id"])


@query(f"{INGESTED} select c.doc_id, n.source, chunk_index, text from chunks c join norms n on c.doc_id = n.doc_id")
def stream_ingest(spark, sf_dir):
    """The corpus arrives in four parts, each with documents of every source; one part comes again. The result is the chunks of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    parts = docs.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int"))
    again = parts.filter("slice = 1").withColumn("slice", F.lit(4))
    stream, at = _sliced(spark, parts.union(again), 4)
    _start(stream, Z.ingest_sink(f"{at}/kb"), at, "append")
    return spark.read.parquet(f"{at}/kb/chunks").select("doc_id", "source", "chunk_index", "text")


# ---- server-sent lines made from the conversations: each answer word by word ----
_EVERY = r"[^ ]+ ?| "


def _chunks(spark, sf_dir):
    rows = talk_pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("conv_id"), F.posexplode(F.regexp_extract_all("response", F.lit(_EVERY), F.lit(0))).alias("seq", "content"))
    start = F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id"))
    return rows.withColumn("started_at", start).withColumn("ts", F.timestamp_millis(F.lit(1700000000000) + F.col("conv_id") * 1000 + 500 + F.col("seq") * 40))


CHUNKS = f"wl as (select conv_id * 100 + turn as conv_id, regexp_extract_all(response, '{_EVERY}') as w from pairs), chunks as (select conv_id, unnest(w) as content, generate_subscripts(w, 1) - 1 as seq from wl)"


@query(f"with {TALK_PAIRS}, {CHUNKS} select conv_id, string_agg(content, '' order by seq) as response, count(*)::int as n_chunks, 0.5::double as ttft_seconds, 0.5 + max(seq) * 0.04::double as total_seconds from chunks group by conv_id", ("total_seconds",))
def assemble_responses(spark, sf_dir):
    """A response's chunks are spread over two batches, in order of the responses' starts."""
    rows = _chunks(spark, sf_dir)
    ends = rows.agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).first()
    width = (ends.hi or 0) - (ends.lo or 0) + 1
    part = F.floor((F.col("conv_id") - (ends.lo or 0)) * 4 / width)
    stream, at = _sliced(spark, rows.withColumn("slice", (part + F.col("seq") % 2).cast("int")), 4)
    Z.collect_batches(Z.assemble_responses(stream, f"{width // 2 + 60} seconds"), f"{at}/out", f"{at}/cp", "update")
    return Z.latest(spark, f"{at}/out", ["conv_id"])


@query(
    f"""with {TALK_PAIRS}, {CHUNKS}, n as (select conv_id, count(*) as n from chunks group by conv_id), stop as (select conv_id, n * 3 // 4 as e from n),
kept as (select c.conv_id, string_agg(c.content, '' order by c.seq) as t from chunks c join stop s on c.conv_id = s.conv_id and c.seq < s.e group by c.conv_id)
select s.conv_id, case when s.conv_id % 3 = 0 and s.e > 0 then 'refined ' || s.conv_id else coalesce({duck.strip("t")}, '') end as response from stop s left join kept k on s.conv_id = k.conv_id where s.e > 0"""
)
def parse_sse(spark, sf_dir):
    """[DONE] stands at three quarters of the words; every third conversation has a refined version before it; some lines are broken."""
    c = _chunks(spark, sf_dir)
    ends = c.groupBy("conv_id").agg(F.floor(F.count("*") * 3 / 4).cast("int").alias("e"))
    data = c.select("conv_id", (F.col("seq") * 10).alias("seq"), F.concat(F.lit("data: "), F.to_json(F.struct("content"))).alias("line"))
    done = ends.select("conv_id", (F.col("e") * 10 - 1).alias("seq"), F.lit("data: [DONE]").alias("line"))
    bad = ends.select("conv_id", F.lit(-5).alias("seq"), F.lit('data: {"content": ').alias("line"))
    other = ends.select("conv_id", F.lit(-6).alias("seq"), F.lit(": ping").alias("line"))
    full = ends.filter("conv_id % 3 = 0 and e > 0").select("conv_id", F.lit(-4).alias("seq"), F.concat(F.lit('data: {"refined": true, "full": "refined '), "conv_id", F.lit('"}')).alias("line"))
    got = R.parse_sse(data.union(done).union(bad).union(other).union(full))
    return got.join(ends.filter("e > 0").select("conv_id"), "conv_id")


_STOP = " or ".join(f"contains(lower(right(t, 50)), {duck.q(t)})".replace("\n", "' || chr(10) || '") for t in rules.STOP_TOKENS)


@query(
    f"""with {TALK_PAIRS}, {CHUNKS}, m as (select conv_id, seq, case when seq = 6 and conv_id % 2 = 0 then '<|user|>' else content end as content from chunks),
r as (select *, string_agg(content, '') over (partition by conv_id order by seq rows unbounded preceding) as t from m), h as (select conv_id, min(seq) as hit from r where {_STOP} group by conv_id)
select m.conv_id, coalesce(string_agg(content, '' order by seq) filter (h.hit is null or seq < h.hit), '') as text from m left join h on m.conv_id = h.conv_id group by m.conv_id"""
)
def truncate_at_stop(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("content", F.when((F.col("seq") == 6) & (F.col("conv_id") % 2 == 0), "<|user|>").otherwise(F.col("content")))
    return R.truncate_at_stop(c)
