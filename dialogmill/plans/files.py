"""Sources, sinks and the extension surface: files that each query writes from the tables into the shared folder, read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rules, text as X, udfs
from ..operators import corpus as C, feedback as FB
from ..sources import readers, writers
from . import duck
from .base import PAIRS, SCORED, TALK_PAIRS, folder, pairs, query, read, scored, talk_pairs
from .corpus import NORM, chunks_sql

_OPEN = "# Head\n**bold** [label](http://a.b) `code`\n"
_OPEN_SQL = duck.q(_OPEN).replace("\n", "' || chr(10) || '")


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.nz(F.col("text")).alias("text"))


def _item_id(df):
    """The number in a file's path."""
    return df.select(F.regexp_extract(F.col("metadata")["file_path"], r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text", F.col("metadata")["format"].alias("format"))


def _texts(spark, sf_dir, at, opening=""):
    """A text file an item."""
    _items(spark, sf_dir).select("item_id", F.concat(F.lit(opening), "text").alias("value")).write.partitionBy("item_id").text(at)


def _objects(spark, sf_dir, at):
    """A JSON file an item, with a nested object and a list."""
    inner = F.struct(F.lit("inside").alias("content"), F.lit(3).alias("n"))
    _items(spark, sf_dir).select("item_id", inner.alias("inner"), "text", F.array(F.lit("listed")).alias("list")).write.partitionBy("item_id").json(at)


@query("select item_id, coalesce(text, '') || chr(10) as text, 'text' as format from benchmark")
def read_text_docs(spark, sf_dir):
    _texts(spark, sf_dir, at := folder(spark))
    return _item_id(readers.read_text_docs(spark, at))


@query(f"select item_id, {duck.chain(f'{_OPEN_SQL} || coalesce(text, {duck.q(str())}) || chr(10)', rules.MARKDOWN)} as text, 'markdown' as format from benchmark")
def read_markdown_docs(spark, sf_dir):
    _texts(spark, sf_dir, at := folder(spark), _OPEN)
    return _item_id(readers.read_markdown_docs(spark, at))


_OBJECT = "concat_ws(chr(10), nullif(text, ''), 'inside', 'listed')"


@query(f"select item_id, {_OBJECT} as text, 'json' as format from benchmark")
def read_json_docs(spark, sf_dir):
    _objects(spark, sf_dir, at := folder(spark))
    return _item_id(readers.read_json_docs(spark, at, ["text", "content"]))


@query("select item_id % 8 as shard, string_agg(text, chr(10) order by item_id) as text from benchmark where text <> '' group by 1")
def read_jsonl_docs(spark, sf_dir):
    """Files of many lines: the items of a shard, in order of their ids."""
    at = folder(spark)
    rows = _items(spark, sf_dir).withColumn("shard", F.col("item_id") % 8)
    rows.repartition("shard").sortWithinPartitions("shard", "item_id").write.partitionBy("shard").json(at)
    docs = readers.read_jsonl_docs(spark, at, ["text"])
    return docs.select(F.regexp_extract(F.col("metadata")["file_path"], r"shard=(\d+)", 1).cast("long").alias("shard"), "text")


@query(f"select item_id, coalesce(text, '') || chr(10) as text, 'text' as format from benchmark union all select item_id, {_OBJECT}, 'json' from benchmark")
def read_corpus_dir(spark, sf_dir):
    at = folder(spark)
    _texts(spark, sf_dir, f"{at}/a")
    _objects(spark, sf_dir, f"{at}/b")
    return _item_id(readers.read_corpus_dir(spark, at, keys=["text", "content"]))


@query("select 'c' || item_id as id, 'cat' || item_id % 3 as category, text as prompt from benchmark")
def read_eval_cases(spark, sf_dir):
    """A file a shard, each an object that holds a list of cases."""
    at = folder(spark)
    case = F.struct(F.concat(F.lit("c"), "item_id").alias("id"), F.concat(F.lit("cat"), F.col("item_id") % 3).alias("category"), F.col("text").alias("prompt"))
    cases = read(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 16).alias("shard")).agg(F.collect_list(case).alias("test_cases"))
    cases.select("shard", F.to_json(F.struct("test_cases")).alias("value")).write.partitionBy("shard").text(at)
    return readers.read_eval_cases(spark, at).select("id", "category", "prompt")


def _log(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run"), F.col("conv_id") % 3)).withColumn("eval_id", F.concat_ws("-", "conv_id", "turn"))


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id || '-' || turn as eval_id, prompt, response, composite_score, grade, is_bad_response from scored where conv_id % 3 = 1")
def read_eval_log(spark, sf_dir):
    """One run of three."""
    writers.append_eval_log(_log(spark, sf_dir), at := folder(spark))
    return readers.read_eval_log(spark, f"{at}/eval_log", "run1").select("eval_id", "prompt", "response", "composite_score", "grade", "is_bad_response")


@query(f"with {TALK_PAIRS}, {SCORED} select 'all' as part, conv_id || '-' || turn as eval_id, composite_score from scored union all select 'bad', conv_id || '-' || turn, composite_score from scored where is_bad_response")
def append_eval_log(spark, sf_dir):
    writers.append_eval_log(_log(spark, sf_dir), at := folder(spark))
    part = lambda name, sub: readers.read_eval_log(spark, f"{at}/{sub}").select(F.lit(name).alias("part"), "eval_id", "composite_score")
    return part("all", "eval_log").union(part("bad", "bad_responses"))


@query(f'with {PAIRS} select conv_id::varchar as scenario, turn::int as turn, prompt as "user", response as bot from pairs')
def read_scenario_results(spark, sf_dir):
    """A file a shard, each mapping conversations to turns."""
    at = folder(spark)
    turn = F.struct(F.col("turn").cast("int").alias("turn"), F.col("prompt").alias("user"), F.col("response").alias("bot"))
    turns = pairs(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    maps = turns.groupBy((F.col("conv_id") % 16).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), "turns"))).alias("m"))
    maps.select("shard", F.to_json("m").alias("value")).write.partitionBy("shard").text(at)
    return readers.read_scenario_results(spark, at)


@query("select 'data: {\"conv_id\": ' || conv_id || ', \"turn\": ' || turn || '}' as line from conversations")
def read_chunk_stream(spark, sf_dir):
    at = folder(spark)
    line = F.concat(F.lit('data: {"conv_id": '), "conv_id", F.lit(', "turn": '), "turn", F.lit("}"))
    read(spark, sf_dir, "conversations").select(line.alias("value")).repartition(4).write.text(f"{at}/in")
    stream = readers.read_chunk_stream(spark, f"{at}/in")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("select doc_id, text, source from documents")
def write_jsonl(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    writers.write_jsonl(docs, at := folder(spark))
    return spark.read.schema(docs.schema).json(at)


@query(
    f"""with {TALK_PAIRS}, {SCORED} select conv_id || '-' || turn as eval_id, prompt, response as bad_response, composite_score, grade, array_to_string(failure_reasons, '; ') as failure_reasons,
coalesce(null::varchar, '') as preferred_response, '' as annotator_notes from scored where is_bad_response"""
)
def write_review_csv(spark, sf_dir):
    bad = _log(spark, sf_dir).filter("is_bad_response")
    writers.write_review_csv(bad, at := folder(spark))
    columns = "eval_id string, prompt string, bad_response string, composite_score double, grade string, failure_reasons string, preferred_response string, annotator_notes string"
    back = spark.read.schema(columns).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(at)
    return back.fillna("")


@query("select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, text from (select doc_id, i, substr(coalesce(text, ''), i * 500 + 1, 500) as text from documents, range(0, 1000) r(i) where i * 500 < length(text)) where " + duck.strip("text") + " <> ''")
def append_chunks(spark, sf_dir):
    """Two appends to one table."""
    docs, at = read(spark, sf_dir, "documents"), folder(spark)
    for odd in (0, 1):
        writers.append_chunks(C.chunk_fixed(docs.filter(F.col("doc_id") % 2 == odd)), at)
    return spark.read.parquet(at)


_MESSAGES = "[{'role': 'user', 'content': coalesce(prompt, '')}, {'role': 'assistant', 'content': response}]"


def _instructions(spark, sf_dir):
    return pairs(spark, sf_dir).select(X.nz(F.col("prompt")).alias("instruction"), F.lit("").alias("context"), "response")


@query(f"with {PAIRS} select {_MESSAGES} as messages from pairs")
def write_messages_jsonl(spark, sf_dir):
    rows = FB.to_messages(_instructions(spark, sf_dir))
    writers.write_messages_jsonl(rows, at := folder(spark))
    return spark.read.schema("messages array<struct<role:string,content:string>>").json(at)


@query("select doc_id, text from documents where doc_id % 2 = 1")
def overwrite_kb_empty(spark, sf_dir):
    """A table that is filled, cleared and filled with other rows."""
    docs, at = read(spark, sf_dir, "documents").select("doc_id", "text"), folder(spark)
    writers.append_chunks(docs.filter("doc_id % 2 = 0"), at)
    writers.overwrite_kb_empty(docs, at)
    writers.append_chunks(docs.filter("doc_id % 2 = 1"), at)
    return spark.read.parquet(at)


@query(f"with {PAIRS} select coalesce(prompt, '') as instruction, '' as input, response as output from pairs")
def write_instruction_json(spark, sf_dir):
    rows = _instructions(spark, sf_dir).select("instruction", F.col("context").alias("input"), F.col("response").alias("output"))
    writers.write_instruction_json(rows, at := folder(spark), 50)
    return spark.read.schema("instruction string, input string, output string").option("multiLine", True).json(at).select("instruction", "input", "output")


@query(f"with {TALK_PAIRS}, {SCORED} select conv_id, turn, grade, failure_reasons as issues from scored")
def append_reasoning_audit(spark, sf_dir):
    """Good and bad rows, appended apart."""
    log, at = scored(spark, sf_dir).select("conv_id", "turn", "grade", F.col("failure_reasons").alias("issues"), "is_bad_response"), folder(spark)
    for bad in (True, False):
        writers.append_reasoning_audit(log.filter(F.col("is_bad_response") == bad).drop("is_bad_response"), at)
    return spark.read.schema("conv_id long, turn long, grade string, issues array<string>").json(at)


def _lengths():
    """A stand-in for a text encoder: characters and spaces."""
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts.ravel()], np.float32)


@query("select item_id, [length(text)::double, (length(text) - length(replace(text, ' ', '')))::double] as v from benchmark where text is not null")
def pluggable_embedder(spark, sf_dir):
    v = udfs.embedder(_lengths)("text")
    return read(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", v.cast("array<double>").alias("v"))


def _nearer():
    """A stand-in for a cross-encoder: the nearer two lengths, the better."""
    return lambda a, b: [-float(abs(len(x) - len(y))) for x, y in zip(a, b)]


@query(f"with {PAIRS} select conv_id, turn, -abs(length(prompt) - length(response))::double as score from pairs where prompt is not null and response is not null")
def pluggable_scorer(spark, sf_dir):
    rows = pairs(spark, sf_dir).filter("prompt is not null and response is not null")
    return rows.select("conv_id", "turn", udfs.pair_scorer(_nearer)("prompt", "response").alias("score"))


@query(f"select doc_id, {duck.chain('text', [(rules.EMAIL, '[EMAIL]')])} as redacted, {duck.strip(duck.chain('text', rules.CONTROL))} as cleaned, greatest(1, ceil(length(text) / 500))::int as n_chunks from documents where text is not null")
def sql_functions(spark, sf_dir):
    """The rules as SQL functions. Chunks are counted: ``chunk_fixed`` returns them."""
    udfs.register_sql(spark)
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.expr("redact_emails(text)").alias("redacted"), X.strip(F.expr("clean_control(text)")).alias("cleaned"), F.expr("size(fixed_chunks(text, 500))").alias("n_chunks"))


@query(f"with recursive {chunks_sql(NORM)} select * from chunks")
def sentence_chunks_sql(spark, sf_dir):
    """Sentence chunks for SQL users: the table function, called by ``lateral``."""
    udfs.register_sql(spark)
    docs = read(spark, sf_dir, "documents")
    return spark.sql("select d.doc_id, c.* from (select doc_id, trimmed_text(text) as norm, sentences_of(text) as ss from {docs}) d, lateral chunks_of_text(d.norm, d.ss, 400, 80, 30) c", docs=docs)


@query(f"with recursive {chunks_sql(NORM)} select doc_id, chunk_index, text from chunks")
def sentence_rows_sql(spark, sf_dir):
    """The same from a table of sentences, which the table function has Spark partition and order."""
    udfs.register_sql(spark)
    rows = C.split_sentences(read(spark, sf_dir, "documents"))
    return spark.sql("select doc_id, chunk_index, text from chunks_of_rows(table(select * from {rows}), 400, 80, 30)", rows=rows)
