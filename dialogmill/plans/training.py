"""Fine-tuning data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import feedback as FB
from ..sources import readers
from . import duck
from .base import TALK_PAIRS, query, read, talk_pairs

_ROWS = "rows as (select conv_id * 100 + turn as id, prompt as instruction, case when turn % 2 = 1 then 'ctx ' || turn else '' end as context, response from pairs)"


def _rows(spark, sf_dir):
    return talk_pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("prompt").alias("instruction"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("ctx "), F.col("turn"))).otherwise("").alias("context"), "response")


_USER = "instruction || case when context <> '' then chr(10) || chr(10) || 'Context: ' || context else '' end"


@query(f"with {TALK_PAIRS}, {_ROWS} select id, unnest(['user', 'assistant']) as role, unnest([{_USER}, response]) as content from rows")
def to_messages(spark, sf_dir):
    return FB.to_messages(_rows(spark, sf_dir)).select("id", F.inline("messages"))


_PROMPTS = "[" + ", ".join(map(duck.q, rules.SYSTEM_PROMPTS)) + "]"


@query(f"with {TALK_PAIRS}, {_ROWS} select id, unnest(['system', 'user', 'assistant']) as role, unnest([{_PROMPTS}[1 + id % 3], {_USER}, response]) as content from rows")
def inject_system(spark, sf_dir):
    return FB.inject_system(FB.to_messages(_rows(spark, sf_dir)), F.col("id")).select("id", F.inline("messages"))


@query(f"with {TALK_PAIRS}, {_ROWS} select id, instruction from rows order by id limit 100")
def sample_n(spark, sf_dir):
    return FB.sample_n(_rows(spark, sf_dir), 100, "id").select("id", "instruction")


@query("select doc_id, source from documents order by doc_id limit 150")
def take_split(spark, sf_dir):
    """The first rows of a split, as a training job takes them."""
    return FB.sample_n(read(spark, sf_dir, "documents"), 150, "doc_id").select("doc_id", "source")


_CLEAN = lambda c: duck.strip(duck.chain(f"coalesce({c}, '')", rules.INSTRUCTION))


@query(f"with {TALK_PAIRS}, {_ROWS} select {_CLEAN('instruction')} as instruction, {_CLEAN('context')} as context, {_CLEAN('response')} as response from rows")
def read_instruction_rows(spark, sf_dir):
    return readers.read_instruction_rows(_rows(spark, sf_dir))


@query(f"with {TALK_PAIRS} select conv_id, turn, case when turn % 3 = 0 then '' else 'Human: ' || prompt end || chr(10) || chr(10) || 'Assistant: ' as prompt, response as chosen, 'no' as rejected from pairs")
def split_preference(spark, sf_dir):
    mark = rules.ASSISTANT_MARK
    head = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Human: "), "prompt", F.lit(mark)))
    rows = talk_pairs(spark, sf_dir).select("conv_id", "turn", F.concat(head, "response").alias("chosen"), F.concat(head, F.lit("no")).alias("rejected"))
    return FB.split_preference(rows).select("conv_id", "turn", "prompt", "chosen", "rejected")


@query(f"with {TALK_PAIRS} select conv_id, turn, '<s>[INST] ' || prompt || ' [/INST] ' || response || ' </s>' as text from pairs")
def to_inst_text(spark, sf_dir):
    return FB.to_inst_text(talk_pairs(spark, sf_dir)).select("conv_id", "turn", "text")


VOCAB = "chars as (select distinct unnest(string_split(text, '')) as char from conversations), vocab as (select char, (row_number() over (order by unicode(char), char) - 1)::int as id from chars where char <> '')"


def _vocab(spark, sf_dir):
    return FB.char_vocab(read(spark, sf_dir, "conversations"))


@query(f"with {VOCAB} select * from vocab")
def char_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


_IDS = f"{VOCAB}, spread as (select conv_id, turn, c, i from (select conv_id, turn, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from conversations) where c <> ''), enc as (select conv_id * 100 + turn as id, list(v.id order by i) as ids from spread s join vocab v on s.c = v.char group by all)"


def _encoded(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), "text")
    return FB.encode_chars(rows, _vocab(spark, sf_dir), "key")


@query(f"with {_IDS} select id as key, ids from enc")
def encode_chars(spark, sf_dir):
    return _encoded(spark, sf_dir)


@query("select conv_id * 100 + turn as key, text from conversations")
def decode_chars(spark, sf_dir):
    return FB.decode_chars(_encoded(spark, sf_dir), _vocab(spark, sf_dir), "key")


@query("select doc_id, sum(length(text)) over (order by doc_id) <= floor(0.9 * (select sum(length(text)) from documents)) as is_train from documents")
def train_val_split(spark, sf_dir):
    return FB.train_val_split(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "is_train")


@query(f"with {_IDS} select id as key, s::int as start, ids[s + 1 : s + 128] as x, ids[s + 2 : s + 129] as y from enc, range(0, 200000, 128) r(s) where s <= len(ids) - 129")
def block_examples(spark, sf_dir):
    return FB.block_examples(_encoded(spark, sf_dir), "key")


@query(f"with {TALK_PAIRS}, {_ROWS} select instruction, context as input, response as output from rows where context <> '' union all select instruction, '' as input, response as output from rows where context = ''")
def union_instructions(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = F.col("response").alias("output")
    return FB.union_instructions(rows.filter("context <> ''").select("instruction", F.col("context").alias("input"), out), rows.filter("context = ''").select("instruction", out))
