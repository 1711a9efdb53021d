"""Corpus cleaning, chunking, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text as X
from ..operators import corpus as C
from ..sources import readers
from . import duck
from .base import query, read

# documents with an opening that holds what the cleaning rules look for
_OPEN = "# Head\r\n\x07**bold** [label](http://a.b) `code` ![i](u)  two\t blanks\n\n\n\n\n- item one <b>x</b> &amp; me@site.org\n1. first\n"
_SQL = duck.q(_OPEN).replace("\r", "' || chr(13) || '").replace("\x07", "' || chr(7) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
_DOCS = f"(select doc_id, source, {_SQL} || coalesce(text, '') as text from documents)"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit(_OPEN), X.nz(F.col("text"))))


def _text_query(name, fn, expr):
    @query(f"select doc_id, {expr('text')} as text from {_DOCS}", name=name)
    def run(spark, sf_dir):
        return C.with_text(_docs(spark, sf_dir), fn).select("doc_id", "text")


_text_query("clean_corpus", X.clean_corpus, lambda t: duck.strip(duck.chain(t, rules.CONTROL)))
_text_query("normalize_for_chunking", X.normalize_for_chunking, lambda t: duck.strip(duck.chain(t, rules.CHUNK_NORMAL)))
_text_query("strip_markdown", X.strip_markdown, lambda t: duck.chain(t, rules.MARKDOWN))
_text_query("clean_instruction_text", X.clean_instruction, lambda t: duck.strip(duck.chain(t, rules.INSTRUCTION)))
_text_query("trim_snippet", lambda c: X.snippet(c, 200), lambda t: f"case when length({t}) > 200 then substr({t}, 1, 200) || '…' else {t} end")


@query(f"select doc_id, {duck.chain('text', [(rules.EMAIL, '[EMAIL]')])} as text, len(regexp_extract_all(text, {duck.q(rules.EMAIL)}))::int as n_emails from {_DOCS}")
def redact_email(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.redact_email(F.col("text")).alias("text"), X.email_count(F.col("text")).alias("n_emails"))


@query(f"select page_id, url, {duck.chain('html', rules.HTML_TAGS)} as text from pages")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", X.html_to_text(F.col("html")).alias("text"))


def _main_sql():
    e = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for t in rules.HTML_DROPPED:
        e = f"regexp_replace({e}, '<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'gis')"
    e = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"
    for a, b in rules.HTML_ENTITIES:
        e = f"replace({e}, {duck.q(a)}, {duck.q(b)})"
    return e


@query(f"select page_id, url, {_main_sql()} as text from pages")
def html_main_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", X.html_main_text(F.col("html")).alias("text"))


@query(f"select url as source, {_main_sql()} as text, url from pages")
def read_html_pages(spark, sf_dir):
    return readers.read_html_pages(read(spark, sf_dir, "pages")).select("source", "text", F.col("metadata")["url"].alias("url"))


@query("select url as source, html as text, 'html' as format from pages")
def docs_from_rows(spark, sf_dir):
    return C.docs_from_rows(read(spark, sf_dir, "pages"), "html", "url", "html").select("source", "text", F.col("metadata")["format"].alias("format"))


@query("select item_id as doc_id, pos::int as pos, prompt from (select item_id, unnest(p) as prompt, generate_subscripts(p, 1) - 1 as pos from (select item_id, regexp_extract_all('* **Prompt**: \"' || replace(text, '\"', '') || '\"\n* **Prompt**: \"again\"', '\\* \\*\\*Prompt\\*\\*: \"([^\"]*)\"', 1) as p from benchmark))")
def extract_prompts(spark, sf_dir):
    text = F.concat(F.lit('* **Prompt**: "'), F.replace("text", F.lit('"'), F.lit("")), F.lit('"\n* **Prompt**: "again"'))
    return C.extract_prompts(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), text.alias("text")))


def sentences_sql(norm: str) -> str:
    """norms (doc_id, source, norm) and sentences (doc_id, pos from 0, sentence, a: where it begins). RE2 can't look behind: a mark is set before each white space
    behind . ? or !, and taken away behind abbreviations; the text is cut at the marks."""
    marked = rf"regexp_replace(norm, '([.?!])([\s\p{{Z}}])', '\1' || chr(1) || '\2', 'g')"
    for pattern in (r"([A-Z][a-z]\.)", r"([\p{L}\p{N}_]\.[\p{L}\p{N}_][.?!])"):
        marked = rf"regexp_replace({marked}, '{pattern}\x01', '\1', 'g')"
    return rf"""norms as (select doc_id, source, {norm} as norm from documents),
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from (select doc_id, string_split({marked}, chr(1)) as p from norms)),
placed as (select doc_id, i, {duck.strip('piece')} as sentence, (coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)
  + length(piece) - length(regexp_replace(piece, '^[\s\p{{Z}}]+', '')))::int as a from pieces),
sentences as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos, sentence, a from placed where sentence <> '')"""


def chunks_sql(norm: str, size: int = 400, overlap: int = 80, least: int = 30) -> str:
    """``sentences_sql`` and chunks (doc_id, chunk_index, text, first_sentence, char_start, char_end): a step of the recursion is a chunk, from its first sentence and
    the sentence that was too much for it, found by running sums of lengths."""
    return f"""{sentences_sql(norm)},
listed as (select doc_id, len(ss) as n, ss, aa, list_prepend(0, list_transform(range(1, len(ss) + 1), lambda i: cc[i])) as cum from
  (select doc_id, list(sentence order by pos) as ss, list(a order by pos) as aa, list(c order by pos) as cc from (select *, (sum(length(sentence) + 1) over (partition by doc_id order by pos))::int as c from sentences) group by doc_id)),
walk as (select doc_id, 0::bigint as f, coalesce(list_filter(range(1, n), lambda i: cum[i + 2] - cum[1] > {size})[1], n) as e from listed
 union all select w.doc_id, w.g, coalesce(list_filter(range(w.e + 1, d.n), lambda i: d.cum[i + 2] - d.cum[w.g + 1] > {size})[1], d.n)
 from (select x.doc_id, x.e, coalesce(list_filter(range(x.f, x.e), lambda j: y.cum[x.e + 1] - y.cum[j + 1] - 1 <= {overlap})[1], x.e) as g from walk x join listed y on x.doc_id = y.doc_id where x.e < y.n) w join listed d on w.doc_id = d.doc_id),
full_ as (select w.doc_id, f, e, array_to_string(ss[f + 1:e], ' ') as text, aa[f + 1] as char_start, aa[e] + length(ss[e]) as char_end from walk w join listed d on w.doc_id = d.doc_id),
chunks as (select doc_id, (row_number() over (partition by doc_id order by e, f) - 1)::int as chunk_index, text, f::int as first_sentence, char_start::int as char_start, char_end::int as char_end from full_ where length(text) >= {least})"""


NORM = duck.strip(duck.chain("coalesce(text, '')", rules.CHUNK_NORMAL))
_CLEAN_NORM = duck.strip(duck.chain(duck.strip(duck.chain("coalesce(text, '')", rules.CONTROL)), rules.CHUNK_NORMAL))
INGESTED = f"with recursive {chunks_sql(_CLEAN_NORM)}"


@query(f"with {sentences_sql(NORM)} select doc_id, pos, sentence from sentences")
def split_sentences(spark, sf_dir):
    return C.split_sentences(read(spark, sf_dir, "documents"))


@query(f"with recursive {chunks_sql(NORM)} select * from chunks")
def chunk_sentences(spark, sf_dir):
    return C.chunk_sentences(read(spark, sf_dir, "documents"))


@query(f"with recursive {chunks_sql(NORM)} select doc_id, chunk_index, char_start, char_end from chunks")
def chunk_offsets(spark, sf_dir):
    """Where each chunk's first sentence begins and its last one ends in the normalised text; tests hold the slices against the chunks."""
    return C.chunk_sentences(read(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "char_start", "char_end")


@query(f"{INGESTED} select c.*, n.source from chunks c join norms n on c.doc_id = n.doc_id")
def ingest(spark, sf_dir):
    return C.ingest(read(spark, sf_dir, "documents")).drop("metadata")


@query(r"select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, text from (select doc_id, i, substr(coalesce(text, ''), i * 500 + 1, 500) as text from documents, range(0, 1000) r(i) where i * 500 < length(text)) where regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+\z', '', 'g') <> ''")
def chunk_fixed(spark, sf_dir):
    return C.chunk_fixed(read(spark, sf_dir, "documents"))


@query("select source, sum(greatest(1, ceil(length(text) / 500)))::bigint as n_chunks from documents where length(text) > 0 group by rollup(source)")
def chunk_counts(spark, sf_dir):
    """Fixed chunks per source; no document of the table ends in a blank chunk."""
    docs = read(spark, sf_dir, "documents")
    return C.chunk_counts(C.chunk_fixed(docs).join(docs.select("doc_id", "source"), "doc_id"))


@query("select event_id, concat_ws(chr(10), nullif(event_type, ''), nullif(props, ''), nullif(event_type, ''), nullif(props, '')) as json_text from events")
def extract_json_text(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("text"), F.struct(F.col("props").alias("content")).alias("inner"), F.array(F.col("event_type"), F.col("props")).alias("list"))).alias("text"))
    return C.extract_json_text(rows, ["text", "content", "body"]).select("event_id", "json_text")


@query("select doc_id, source from documents where source not in ('src0', 'src3')")
def drop_ingested(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return C.drop_ingested(docs, docs.filter(F.col("source").isin("src0", "src3")).select("source").distinct()).select("doc_id", "source")


@query("select source, max(timestamp '2024-01-01' + to_seconds(doc_id)) as ingested_at from documents group by source")
def register_sources(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return C.register_sources(read(spark, sf_dir, "documents"), at.cast("timestamp_ntz"))


@query("select count(*) as total_vectors, count(distinct source) as total_sources, case when count(*) >= 10000 then 'ivf' else 'flat' end as index_type from documents")
def kb_stats(spark, sf_dir):
    return C.kb_stats(read(spark, sf_dir, "documents"))
