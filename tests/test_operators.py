"""Golden rows and properties that SQL can't express."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from dialogmill import registry
from dialogmill.functions import text as X, udfs
from dialogmill.operators import corpus, feedback, memory, responses, scoring, vectors
from dialogmill.operators.blocks import build_cells
from dialogmill.plans import base
from dialogmill.sources import readers, writers
from dialogmill.streaming import streams

SF = "/root/testdata/sf0.001"


def plain_chunks(ss, size, overlap, least):
    out, buf, n = [], [], 0
    for s in ss:
        if buf and n + len(s) + 1 > size:
            out.append(" ".join(buf))
            keep, k = [], 0
            for x in reversed(buf):
                if k + len(x) > overlap:
                    break
                keep.insert(0, x)
                k += len(x) + 1
            buf, n = keep, k
        buf.append(s)
        n += len(s) + 1
    return [t for t in out + ([" ".join(buf)] if buf else []) if len(t) >= least]


def plain_sentences(t):
    t = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t.replace("\r\n", "\n"))).strip()
    return [s.strip() for s in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s", t) if s.strip()]


def test_chunk_sentences(spark):
    rng = random.Random(4)
    texts = ["", "One.", "x" * 900 + ". Tail here.", "Dr. Who came. U.S.A. is big. It is 3.14. " * 30, "a.\nb! c? " * 99, "tiny. " + "w " * 250 + "end. Short."]
    texts += [" ".join("w" * rng.randint(1, 40) + rng.choice([".", "!", ",", "?"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    for size, overlap, least in ((400, 80, 30), (100, 40, 10)):
        got = {}
        for r in corpus.chunk_sentences(df, size, overlap, least).orderBy("doc_id", "chunk_index").collect():
            assert r.chunk_index == len(got.setdefault(r.doc_id, []))
            got[r.doc_id].append(r.text)
        for i, t in enumerate(texts):
            assert got.get(i, []) == plain_chunks(plain_sentences(t), size, overlap, least)
    rows = corpus.chunk_sentences(df).collect()
    for r in rows:
        normal = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", texts[r.doc_id].replace("\r\n", "\n"))).strip()
        assert " ".join(normal[r.char_start : r.char_end].split()) == " ".join(r.text.split())
    with pytest.raises(ValueError):
        corpus.chunk_sentences(df, 80, 80)


def test_json_text(spark):
    rows = [
        ('{"b": {"text": "deep"}, "text": "top", "n": 3, "content": "c"}', "top\nc\ndeep"),
        ('["x", {"text": "y"}, 4, [["z"]]]', "x\ny\nz"),
        ("{bad", None),
        (None, None),
        ('{"text": 5}', ""),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "text string").coalesce(1)
    assert [r.json_text for r in corpus.extract_json_text(df, ["text", "content"]).collect()] == [r[1] for r in rows]


def test_window_equals_simulation(spark):
    for w, a, n in ((2, 4, 17), (8, 12, 31), (4, 6, 20), (3, 2, 9), (8, 12, 5)):
        held, batch, gone = [], 0, {}
        for i in range(1, n + 1):
            held.append(i)
            if len(held) > a and len(held) > w:
                for x in held[: len(held) - w]:
                    gone[x] = batch
                held, batch = held[len(held) - w :], batch + 1
        df = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(1, n + 1)], "conv_id long, turn long, role string, text string")
        got = {r.turn: (r.in_window, r.batch) for r in memory.eviction_batches(df, w, a).collect()}
        assert got == {i: (i in held, gone.get(i)) for i in range(1, n + 1)}


def test_rolling_summary_and_facts(spark):
    rows = [(1, i, "user", f"I love thing{i if i < 7 else i - 7} so much, and " + "z" * 190) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    s = memory.rolling_summary(df, 2, 4).collect()[0].rolling_summary
    assert s.startswith("…") and len(s) == 1801
    vals = memory.key_info_state(spark.createDataFrame([(1, i, "user", f"I love {w}.") for i, w in enumerate("abcdefa")], df.schema)).collect()[0].vals
    assert vals == ["c", "d", "e", "f", "a"]


def test_sigmoid_table(spark):
    df = spark.createDataFrame([(x,) for x in (-3, -1, 0, 1, 3)], "x int")
    assert [round(r[0], 3) for r in df.select(feedback.sigmoid(F.col("x"))).collect()] == [0.047, 0.269, 0.5, 0.731, 0.953]


def test_recovery_order(spark):
    votes = spark.createDataFrame([(1, 7, 1, -1, "p", "r"), (2, 7, 1, 1, "p", "r"), (3, 7, 1, 1, "p", "r"), (4, 8, 1, 1, "q", "r"), (5, 8, 1, -1, "q", "r")], "vote_id long, conv_id long, turn long, vote int, prompt string, response string")
    failed = spark.createDataFrame([(7, "user", False, 1), (8, "user", False, 5), (7, "auto", False, None)], "conv_id long, source string, resolved boolean, vote_id long")
    got = {(r.conv_id, r.source): r.resolved for r in feedback.resolve_recovered(failed, votes).collect()}
    assert got == {(7, "user"): True, (8, "user"): False, (7, "auto"): False}


def test_priority(spark):
    failed = spark.createDataFrame([(1, None), (2, 0.0), (3, 0.2)], "conv_id long, composite_score double")
    votes = spark.createDataFrame([(3, -1), (3, -1), (2, -1)], "conv_id long, vote int")
    got = {r.conv_id: r.priority_score for r in feedback.priority_score(failed, votes).collect()}
    assert got == {1: 0.3, 2: 0.5, 3: 0.88}
    none = {r.conv_id: r.priority_score for r in feedback.priority_score(failed, votes.filter("vote = 1")).collect()}
    assert none == {1: 0.3, 2: 0.3, 3: 0.48}


def test_mmr_limits(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("kv"))
    q = e.filter("id < 5").select(F.col("id").alias("query_id"), F.col("kv").alias("qv"))
    kb = e.filter("id >= 5")
    top = vectors.nearest(q, kb, 12).join(kb, "id").select("query_id", "id", "rank", F.col("score").alias("rel"), F.col("kv").alias("v"))
    first = {(r.query_id, r.rank): r.id for r in top.collect()}
    assert all(first[(r.query_id, r.rank)] == r.id for r in vectors.mmr(top, 4, 1.0).collect())
    assert vectors.mmr(top.filter("rank <= 3"), 4, 0.0).count() == 15


def test_refine_examples(spark):
    df = spark.createDataFrame(
        [
            ("Okay so user: hello there my friend", "general"),
            ("As an AI, I think. Certainly! It works. It works.", "complaint"),
            ("", "general"),
            (None, "coding"),
            ("No. ```py\nx={", "coding"),
        ],
        "response string, category string",
    ).coalesce(1)
    rows = responses.refine(scoring.validate_response(df)).collect()
    assert rows[0].refined == "Sure — so hello there my friend."
    assert "Markdown code block is not properly closed." in rows[4].issues and not rows[4].passed
    one = df.limit(1).select(responses.dedup_sentences(F.lit("A b. a B! ?! C.")).alias("x"), responses.polish_tone(F.lit(", certainly! fine  day")).alias("y"), scoring.simple_intent(F.lit("this")).alias("z")).first()
    assert (one.x, one.y, one.z) == ("A b. C.", "Fine day", "greeting")


def test_failure_reasons(spark):
    df = spark.createDataFrame([("hi", "  "), ("q", "user: x"), ("w", "a b c d e f. " * 90)], "prompt string, response string").coalesce(1)
    rows = scoring.flag_bad(scoring.evaluate_responses(df)).collect()
    assert rows[0].failure_reasons == ["Empty response"]
    assert any("Role leakage" in x for x in rows[1].failure_reasons) and any("Truncated" in x for x in rows[1].failure_reasons)
    assert any("540 words" in x for x in rows[2].failure_reasons)


def test_files(spark, tmp_path):
    d = tmp_path / "kb" / "deep"
    d.mkdir(parents=True)
    (d / "a.TXT").write_text("plain")
    (d / "b.md").write_text("# T\n**x** [l](u)")
    (d / "c.json").write_text('{"text": "j"}')
    (d / "bad.json").write_text("{")
    (d / "e.jsonl").write_text('{"text": "1"}\n\nbad\n{"text": "2"}\n')
    (d / "f.bin").write_text("no")
    got = {r.source: r.text for r in readers.read_corpus_dir(spark, str(tmp_path / "kb")).collect()}
    assert got == {"a.TXT": "plain", "b.md": "T\nx l", "c.json": "j", "e.jsonl": "1\n2"}
    assert readers.read_corpus_dir(spark, str(tmp_path / "kb"), [".MD"]).count() == 1
    assert readers.read_text_docs(spark, str(d / "a.TXT")).first().text == "plain"
    assert readers.read_markdown_docs(spark, str(d / "b.md")).first().text == "T\nx l"
    assert readers.read_json_docs(spark, str(d / "c.json")).first().text == "j"
    assert readers.read_jsonl_docs(spark, str(d / "e.jsonl")).first().text == "1\n2"
    (tmp_path / "cases.json").write_text('{"metadata": {}, "test_cases": [{"id": "1", "prompt": "p", "expected_keywords": ["k"]}]}')
    assert readers.read_eval_cases(spark, str(tmp_path / "cases.json")).first().prompt == "p"
    (tmp_path / "list.json").write_text('[{"id": "1", "prompt": "p"}]')
    assert readers.read_eval_cases(spark, str(tmp_path / "list.json")).count() == 1
    (tmp_path / "none.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        readers.read_eval_cases(spark, str(tmp_path / "none.json"))
    (tmp_path / "sc.json").write_text('{"s": [{"turn": 1, "user": "u", "bot": "b"}, {"turn": 2, "user": "v", "bot": "c"}]}')
    assert readers.read_scenario_results(spark, str(tmp_path / "sc.json")).count() == 2
    log = spark.createDataFrame([("e1", "r1", True), ("e2", "r1", False), ("e3", "r2", True)], "eval_id string, run_id string, is_bad_response boolean")
    writers.append_eval_log(log, str(tmp_path / "log"))
    assert readers.read_eval_log(spark, str(tmp_path / "log" / "eval_log"), "r1").count() == 2
    assert readers.read_eval_log(spark, str(tmp_path / "log" / "bad_responses")).count() == 2
    bad = spark.createDataFrame([("e1", 'say "hi"\n, ok', "r", 0.1, "F", ["a", "b"])], "eval_id string, prompt string, response string, composite_score double, grade string, failure_reasons array<string>")
    writers.write_review_csv(bad, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.prompt == 'say "hi"\n, ok' and back.failure_reasons == "a; b"
    writers.append_chunks(bad, str(tmp_path / "kb2"))
    writers.append_chunks(bad, str(tmp_path / "kb2"))
    assert spark.read.parquet(str(tmp_path / "kb2")).count() == 2
    writers.overwrite_kb_empty(bad, str(tmp_path / "kb3"))
    assert spark.read.parquet(str(tmp_path / "kb3")).count() == 0
    rows = feedback.to_messages(spark.createDataFrame([("i", "c", "r")], "instruction string, context string, response string"))
    writers.write_messages_jsonl(rows, str(tmp_path / "m"))
    lines = [x for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and json.loads(lines[0])["messages"][0]["content"] == "i\n\nContext: c"


def test_sql_surface(spark):
    names = udfs.register_sql(spark)
    assert len(names) == 10
    texts = spark.createDataFrame([(1, "One two three. " * 80 + "The end of it. " * 3), (2, None), (3, "")], "doc_id long, text string")
    own = [(r.doc_id, r.chunks) for r in texts.selectExpr("doc_id", "sentence_chunks(text, 400, 80, 30) as chunks").collect()]
    want = {}
    for r in corpus.chunk_sentences(texts).orderBy("doc_id", "chunk_index").collect():
        want.setdefault(r.doc_id, []).append(r.text)
    assert own == [(1, want[1]), (2, []), (3, [])] and len(want[1]) > 2
    rows = spark.sql("select d.doc_id, c.* from (select doc_id, trimmed_text(text) as norm, sentences_of(text) as ss from {t}) d, lateral chunks_of_text(d.norm, d.ss, 400, 80, 30) c", t=texts)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, corpus.chunk_sentences(texts).collect()))
    split = corpus.split_sentences(texts)
    rows = spark.sql("select doc_id, chunk_index, text from chunks_of_rows(table(select * from {s}), 400, 80, 30)", s=split)
    assert sorted(map(tuple, rows.collect())) == [(1, i, t) for i, t in enumerate(want[1])]
    for wrong in ("chunks_of_rows(table(select 1 as x), 400, 80, 30)", "chunks_of_rows(table(select 1 as doc_id, 1 as pos, 's' as sentence), 80, 80, 30)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"select * from {wrong}").collect()
    row = spark.sql("select redact_emails('me@site.org x') a, strip_tags('<b>x</b>&amp;') b, fixed_chunks('abcde', 2) c, normalize_spacing('a  b') d").first()
    assert (row.a, row.b, row.c, row.d) == ("[EMAIL] x", " x  ", ["ab", "cd", "e"], "a b")
    score = udfs.pair_scorer(lambda: lambda a, b: [float(len(x) + len(y)) for x, y in zip(a, b)])
    assert spark.createDataFrame([("a", "bb")], "a string, b string").select(score("a", "b")).first()[0] == 3.0
    import numpy as np

    embed = udfs.embedder(lambda: lambda texts: np.array([[float(len(t)), 1.0] for t in texts], np.float32))
    assert list(spark.createDataFrame([("abc",)], "t string").select(embed("t")).first()[0]) == [3.0, 1.0]


def test_instruction_arrays(spark, tmp_path):
    rows = spark.range(25).select(F.concat(F.lit("i"), "id").alias("instruction"), F.lit("").alias("input"), F.lit("o").alias("output")).coalesce(2)
    writers.write_instruction_json(rows, str(tmp_path / "a"), 10)
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "a").rglob("part-*") if p.suffix == ".txt"]
    assert all(1 <= len(a) <= 10 for a in arrays) and sorted(r["instruction"] for a in arrays for r in a) == sorted(f"i{k}" for k in range(25))


def test_split_keeps_all_rows(spark):
    rows = [(None, "aaaa"), (1, "b" * 10), (2, "c" * 10), (1000, "d" * 10), (10**12, None), (10**12, "e" * 10)]
    got = feedback.train_val_split(spark.createDataFrame(rows, "k long, text string"), "k", 0.6).collect()
    assert len(got) == 6 and sum(r.is_train for r in got) == 3 and {r.k for r in got if r.is_train} == {None, 1, 2}


def test_text_folds_are_linear(spark):
    """A text of four times the sentences takes about four times as long, not sixteen; and term counts of many words are quick."""
    import time

    took = []
    for n in (4_000, 16_000):
        sentences = [f"Sentence number {i} é of it." for i in range(n)]
        began = time.time()
        chunks = corpus.chunks_of(" ".join(sentences), sentences, 400, 80, 30)
        took.append(time.time() - began)
        assert chunks[-1][3] == len(" ".join(sentences)) and all(" ".join(sentences)[a:b] == t for t, _, a, b in chunks)
    assert took[1] < 10 * took[0] + 0.05
    began = time.time()
    many = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("w"), (i % 30_000).cast("string")))
    assert abs(spark.range(1).select(X.bag_cosine(many, many)).first()[0] - 1) < 1e-9 and time.time() - began < 60
    assert spark.range(1).select(X.term_counts(F.array(*map(F.lit, "bab")))).first()[0] == [("a", 1.0), ("b", 2.0)]


def test_retrieve_reranks_and_takes_cells(spark):
    kb = spark.createDataFrame([(i, [float(i % 7 == j) + 0.01 * i for j in range(7)], "s", f"t{i}") for i in range(60)], "id long, v array<double>, source string, text string")
    kb = vectors.l2_normalize(kb, "v", "kv").drop("v")
    queries = kb.filter("id < 3").select(F.col("id").alias("query_id"), F.col("kv").alias("qv"))
    index = build_cells(kb.select("id", "kv"), base.folder(spark), cells=3)
    plain, cells = (vectors.retrieve(queries, kb, 20, 2, 0.2, index=i).orderBy("query_id").collect() for i in (None, index))
    assert all(r.used_mmr and r.total_found == 20 for r in plain) and len(cells) == 3
    last = vectors.retrieve(queries, kb, 20, 1, 0.2, lambda_=1.0, scorer=F.col("id").cast("double"), others=True).collect()
    first = vectors.retrieve(queries, kb, 20, 1, 0.2, lambda_=1.0, others=True).collect()
    assert {r.query_id: r.context for r in last} != {r.query_id: r.context for r in first}


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(1, t) for t in ts], "vote int, ts string").select("vote", F.col("ts").cast("timestamp").alias("ts"))
    schema = rows("2024-01-01 00:00:00").schema
    for ts in (["2024-01-01 10:10:00"], ["2024-01-02 10:10:00"], ["2024-01-01 10:20:00", "2024-01-02 10:20:00"], ["2024-01-05 00:00:00"]):
        rows(*ts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.windowed_votes(streams.stream_of(spark, str(tmp_path / "in"), schema), "1 hour", None, "1 hour")
        streams.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {str(r.window_start): r.up for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 10:00:00": 1, "2024-01-02 10:00:00": 2}


def test_text_expressions(spark):
    row = spark.range(1).select(
        X.clean_corpus(F.lit(" a\x07\r\nb\t\tc\n\n\n\n\nd ")).alias("a"), X.strip_markdown(F.lit("## H\n- x\n1. y")).alias("b"), X.clean_instruction(F.lit(None).cast("string")).alias("c"),
        X.snippet(F.lit("abc"), 2).alias("d"), X.count_of(F.lit("aXXbXX"), "XX").alias("e"),
    ).first()
    assert tuple(row) == ("a\nb c\n\n\nd", "H\nx\ny", "", "ab…", 2)


def test_l2_normalize_query_bit_by_bit(spark, tmp_path):
    """Zero vectors, missing and non-finite components, signs of zeros, and values that two ways of rounding part."""
    nan, inf = float("nan"), float("inf")
    odd = [[0.0, 0.0], [0.0, None], [None, 3.0, 4.0], [-1e-10, 1.0], [-0.0, 1.0], [nan, 1.0], [-inf, None], [inf, 1.0], [], None, [None], [1e-30, 0.0], [3e38, 3e38]]
    odd += [[0.9676226377487183, 0.44599148631095886, -0.6343274116516113, 0.7024849057197571], [-0.24492043256759644, -0.14473073184490204, -1.6801040172576904, 1.384685754776001]]
    spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>").selectExpr("*", "0 as label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["l2_normalize"](spark, str(tmp_path)).select("id", "v").collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select id, v from ({registry.ORACLES['l2_normalize']}) z").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == len(odd)
    kept = vectors.l2_normalize(spark.createDataFrame([([0.0, 0.0],), ([None, 3.0, 4.0],)], "v array<float>"), "v", "u").collect()
    assert [list(r.u) for r in kept] == [[0.0, 0.0], [None, 0.6, 0.8]]
