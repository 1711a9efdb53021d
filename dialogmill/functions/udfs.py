"""The extension surface (U*): models and scorers as Arrow UDFs, and the cleaning expressions for SQL users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Row, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import rules
from .text import SENTENCE_END


def embedder(make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 64):
    """A column function text → array<float> from a factory of a batch model; the model is made once a Python worker."""
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)


def pair_scorer(make: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A column function (query, passage) → double for ``rerank``; the model is made once a Python worker."""
    held: list = []

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        return pd.Series(held[0](a.tolist(), b.tolist()), dtype="float64")

    return score


def _sql(expr: str, steps: list[tuple[str, str]]) -> str:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(new)})"
    return expr


def register_sql(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of the cleaning rules, which expand to built-ins, and of the chunkers, of which ``sentence_chunks`` runs an Arrow UDF."""
    made = {"clean_control": rules.CONTROL, "normalize_spacing": rules.CHUNK_NORMAL, "strip_tags": rules.HTML_TAGS, "redact_emails": [(rules.EMAIL, "[EMAIL]")]}
    for name, steps in made.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns string return {_sql('t', steps)}")
    spark.sql("create or replace temporary function fixed_chunks(t string, n int) returns array<string> return transform(sequence(0, cast(floor(greatest(length(t) - 1, 0) / n) as int)), i -> substring(t, i * n + 1, n))")
    spark.udf.register("chunks_of_sentences", _sentence_chunks)
    spark.udtf.register("chunks_of_text", F.udtf(ChunksOfText))
    spark.udtf.register("chunks_of_rows", F.udtf(ChunksOfRows))
    cut = f"transform(split(normalize_spacing(coalesce(t, '')), r'{SENTENCE_END}'), s -> regexp_replace(s, r'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+\\z', ''))"
    trimmed = r"regexp_replace(normalize_spacing(coalesce(t, '')), r'^[\s\p{Z}]+|[\s\p{Z}]+\z', '')"
    spark.sql(f"create or replace temporary function trimmed_text(t string) returns string return {trimmed}")
    spark.sql(f"create or replace temporary function sentences_of(t string) returns array<string> return filter({cut}, s -> s <> '')")
    spark.sql("create or replace temporary function sentence_chunks(t string, size int, overlap int, least int) returns array<string> return chunks_of_sentences(trimmed_text(t), sentences_of(t), size, overlap, least)")
    return [*made, "fixed_chunks", "trimmed_text", "sentences_of", "sentence_chunks", "chunks_of_text", "chunks_of_rows"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sentence_chunks(norm: pd.Series, sentences: pd.Series, size: pd.Series, overlap: pd.Series, least: pd.Series) -> pd.Series:
    from ..operators.corpus import chunks_of

    return pd.Series([[c[0] for c in chunks_of(*row)] for row in zip(norm, map(list, sentences), size, overlap, least)])


_CHUNK = T.StructType().add("chunk_index", T.IntegerType()).add("text", T.StringType()).add("first_sentence", T.IntegerType()).add("char_start", T.IntegerType()).add("char_end", T.IntegerType())


def _checked(size: AnalyzeArgument, overlap: AnalyzeArgument) -> None:
    if size.isConstantExpression and overlap.isConstantExpression and overlap.value >= size.value:
        raise ValueError("overlap must be smaller than size")


class ChunksOfText:
    """``from (select trimmed_text(text) as norm, sentences_of(text) as ss from docs) d, lateral chunks_of_text(d.norm, d.ss, 400, 80, 30)``: a row a chunk."""

    @staticmethod
    def analyze(norm: AnalyzeArgument, sentences: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        _checked(size, overlap)
        return AnalyzeResult(_CHUNK)

    def eval(self, norm: str, sentences: list[str], size: int, overlap: int, least: int) -> Iterator[tuple]:
        from ..operators.corpus import chunks_of

        for i, chunk in enumerate(chunks_of(norm or "", list(sentences or []), size, overlap, least)):
            yield i, *chunk


class ChunksOfRows:
    """``from chunks_of_rows(table(sentences), 400, 80, 30)``: rows (doc_id, pos, sentence), which Spark partitions by doc_id and orders by pos as ``analyze``
    asks; doc_id and the chunks of each, with offsets in the sentences joined by single spaces."""

    def __init__(self):
        self.doc_id, self.sentences, self.sizes = None, [], None

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"doc_id", "pos", "sentence"} <= set(rows.dataType.names):
            raise ValueError("the first argument must be a table with doc_id, pos and sentence")
        _checked(size, overlap)
        schema = T.StructType([T.StructField("doc_id", rows.dataType["doc_id"].dataType), *_CHUNK.fields])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("pos")])

    def eval(self, row: Row, size: int, overlap: int, least: int) -> None:
        self.doc_id, self.sizes = row["doc_id"], (size, overlap, least)
        if row["sentence"]:
            self.sentences.append(row["sentence"])

    def terminate(self) -> Iterator[tuple]:
        from ..operators.corpus import chunks_of

        if self.sizes:
            for i, chunk in enumerate(chunks_of(" ".join(self.sentences), self.sentences, *self.sizes)):
                yield self.doc_id, i, *chunk
