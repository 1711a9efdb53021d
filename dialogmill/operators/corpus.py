"""Corpus cleaning (X*), chunking (C*) and ingestion bookkeeping (J1, V12, V13)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X

LONG = 2_000_000_000


def with_text(df: DataFrame, fn, col: str = "text", to: str | None = None) -> DataFrame:
    """Apply a text expression to a column: ``with_text(docs, clean_corpus)``."""
    return df.withColumn(to or col, fn(F.col(col)))


@F.pandas_udf(T.StringType())
def _json_text(raw: pd.Series, keys: pd.Series) -> pd.Series:
    def walk(node, names, out):
        if isinstance(node, dict):
            out += [node[k] for k in names if isinstance(node.get(k), str)]
            for v in node.values():
                if isinstance(v, (dict, list)):
                    walk(v, names, out)
        elif isinstance(node, list):
            for v in node:
                walk(v, names, out)
        elif isinstance(node, str):
            out.append(node)

    def one(text, names):
        try:
            node = json.loads(text)
        except (TypeError, ValueError):
            return None
        out: list[str] = []
        walk(node, list(names), out)
        return "\n".join(x for x in out if x)

    return pd.Series([one(t, k) for t, k in zip(raw, keys)])


def extract_json_text(df: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """Depth first: an object's own texts under ``keys``, in their order, then what its values hold. Malformed JSON gives null. JSON of any
    depth and shape has no column type, so this is an Arrow UDF."""
    return df.withColumn("json_text", _json_text(F.col(col), F.array(*map(F.lit, keys))))


def split_sentences(df: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), sentence."""
    return df.select("doc_id", F.posexplode(X.sentences(X.normalize_for_chunking(X.nz(F.col("text"))))).alias("pos", "sentence"))


def chunks_of(norm: str, sentences: list[str], size: int, overlap: int, least: int) -> list[tuple[str, int, int, int]]:
    """(text, first sentence, char_start, char_end) of a text's chunks: a greedy pass over the lengths of its sentences, in time linear in the
    text. A chunk is full if one more sentence would exceed ``size``; the next one begins with as many of its last sentences as fit ``overlap``."""
    starts, at = [], 0
    for s in sentences:
        at = norm.find(s, at)
        starts.append(at)
        at += len(s)
    out: list[tuple[str, int, int, int]] = []

    def emit(a: int, b: int) -> None:
        text = " ".join(sentences[a:b])
        if len(text) >= least:
            out.append((text, a, starts[a], starts[b - 1] + len(sentences[b - 1])))

    first = held = 0
    for i, s in enumerate(sentences):
        if i > first and held + len(s) + 1 > size:
            emit(first, i)
            k = kept = 0
            while k < i - first and kept + len(sentences[i - 1 - k]) <= overlap:
                kept += len(sentences[i - 1 - k]) + 1
                k += 1
            first, held = i - k, kept
        held += len(s) + 1
    if sentences:
        emit(first, len(sentences))
    return out


_CHUNK = "array<struct<text:string,first_sentence:int,char_start:int,char_end:int>>"


def chunk_sentences(df: DataFrame, chunk_size: int = 400, overlap: int = 80, min_size: int = 30, keep: list[str] | None = None) -> DataFrame:
    """doc_id, chunk_index, text, first_sentence, char_start, char_end: sentence-aligned chunks that overlap by whole sentences. A chunk
    shorter than ``min_size`` is dropped and takes no index. Offsets are those of the chunk's first and last sentence in the normalised
    text. Sentences are cut by built-ins; the order-dependent pass over them is an Arrow UDF, for a fold by higher-order functions would copy
    what it has for each chunk, in time quadratic in the text."""
    if overlap >= chunk_size:
        raise ValueError("overlap must be smaller than chunk_size")

    @F.pandas_udf(_CHUNK)
    def chunk(norm: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(n, list(ss), chunk_size, overlap, min_size) for n, ss in zip(norm, sentences)])

    kept = ["doc_id", *(keep or [])]
    base = df.select(*kept, X.normalize_for_chunking(X.nz(F.col("text"))).alias("norm")).withColumn("ss", X.sentences(F.col("norm")))
    return base.select(*kept, F.posexplode(chunk("norm", "ss")).alias("chunk_index", "c")).select(*kept, "chunk_index", "c.*")


def chunk_fixed(df: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, chunk_index, text: slices of ``size`` characters; blank ones are dropped and take no index."""
    slices = F.regexp_extract_all(X.nz(F.col("text")), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return df.select("doc_id", F.posexplode(F.filter(slices, lambda s: X.strip(s) != "")).alias("chunk_index", "text"))


def chunk_counts(chunks: DataFrame, by: str = "source") -> DataFrame:
    """Chunks per source and, with a null source, in all."""
    return chunks.rollup(by).agg(F.count("*").alias("n_chunks"))


def docs_from_rows(df: DataFrame, text_col: str, source_col: str, fmt: str = "text") -> DataFrame:
    return df.select(F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.create_map(F.lit("format"), F.lit(fmt)).alias("metadata"))


def ingest(df: DataFrame, fmt: str = "text", **options) -> DataFrame:
    """Clean, chunk and stamp: the chunk columns, source and ``metadata``."""
    cleaned = df.withColumn("text", X.clean_corpus(X.nz(F.col("text"))))
    out = chunk_sentences(cleaned, keep=["source"], **options)
    return out.withColumn("metadata", F.create_map(F.lit("format"), F.lit(fmt), F.lit("source"), F.col("source")))


def drop_ingested(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose source the manifest doesn't hold; before any text work."""
    return docs.join(manifest.select("source"), "source", "left_anti")


def register_sources(docs: DataFrame, at: Column) -> DataFrame:
    return docs.groupBy("source").agg(F.max(at).alias("ingested_at"))


def kb_stats(chunks: DataFrame, ivf_from: int = 10_000) -> DataFrame:
    """One row: vectors, sources, index type."""
    return chunks.agg(F.count("*").alias("total_vectors"), F.countDistinct("source").alias("total_sources")).withColumn(
        "index_type", F.when(F.col("total_vectors") >= ivf_from, "ivf").otherwise("flat")
    )


def extract_prompts(df: DataFrame) -> DataFrame:
    """doc_id, pos, prompt: captures of ``* **Prompt**: "…"``."""
    return df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r'\* \*\*Prompt\*\*: "([^"]*)"'), F.lit(1))).alias("pos", "prompt"))
