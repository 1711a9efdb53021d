"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing, packing. Each stage takes (spark, docs, sf_dir) and works
on all that the one before kept; between stages the documents are written and read again.

Defined cases, for every stage: an empty table gives no rows; texts are read whole; columns beyond those of ``documents`` are carried along
untouched whatever their names, up to the last stage, which doesn't read them. Null and empty texts are rejected by the first stage; later
ones, given such texts, keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogmill.llm import jaccard, mixing, packing, pii, quality_rules
from dialogmill.llm.runtime import durable, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go. Repeated rows share a verdict; null and empty texts go."""
    small_batches(spark)
    forest = quality_rules.train_forest(docs, table(spark, sf_dir, "labels"))
    # columns named like a result of the rules stand aside
    aside = {c: f"_own_{c}" for c in docs.columns if c in quality_rules.ADDED}
    rated = quality_rules.apply_rules(docs.withColumnsRenamed(aside), forest).filter("kept").drop(*quality_rules.ADDED)
    return rated.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8) stays, the one whose id is smallest. Rows without
    an id are told apart by their texts, as are unrelated rows of one id; rows without a word are copies of nothing and stay."""
    small_batches(spark)
    return jaccard.keep_one_of_each(docs, k=5, percent=80).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and ``n_chars`` renewed where it is a number or a string. Null texts stay null."""
    small_batches(spark)
    return pii.find_personal_data(docs, pii.train_field(docs), redacted=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are flattened to square-root weights; documents repeat or go by their draws. A null source is one of its own."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept copy is cut into pieces and placed in a sequence; a null or empty text is one end mark."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", dedup_stage),
    ("personal_data", pii_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]
#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
