"""The operators as queries over the given tables, with production parameters; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, filter_audit, html_text, jaccard, licenses, mixing, packing, pii, quality_cnn, quality_rules, ranked_search, toxicity, warc
from .runtime import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cnn.score_quality(documents, quality_cnn.train_network(documents, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened to weights of the square root of their rows, the mix as large as the corpus."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(documents, toxicity.train_model(documents, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(documents, pii.train_field(documents))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, read back from the normalised archives."""
    got = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.train_forest(documents, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(documents, forest).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` against all documents."""
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=20)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_jaccard": op7_jaccard,
    "op8_ann": op8_ann,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_licenses": op12_licenses,
    "op13_filter_audit": op13_filter_audit,
}
#: DuckDB SQL where it can express the whole result.
ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
