"""Vectors and retrieval (V1-V11, J8).

Queries are a stated set; top-k is cut per block of the knowledge base before the blocks' winners meet, so no query's candidates are ever
gathered whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, text as X
from .blocks import CellIndex, all_pairs, nearest, nearest_bags, nearest_in_group, search_cells


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_normalize(df: DataFrame, col: str, to: str, zero: float = 0.0) -> DataFrame:
    """Missing components don't count and stay missing; those of a vector whose norm is 0 become ``zero``."""
    held, n = f"_norm_{to}", F.col(f"_norm_{to}")  # in a column, or it would be computed for every component
    unit = F.transform(col, lambda x: F.when(x.isNotNull() & (n == 0), F.lit(zero)).otherwise(x.cast("double") / n))
    return df.withColumn(held, norm(F.filter(col, lambda x: x.isNotNull()))).withColumn(to, unit).drop(held)


def embed_text(df: DataFrame, col: str = "text", to: str = "bag", model: Column | None = None) -> DataFrame:
    """Lexical vectors (term counts), or any embedding expression, such as a ``predict_batch_udf`` applied to the text."""
    return df.withColumn(to, X.term_counts(X.tokens(F.col(col))) if model is None else model)


def score_pairs(queries: DataFrame, kb: DataFrame, others: bool = False) -> DataFrame:
    """query_id, id, score of each query (``qv``) with each row of ``kb`` (``kv``), all of them; with ``others``: but the one of its own id."""
    return all_pairs(queries, kb, others)


def knn_search(queries: DataFrame, kb: DataFrame, k: int = 5, floor: float = 0.20, others: bool = False) -> DataFrame:
    """Top k of unit vectors first, then those below the floor go. All rows are searched, block by block."""
    return nearest(queries, kb, k, others).filter(F.col("score") >= floor)


def knn_search_ivf(queries: DataFrame, index: CellIndex, k: int = 5, floor: float = 0.20, others: bool = False, exact: bool = False) -> DataFrame:
    """As ``knn_search``, in the cells that ``build_cells`` found to hold most neighbours; ``exact``: and in all others that may hold a better row."""
    return search_cells(queries, index, k, others, exact).filter(F.col("score") >= floor)


def rerank(candidates: DataFrame, scorer: Column, top_n: int) -> DataFrame:
    """``score`` becomes ``scorer`` and ranks are renewed, where a query has more than ``top_n`` candidates; a null score keeps the old."""
    many = F.count("*").over(Window.partitionBy("query_id")) > top_n
    out = candidates.withColumn("many", many).withColumn("score", F.when(F.col("many"), F.coalesce(scorer, F.col("score"))).otherwise(F.col("score")))
    renewed = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("many"), F.col("score"))), "rank"))
    return out.withColumn("rank", renewed).drop("many")


def mmr(candidates: DataFrame, top_n: int = 5, lambda_: float = 0.6) -> DataFrame:
    """query_id, id, rank (order of selection): greedy relevance less redundancy over a query's candidates (at most a few tens: they come
    from a top k). ``rel`` is the relevance, ``v`` the candidate's unit vector, ``rank`` its place; ties go to the earlier one. A query with
    ``top_n`` or fewer keeps its order."""
    one = F.struct("rank", "id", "rel", "v")
    grouped = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("cs"))

    def pick(chosen: Column) -> Column:
        open_ = F.filter("cs", lambda c: ~F.array_contains(chosen, c["rank"]))
        taken = F.filter("cs", lambda c: F.array_contains(chosen, c["rank"]))
        value = lambda c: F.lit(lambda_) * c["rel"] - F.lit(1 - lambda_) * F.coalesce(F.array_max(F.transform(taken, lambda t: dot(t["v"], c["v"]))), F.lit(0.0))
        return -F.array_max(F.transform(open_, lambda c: F.struct(value(c).alias("s"), (-c["rank"]).alias("r"))))["r"]

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(top_n)), F.array().cast("array<int>"), lambda acc, _: F.array_append(acc, pick(acc).cast("int")))
    few = F.transform("cs", lambda c: c["rank"])
    out = grouped.withColumn("order", F.when(F.size("cs") <= top_n, few).otherwise(chosen))
    out = out.select("query_id", "cs", F.posexplode("order").alias("pos", "r"))
    return out.select("query_id", F.filter("cs", lambda c: c["rank"] == F.col("r"))[0]["id"].alias("id"), (F.col("pos") + 1).alias("rank"))


def format_context(results: DataFrame) -> DataFrame:
    """query_id, context: numbered passages (rank, source, score, text) between the head and the closing line."""
    part = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] Source: "), x["source"], F.lit(" (relevance: "), F.format_string("%.2f", x["score"]), F.lit(")\n"), X.strip(x["text"]), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "source", "score", "text")))
    return results.groupBy("query_id").agg(rows.alias("r")).select(
        "query_id", F.concat(F.lit(rules.CONTEXT_HEAD + "\n"), F.array_join(F.transform("r", part), "\n"), F.lit("\n---\n" + rules.CONTEXT_TAIL)).alias("context")
    )


def retrieve(queries: DataFrame, kb: DataFrame, candidates: int = 30, top_n: int = 3, floor: float = 0.45, lambda_: float = 0.6, scorer: Column | None = None, index: CellIndex | None = None, others: bool = False) -> DataFrame:
    """query_id, total_found, used_mmr, context: search (of all rows, or of ``index`` if one is given), rerank by ``scorer`` if given, diversify, format. ``kb``
    holds id, kv, source, text, which ``scorer`` may use."""
    found = knn_search(queries, kb.select("id", "kv"), candidates, floor, others) if index is None else knn_search_ivf(queries, index, candidates, floor, others)
    rich = found.join(kb, "id")
    if scorer is not None:
        rich = rerank(rich, scorer, top_n)
    rich = rich.select("query_id", "id", "rank", "score", F.col("score").alias("rel"), F.col("kv").alias("v"), "source", "text")
    picked = mmr(rich, top_n, lambda_)
    context = format_context(picked.join(rich.select("query_id", "id", "score", "source", "text"), ["query_id", "id"]))
    totals = found.groupBy("query_id").agg(F.count("*").cast("int").alias("total_found"))
    out = queries.select("query_id").join(totals, "query_id", "left").join(context, "query_id", "left")
    return out.select("query_id", F.coalesce("total_found", F.lit(0)).alias("total_found"), (F.coalesce("total_found", F.lit(0)) > top_n).alias("used_mmr"), F.coalesce("context", F.lit("")).alias("context"))


def session_doc_search(queries: DataFrame, chunks: DataFrame, k: int = 3, others: bool = False) -> DataFrame:
    """query_id, context: the k chunks of the query's session (with ``others``: but the one of its own id) nearest by L2 distance, joined."""
    near = nearest_in_group(queries, chunks, "session_id", k, others).join(chunks.select("id", "text"), "id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return near.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n---\n\n").alias("context"))


def lexical_search(queries: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """query_id, id, score, rank: the k passages most like a query by bag-of-words cosine among those that share a term. ``queries`` hold
    query_id and bag (term counts), ``passages`` id and bag. The passages are taken in bounded blocks, and queries meet a block's term lists
    where they lie: no term is a join key."""
    return nearest_bags(queries, passages, k)


def route_retrieval(turns: DataFrame, category: str = "category", continuation: str = "is_continuation") -> DataFrame:
    return turns.withColumn("use_retrieval", F.col(category).isin(rules.RETRIEVAL_INTENTS) & ~F.col(continuation))
