"""Connected components by alternating large-star and small-star steps over an edge table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import Scratch, durable, join_hot


def _star(edges: DataFrame, large: bool, many: int) -> DataFrame:
    """Point neighbours at the smallest node near them: of each node the larger ones (large star), or itself and the smaller ones."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = join_hot(both, least, ["u"], "v", at_most=2 * many)  # a hub may hold most edges
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """A written table (node, comp): for every node of ``edges`` (u, v) the smallest node it is connected with. Each round's edges are a written table;
    rounds end when the edges form stars, which the sum of their hashes shows. Loops and repeated edges count for nothing, a null end drops
    the edge, no edges give no rows."""
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    with Scratch() as scratch:
        edges = durable(edges.filter("u <> v").select("u", "v").distinct(), "edges")
        seen = print_of(edges)
        while seen[0]:
            last, edges = edges, durable(_star(_star(edges, True, seen[0]), False, 2 * seen[0]), "edges")
            scratch.discard(last)
            now = print_of(edges)
            if now == seen:
                break
            seen = now
        both = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        return scratch.keep(durable(both.groupBy("node").agg(F.min("comp").alias("comp")), "components"))
