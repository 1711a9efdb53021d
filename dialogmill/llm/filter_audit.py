"""What five filters remove in every one of their 120 orders: Lehmer-rank difference arrays.

A document enters as the mask of the filters that it fails. In an order it goes at the first filter of its mask, and the orders that share
the letters up to that filter have ranks, in the order of the alphabet, that form one interval: a rank's Lehmer digits times factorials say
which. So a mask's removals at a step are a few intervals of the ranks, its counts are added at their beginnings and taken off at their
ends, and one running sum over the ranks gives every order's removals. The corpus is read once, as counts by (part, mask).

Four of the filters, and so their bits, depend on the text alone; equal texts meet by digest as counts (by part and labels), never as rows,
so a text that a third of the rows share is no hot group.

Defined cases: null text is empty, null lang is the part "" (as an empty one is); a null doc_id has no label, is no earlier copy of anything
and no copy of anything earlier; repeated rows count each, and rows of one id and one text are no copies of each other; labels of one id
in several rows count where any row says 1; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Filters by letter: a failure condition over the columns ``text``, ``n_words``, ``n_distinct``; E needs the whole table.
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
_COUNTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, WHITE), "")

    def rate(w: Column) -> Column:
        n, distinct, chars = F.size(w), F.size(F.array_distinct(w)), F.length(text)
        upper = chars - F.length(F.translate(text, UPPER, ""))
        failed = (n < 100, 100 * distinct < 80 * n, 100 * upper.cast("long") > 10 * chars.cast("long"), text.rlike(SIGNS))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return F.transform(F.array(words), rate)[0]  # the words are cut once


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just these filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")
    )
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    key = ["digest", "mask", "part", "good", "toxic"]
    rows = docs.groupBy("doc_id", "digest", "mask", "part").agg(F.count("*").alias("c")).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # of each text's rows of a part and label: how many, the smallest id with its rows, and those without an id
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    groups = rows.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), lowest.alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("low.doc_id") == first, F.col("low.c")).otherwise(0)
    split = groups.withColumn("own", own)
    e = 1 << FILTERS.index("E")
    both = split.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("own")).alias("n")))))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return both.filter("n > 0").groupBy("part", F.col("mask").cast("int").alias("mask")).agg(*sums)


def removal_intervals(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank): documents that fail ``mask`` go at ``step`` (from 1) in the orders of these ranks."""

    def walk(mask: int, step: int, rank: int, left: tuple[int, ...]) -> Iterator[tuple[int, int, int, int]]:
        size = factorial(n - step)
        for digit, letter in enumerate(left):
            a = rank + digit * size
            if mask >> letter & 1:
                yield mask, step, a, a + size
            else:
                yield from walk(mask, step + 1, a, left[:digit] + left[digit + 1 :])

    for mask in range(1, 1 << n):
        yield from walk(mask, 1, 0, tuple(range(n)))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``counts`` (part, mask, n, good, toxic) as one row per part, order and step. The tables of intervals and of orders depend on the number
    of filters alone; rows are parts times orders times steps, and those of a part meet."""
    spark, n = counts.sparkSession, len(filters)
    intervals = F.broadcast(spark.createDataFrame(list(removal_intervals(n)), "mask int, step int, a int, b int"))
    orders = F.broadcast(spark.createDataFrame([(r, s + 1, "".join(p), filters.index(p[s])) for r, p in enumerate(permutations(filters)) for s in range(n)], "rank int, step int, filter_order string, i int"))
    ends = F.array(F.struct(F.col("a").alias("rank"), *_COUNTS), F.struct(F.col("b").alias("rank"), *((-F.col(c)).alias(c) for c in _COUNTS)))
    steps = counts.join(intervals, "mask").select("part", "step", F.inline(ends)).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) > 0
    fails = F.array(*(F.sum(F.when(bit(i), F.col("n")).otherwise(0)) for i in range(n)))
    alone = F.array(*(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), fails.alias("fails"), alone.alias("alone"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).join(orders, "rank")
    met = grid.join(steps, ["part", "rank", "step"], "left").fillna(0, list(_COUNTS)).repartition("part")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = met.select("part", "rank", "step", "filter_order", "i", "total", "fails", "alone", *(F.sum(c).over(along).alias(c) for c in _COUNTS))
    out = out.withColumn("gone", F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "i")))
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"), (F.element_at("fails", F.col("i") + 1) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("i") + 1).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five filters over ``documents``."""
    return audit(failure_counts(documents, labels))


ORACLE = rf"""with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as low from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '{SIGNS}'), coalesce(w.doc_id > low, false)] as fails from w left join l on w.doc_id = l.doc_id),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
i as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select o, i as step, o[i] as f, list_reduce(list_transform(o, lambda x: substr('ABCDE', x, 1)), lambda x, y: x || y) as filter_order from o, i),
r as (select part, filter_order, step, f, coalesce(sum(n) filter (not list_bool_or(list_transform(o[1:step], lambda x: fails[x]))), 0) as kept,
  coalesce(sum(n) filter (fails[f] and not coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false)), 0) as removed,
  coalesce(sum(n) filter (fails[f] and coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false)), 0) as redundant,
  coalesce(sum(n) filter (fails[f] and len(list_filter(fails, lambda x: x)) = 1), 0) as unique_fails,
  coalesce(sum(good) filter (fails[f] and not coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false)), 0) as good_lost,
  coalesce(sum(toxic) filter (fails[f] and not coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false)), 0) as toxic_lost
  from g, s group by part, filter_order, step, f)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r"""
