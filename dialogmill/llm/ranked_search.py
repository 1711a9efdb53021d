"""Ranked lexical search by the Best Position Algorithm over impact lists.

An impact list holds a term's documents, highest impact first. Every list of a query is read at the first positions not seen yet, each
document met gets its whole score by direct accesses to the query's other lists, and these accesses mark its positions there as seen too.
A list's best position is the end of its unbroken run of seen positions; a document not met yet lies behind it in every list, so the sum of
the impacts at the positions just behind bounds its score. Reading stops when that bound is strictly below the k-th best score: a tie could
still win by its id.

Two passes. The first reads the texts and writes, per document, its length and the query terms in it. The second takes that table batch by
batch where it lies: a batch's impact lists are built in the task, searched for every item with the k-th score of the batches before as a
start, and k rows an item and task meet at the end. No list is gathered, so a term that every document holds is no hot key.

Items are taken in blocks of about ``VOCABULARY`` terms, a pass over the texts each, so what is sent to the tasks is bounded whatever the
number of items.

Words are looked up by 64-bit hashes (by chance one of 10^14 words may be taken for another).

Defined cases: null and empty texts, and texts without a term, are no documents; a null doc_id comes last among equal scores; repeated rows
are documents each; each row of the items is answered, also where ids repeat or are null; items without terms, or none in any document, give
no rows; empty tables give none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .runtime import Scratch, blocks, durable, string_buffers
from .textscan import NOT_ALNUM, Vocabulary, Words

#: Terms of a block of items.
VOCABULARY = 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str):
    """The terms of a text column, in order, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def count_terms(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary) of every document that holds a term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            n, parts, sizes = [], [], []
            for a, b in blocks(offsets):
                words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
                ids = vocabulary.ids(words.hashes(fold=True))
                known = np.flatnonzero(ids >= 0)
                size = max(1, len(vocabulary.sorted))
                pairs, tfs = np.unique(words.doc[known] * size + ids[known], return_counts=True)
                n.append(np.diff(words.first))
                sizes.append(np.bincount(pairs // size, minlength=b - a))
                parts.append((pairs % size, tfs))
            if not n:
                continue
            n = np.concatenate(n)
            ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), pa.int32())
            terms, tfs = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in zip(*parts))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), terms, tfs], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Lists:
    """Impact lists of some documents (by place): term t has the slice [at[t], at[t+1]) of each array."""

    at: np.ndarray
    docs: np.ndarray  # highest impact first
    impacts: np.ndarray
    sorted_docs: np.ndarray  # by document
    positions: np.ndarray  # of sorted_docs in their list

    @classmethod
    def build(cls, place: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> Lists:
        by_impact = np.lexsort((place, -impact, term))
        at = np.searchsorted(term[by_impact], np.arange(terms + 1))
        docs = place[by_impact]
        position = np.arange(len(term)) - at[term[by_impact]]
        by_doc = np.lexsort((docs, term[by_impact]))
        return cls(at, docs, impact[by_impact], docs[by_doc], position[by_doc])


def best_positions(lists: Lists, query: list[tuple[int, int]], k: int, kth: int = 0, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents met, their scores, and how many positions were read: among them every one whose score is above ``kth``, or equal to it, and
    may be of the k best (by score; of equal scores all). ``query``: (term, weight)."""
    own = [(w, slice(lists.at[t], lists.at[t + 1])) for t, w in query if w > 0 and lists.at[t + 1] > lists.at[t]]
    seen = [np.zeros(s.stop - s.start, bool) for _, s in own]
    best = [0] * len(own)  # positions of the unbroken run
    met, scores = np.zeros(0, lists.docs.dtype), np.zeros(0, np.int64)
    step, read = first, 0
    while True:
        bound = sum(w * int(lists.impacts[s.start + p]) for (w, s), p in zip(own, best) if p < s.stop - s.start)
        least = kth if len(scores) < k else max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        if not bound or bound < least:
            return met, scores, read
        fresh = []
        for (_, s), p, marks in zip(own, best, seen):
            fresh.append(lists.docs[s][p : p + step][~marks[p : p + step]])
        # a document whose positions were all unseen is new: a seen position marks all of its document's
        docs = np.unique(np.concatenate(fresh))
        read += sum(map(len, fresh))
        total = np.zeros(len(docs), np.int64)
        for (w, s), marks in zip(own, seen):
            held = lists.sorted_docs[s]
            i = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            hit = held[i] == docs
            positions = lists.positions[s][i[hit]]
            marks[positions] = True
            total[hit] += w * lists.impacts[s][positions]
        met, scores = np.concatenate((met, docs)), np.concatenate((scores, total))
        for j, marks in enumerate(seen):
            ahead = marks[best[j] :]
            best[j] += int(np.argmin(ahead)) if not ahead.all() else len(ahead)
        step *= 2


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_counts(counts: DataFrame, queries: dict[int, list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of every task, for the items of ``queries`` ((term, weight) each)."""
    vocabulary = 1 + max((t for q in queries.values() for t, _ in q), default=-1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in queries}  # scores, ids
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            m = 75 + 25 * batch.column(1).to_numpy() * n_docs // n_terms
            terms, tfs = batch.column(2), batch.column(3)
            place = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            tf = tfs.flatten().to_numpy().astype(np.int64)
            lists = Lists.build(place, terms.flatten().to_numpy(), 1_000_000_000 * tf // (1000 * tf + 12 * m[place]), vocabulary)
            for item, query in queries.items():
                scores, docs = held[item]
                found, gained, _ = best_positions(lists, query, k, int(scores[-1]) if len(scores) >= k else 0)
                scores, docs = np.concatenate((scores, gained)), np.concatenate((docs, ids[found]))
                keep = _top(scores, docs, k)
                held[item] = scores[keep], docs[keep]
        for item, (scores, docs) in held.items():
            keep = scores > 0
            if keep.any():
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(docs[keep], pa.int64(), mask=docs[keep] == _NO_ID), pa.array(scores[keep], pa.int64())], ["item", "doc_id", "score"])

    return counts.mapInArrow(search, "item long, doc_id long, score long")


def _search_block(items: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score of a block of items (item, terms), as a written table."""
    bags = {r.item: Counter(r.terms) for r in items.collect()}
    names = sorted({t for bag in bags.values() for t in bag})
    number = {t: i for i, t in enumerate(names)}
    with Scratch() as scratch:
        counts = durable(count_terms(documents, Vocabulary(names)), "counts")
        whole = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        df = F.count("*")
        weight = F.floor(1000 * F.log((2 * F.lit(whole.docs) + 2) / (2 * df + 1)).cast("double")).alias("w")
        weights = {r.t: r.w for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(weight).collect()}
        queries = {item: [(number[t], c * weights[number[t]]) for t, c in sorted(bag.items()) if number[t] in weights] for item, bag in bags.items()}
        return scratch.keep(durable(search_counts(counts, {i: q for i, q in queries.items() if q}, whole.docs, whole.terms or 1, k), "found"))


def search(items: DataFrame, documents: DataFrame, k: int = 20, vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of ``items`` (item_id, text) the k documents (doc_id, text) with the greatest scores above
    0, equal scores by ascending id."""
    spark: SparkSession = items.sparkSession
    with Scratch() as scratch:
        # rows of one id and text are told apart by their place among their likes
        rows = items.select(F.col("item_id").cast("long"), terms_of("text").alias("terms")).filter(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id())
        rows = durable(rows, "items")
        many = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
        count = -(-many // vocabulary)
        found = spark.createDataFrame([], "item long, doc_id long, score long")
        for block in range(count):
            part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == block)
            found = found.union(scratch.keep(_search_block(part, documents, k)))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        scratch.keep(rows)
        return ranked.join(rows.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = f"""with d as (select row_number() over () as row, doc_id, {_TERMS} as w from documents), docs as (select *, len(w)::bigint as n from d where len(w) > 0),
whole as (select count(*) as docs, sum(n)::bigint as terms from docs),
items as (select row_number() over () as item, item_id, {_TERMS} as w from benchmark),
q as (select item, item_id, t, count(*) as c from (select item, item_id, unnest(w) as t from items) group by all),
p as (select row, t, count(*) as tf from (select row, unnest(w) as t from docs) where t in (select t from q) group by all),
v as (select t, floor(1000 * ln((2 * (select docs from whole) + 2)::double / (2 * count(*) + 1)))::bigint as w from p group by t),
s as (select item, item_id, row, sum(c * v.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * whole.docs) // whole.terms))))::bigint as score
  from q join v using (t) join p using (t) join docs using (row), whole group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from s join docs using (row) where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20"""
