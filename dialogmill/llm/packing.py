"""Best-fit packing of token pieces by bin completion.

A piece has 1 to ``capacity`` tokens, so the whole corpus enters the search as a histogram of at most ``capacity`` counts, whatever its
size; the plan is a list of patterns ("so many sequences hold these lengths"), and Spark deals the pieces to it by their rank among the
pieces of equal length. Ranks come from counts by (length, bucket), so a length that many copies share is no hot group.

Defined cases: null text is empty (one end-of-text id); a null doc_id packs like any other; repeated rows are packed each; an empty
table gives no rows; extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .runtime import durable, tidy

CAPACITY, END_ID = 1024, 2
#: Ranks within a length are counted in so many buckets at least, and more if a bucket would hold more pieces than this.
BUCKETS, BUCKET_PIECES = 512, 10_000
#: Nodes of the branch-and-bound, and steps of all its parts together (a second or two a million); the incumbent is complete at any time,
#: so the bounds cost no document.
NODES, WORK = 6000, 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def encoder(ranks_path: str | None, json_path: str | None):
    """text → ids. The ranks file holds the vocabulary of the tokenizers file and yields the same ids several times faster (tested);
    texts that contain the end-of-text string go to ``tokenizers`` itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: slow.encode(text, add_special_tokens=False).ids if "<|endoftext|>" in text else fast.encode_ordinary(text)


def pieces_of(text: str, encode, capacity: int = CAPACITY, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: a document that fits is one; a longer one is cut so that only its first may be short."""
    ids = array("I", encode(text))
    ids.append(end_id)
    n, raw = len(ids), ids.tobytes()
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def tokenise(documents: DataFrame, ranks_path: str | None = None, json_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoder(ranks_path, json_path), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = known.get(text)
                if found is None:
                    found = pieces_of(text, encode, capacity)
                    if len(text) < 8000:  # exact copies in a partition are cut once
                        if len(known) >= 4000:
                            known.clear()
                        known[text] = found
                rows += [(doc_id, k, *x) for k, x in enumerate(found)]
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut), _PIECES)


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many a sequence), ...), number of sequences


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit in order of decreasing length, on counts: equal sequences are kept as one entry with a number."""
    space: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in space if r >= length and space[r]):
            if not left:
                break
            per, kept = room // length, []
            while space[room] and left:
                held, number = space[room].pop()
                use = min(number, left // per)
                if use:
                    space.setdefault(room - per * length, []).append((held | {length: per}, use))
                    left -= use * per
                if number > use and left:  # fewer than ``per`` are left for one more
                    space.setdefault(room - left * length, []).append((held | {length: left}, 1))
                    left, use = 0, use + 1
                if number > use:
                    kept.append((held, number - use))
            space[room] = space[room] + kept
        if left:
            per = capacity // length
            if left // per:
                space.setdefault(capacity - per * length, []).append(({length: per}, left // per))
            if left % per:
                space.setdefault(capacity - (left % per) * length, []).append(({length: left % per}, 1))
    return [(tuple(sorted(h.items(), reverse=True)), n) for held in space.values() for h, n in held if n]


class Work:
    """Steps that a search may still take."""

    def __init__(self, left: int):
        self.left = left

    def spent(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left < 0


def all_fillings(counts: np.ndarray, largest: int, capacity: int, work: Work) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The completions of a sequence that holds ``largest`` that no other dominates, least waste first and of equal waste those of longer
    pieces first.

    A completion is dominated if pieces of it, or none, could change places with one unused piece that is as long as they are together or up to
    the waste longer. Pieces are chosen longest first, so when some have been chosen all longer ones are decided, and a choice whose sums
    meet an unused piece ends there. Sums that the remaining lengths can't reach are never tried. Every step counts as ``work``; when that is
    used up no more completions come."""
    room = capacity - largest
    left = counts.copy()
    left[largest] -= 1
    lengths = [int(x) for x in np.flatnonzero(left[: room + 1])[::-1]]
    stock = {x: int(left[x]) for x in lengths}
    full = (1 << (room + 1)) - 1
    reach = [1]  # from behind: the sums that lengths[i:] can make, as bits
    for x in reversed(lengths):
        bits, many, step = reach[-1], min(stock[x], room // x), 1
        if bits != full:
            work.spent()
            while many > 0:
                use = min(step, many)
                bits |= bits << (use * x) & full
                many, step = many - use, step * 2
        reach.append(bits)
    reach.reverse()
    unused = sum(1 << x for x in lengths)

    def near(free: int, waste: int) -> int:
        """Sums to which an unused length is equal, or longer by up to ``waste``."""
        shift, covered = 1, 1
        while covered <= waste:
            shift = min(covered, waste + 1 - covered)
            free |= free >> shift
            covered += shift
        return free

    def exact(i: int, total: int, waste: int, single: int, multi: int, free: int, close: int) -> Iterator[tuple[int, ...]]:
        """Choices of lengths[i:] that make ``total``. ``single``, ``multi``: the lengths chosen and the sums of several; ``free``: unused
        lengths, and ``close`` what is near them."""
        if not total:
            yield ()
            return
        longer = (1 << waste) - 1
        whole = close >> total & 1  # several pieces here would give way to one
        for j in range(i, len(lengths)):
            if work.spent() or not reach[j] >> total & 1:
                return
            x = lengths[j]
            if x > total:
                continue
            if whole and x < total:
                return
            sums = []  # by copies of x
            one, several = single, multi
            for _ in range(min(stock[x], total // x)):
                several, one = several | several << x | one << x, one | 1 << x
                if several & close:
                    break
                sums.append((one, several))
            for many in range(len(sums), 0, -1):
                one, several = sums[many - 1]
                rest, close_after = free, close
                if many == stock[x]:
                    rest = free & ~(1 << x)
                    close_after = near(rest, waste)
                if rest >> (x + 1) & longer:
                    continue  # a piece a little longer than x is unused
                for tail in exact(j + 1, total - many * x, waste, one, several, rest, close_after):
                    yield (x,) * many + tail

    small = np.cumsum(left[: room + 1] * np.arange(room + 1))
    for waste in range(room + 1):
        if work.left < 0 or small[waste] > room - waste:
            return  # pieces as short as the waste must all be in it, and can't
        if reach[0] >> (room - waste) & 1:
            for f in exact(0, room - waste, waste, 0, 0, unused, near(unused, waste)):
                used = Counter(f)
                if all(x > waste or used[x] == stock[x] for x in lengths):
                    yield waste, f


def _dominates(g: tuple[int, ...], f: tuple[int, ...]) -> bool:
    """Whether wherever ``f`` is used ``g`` can be, its pieces changing places with ``f``'s (a sound test, not a complete one)."""
    return (len(g) == len(f) and all(a >= b for a, b in zip(g, f))) or (len(g) == 1 and g[0] >= sum(f))


def fillings(counts: np.ndarray, largest: int, capacity: int, wide: int = 24, most: int = 6) -> list[tuple[int, tuple[int, ...]]]:
    """A few good completions of a sequence that holds ``largest``, least waste first: (waste, lengths beside ``largest``).

    Each begins with one of the ``wide`` longest lengths that fit (and, for those, one of a few second lengths) and goes on with the
    longest that still fits. The search tries these first and ``all_fillings`` after them."""
    room = capacity - largest
    left = counts.copy()
    left[largest] -= 1
    fits = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    found: dict[tuple[int, ...], int] = {}

    def finish(chosen: list[int], room: int) -> None:
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
            if used[x] > left[x]:
                return
        while room > 0 and (x := int(fits[room])):
            while x and used.get(x, 0) >= left[x]:
                x = int(fits[x - 1])
            if not x:
                break
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            room -= x
        found.setdefault(tuple(sorted(chosen, reverse=True)), room)

    first = int(fits[room]) if room > 0 else 0
    if not first:
        return [(room, ())]
    for _ in range(wide):
        if not first:
            break
        rest = room - first
        second = int(fits[rest]) if rest > 0 else 0
        finish([first], rest)
        if found and min(found.values()) == 0 and len(found) >= most:
            break
        for _ in range(6):
            second = int(fits[second - 1]) if second > 1 else 0
            if not second:
                break
            finish([first, second], rest - second)
        first = int(fits[first - 1]) if first > 1 else 0
    ordered = sorted((w, len(f), f) for f, w in found.items())
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, n, f in ordered:
        if not any(_dominates(g, f) for _, g in kept):
            kept.append((waste, f))
        if len(kept) == most:
            break
    return kept


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, steps: int = WORK) -> list[Pattern]:
    """Bin completion. ``counts[l]`` pieces have length l. Depth first: complete a sequence around the longest piece left by its
    undominated fillings, a good few first and then all others, least waste first; a branch ends when its waste exceeds what one sequence
    fewer than the incumbent allows. A filling is repeated while the counts last, and tried once alone if that leads nowhere. Incumbents
    are best-fit solutions of the whole and of nodes' remainders."""
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    work = Work(steps)
    stack: list[tuple[np.ndarray, list, int, int, Iterator]] = []

    def options_of(left: np.ndarray, top: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        first = fillings(left, top, capacity)
        yield from ((w, top, f) for w, f in first)
        tried = {f for _, f in first}
        yield from ((w, top, f) for w, f in all_fillings(left, top, capacity, work) if f not in tried)

    def open_node(left: np.ndarray, done: list[Pattern], used: int, waste: int) -> None:
        top = int(np.flatnonzero(left)[-1])
        stack.append((left, done, used, waste, options_of(left, top)))

    if best_n > least and total:
        open_node(counts, [], 0, 0)
    seen = 0
    while stack and seen < nodes and best_n > least and not work.spent(32):
        left, done, used, waste, options = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        seen += 1
        (w, top, filling), once = option[:3], len(option) == 4
        held: dict[int, int] = {}
        for x in (top, *filling):
            held[x] = held.get(x, 0) + 1
        allowed = (best_n - 1) * capacity - total
        number = min(int(left[x]) // k for x, k in held.items())
        if w:
            number = min(number, max(0, (allowed - waste) // w))
        if not number:
            continue  # the waste bound
        if number > 1 and not once:
            stack[-1] = (left, done, used, waste, chain([(w, top, filling, True)], options))
        if once:
            number = 1
        rest = left.copy()
        for x, k in held.items():
            rest[x] -= k * number
        node = [*done, (tuple(sorted(held.items(), reverse=True)), number)]
        if not rest.any():
            if used + number < best_n:
                best, best_n = node, used + number
            continue
        if seen % 64 == 0:
            work.spent(16 * len(node) + int((rest > 0).sum()) * 16)
            tail = best_fit(rest, capacity)
            if (n := used + number + sum(m for _, m in tail)) < best_n:
                best, best_n = [*node, *tail], n
        open_node(rest, node, used + number, waste + w * number)
    return best


def _segments(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it a sequence, offset): which ranks of a length go where."""
    out, next_rank, sequence = [], {}, 0
    for held, number in plan:
        offset = 0
        for length, per in held:
            a = next_rank.get(length, 0)
            next_rank[length] = a + per * number
            out.append((length, a, a + per * number, sequence, per, offset))
            offset += length * per
        sequence += number
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length and more) with sequence_id and offset. The plan has at most a few rows a
    length, so its broadcast is bounded by ``capacity``."""
    spark = pieces.sparkSession
    buckets = max(BUCKETS, pieces.count() // BUCKET_PIECES)
    own = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    grouped = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in grouped.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.length] = row.n
    segments = _segments(plan_sequences(counts, capacity, nodes))
    plan = spark.createDataFrame(segments, "length long, a long, b long, sequence long, per long, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = grouped.select("length", "bucket", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*own)) - 1
    ranked = pieces.withColumn("rank", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))).drop(plan.length)
    place = F.col("rank") - F.col("a")
    sequence = F.col("sequence") + F.floor(place / F.col("per"))
    return placed.withColumn("sequence_id", sequence).withColumn("offset", F.col("at") + F.pmod(place, F.col("per")) * F.col("length")).drop("bucket", "rank", "before", "a", "b", "sequence", "per", "at")


def pack_documents(documents: DataFrame, ranks_path: str | None = None, json_path: str | None = None, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document's pieces."""
    pieces = durable(tokenise(documents, ranks_path, json_path, capacity), "pieces")
    return pack(pieces, capacity, nodes).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
