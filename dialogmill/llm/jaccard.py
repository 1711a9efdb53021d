"""Exact n-gram Jaccard join by prefix filtering under several global token orders.

If two sets reach the threshold, then under any one order of all tokens their prefixes share a token. Each order here ranks a token by how
frequent it is (rare ones first) and then by a hash seeded for the order, so that the orders agree in putting what every document has
last and are otherwise independent. Candidates share a prefix token under the first order (an equi-join on tokens, thinned by set sizes and
by positions in the prefix), must share one under the second as well, and only then are verified on their whole sets. The tokens of few
classes meet by a shuffle; those of many (known from the count of frequent tokens, so bounded in number) by a broadcast of their totals.

Documents with equal sets are one class throughout. Of a token's classes first only pairs with the smallest are made (a star, so a group
of m near copies gives m pairs, not m squared); after these links are verified and their components found, the second pass takes what of
a token's classes of like size is still in different components. Where that is few, their pairs are made and verified. Where it is many,
the lists that share classes are a crowd. A crowd is split by the second order first: pairs that link share a prefix token there too, so if
its lists of second-order tokens leave less than half of the pairs, they take its place, and where one of them is few its pairs are made.
What no order splits are near copies that differ too much from each other to be linked by the star. Of these no pairs are made: their sets
are sent in blocks by size band, blocks of bands that can link are compared inside a task, and only links that join components leave it.
What the largest component holds is compared with the rest alone. So every pair that could link is either linked through others or
verified: the components are those of the whole link graph.

A block and a bucket of pairs are bounded by the tokens of their sets, not by their number.

Tokens are 64-bit hashes of shingles, classes 64-bit hashes of sets.

Defined cases: null or empty text, or one of white space alone, has an empty set and is linked with nothing; texts are read whole; repeated
rows are one class; a null doc_id is never a component's name unless its class has no other; an empty table gives no rows;
other columns are not read, whatever their names (``keep_one_of_each`` carries them along).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .runtime import Scratch, blocks, durable, join_hot, partitions, string_buffers, tidy
from .textscan import Words, mix, shingle_sets

#: Tokens whose frequency the orders know, at most: the most frequent. It bounds the broadcast (4 MB), not the result.
RANKED = 1 << 18
#: A token is counted for the ranking in batches of so many tokens in which it occurs so often.
COUNT_BATCH, COUNT_FROM = 2_500_000, 3
#: Candidate documents up to which their ids are broadcast to the texts, and buckets that they name together (4 bytes each); beyond, texts
#: are joined by a shuffle.
BROADCAST_IDS, BROADCAST_PLACES = 400_000, 2_000_000
#: Prefix tokens of a partition in which they meet: few, so that sorting them takes little memory.
PARTITION_TOKENS = 100_000
#: Documents with a token from which it is hot, as a binary logarithm.
HOT_LEVEL = 10
#: Tokens of the sets that are verified together, about: a bucket's, and half of what a pair of blocks holds. A block has so many classes at most.
BUCKET_TOKENS, BLOCK_CLASSES = 1 << 20, 1024
#: Pairs of classes in different components from which the classes of a token and size band are a crowd.
CROWD = 600
_U = np.uint64


def _sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    words = Words(raw, offsets)
    return shingle_sets(words, words.hashes(fold=True), k)


def frequent_tokens(documents: DataFrame, k: int, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents and the binary logarithms of their counts, sorted by shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COUNT_FROM
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                for s in _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
                    held.append(s)
                    size += len(s)
                if size >= COUNT_BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = documents.select(F.col("text").cast("string")).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(ranked).toPandas()
    token = top.token.to_numpy(np.int64).view(_U)
    order = np.argsort(token)
    return token[order], np.log2(top.n.to_numpy(float)[order]).astype(np.uint64)


def _ordered(token: np.ndarray, known: np.ndarray, level: np.ndarray, seed: int) -> np.ndarray:
    """A token's place in an order, which also names it: level of frequency in the top 6 bits, a seeded hash below."""
    place = mix(token ^ _U(seed * 0x9E3779B97F4A7C15 % 2**64)) >> _U(6)
    if len(known):
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        place |= np.where(known[at] == token, level[at] + _U(1), _U(0)) << _U(58)
    return place


def prefix_table(documents: DataFrame, k: int, percent: int, orders) -> DataFrame:
    """doc_id, cls, n, lead (the class's first row in its task), and for a lead p1: its set's prefix under the first order. ``orders``: the
    broadcast frequent tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = orders.value
        met: set[int] = set()
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                sets = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                order = _ordered(np.concatenate(sets), known, level, 1)
                ends = np.cumsum([len(s) for s in sets])
                cls, lead, parts, sizes = [], [], [], []
                for s, e in zip(sets, ends):
                    n = len(s)
                    key = _name(s) if n else None
                    fresh = n > 0 and key not in met
                    cls.append(key)
                    lead.append(fresh)
                    if fresh:
                        if len(met) >= 1_000_000:
                            met.clear()
                        met.add(key)
                        parts.append(np.sort(order[e - n : e])[: _prefix(n, percent)])
                    sizes.append(len(parts[-1]) if fresh else 0)
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                one = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                cols = [batch.column("doc_id").slice(a, b - a), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(lead), pa.ListArray.from_arrays(at, pa.array(one))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "cls", "n", "lead", "p1"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(scan), "doc_id long, cls long, n int, lead boolean, p1 array<long>")


def _prefix(n: int, percent: int) -> int:
    """Of a set of n tokens, how many come before all that a linked set can lack together."""
    return n - (percent * n + 99) // 100 + 1


def _second_prefix(percent: int, orders):
    """A function of a set: its prefix under the second order, 32 bits a token, sorted (a chance agreement only lets a pair through)."""

    def prefix(tokens: np.ndarray) -> bytes:
        place = np.sort(_ordered(tokens, *orders.value, 2))[: _prefix(len(tokens), percent)]
        return np.sort(place.astype(np.uint32)).tobytes()

    return prefix


def _close(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _send_sets(documents: DataFrame, classes: DataFrame, places: DataFrame, k: int, packed=None) -> DataFrame:
    """(bucket, cls, tokens): each class's set, made from its text again and packed into bytes (``_short`` by default), once for every bucket
    that ``places`` (cls, bucket) names."""
    packed = packed or _short
    wanted = durable(places.join(classes, "cls").groupBy("cls").agg(F.min("rep").alias("rep"), F.collect_set("bucket").alias("buckets")), "wanted")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("buckets")).alias("places"), F.count_if(F.col("rep").isNull()).alias("nameless")).first()
    nameless = size.nameless > 0
    if size.n <= BROADCAST_IDS and (size.places or 0) <= BROADCAST_PLACES:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(wanted.filter("rep is not null"), "rep").select("cls", "text", "buckets")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                sets = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                places = batch.column("buckets").slice(a, b - a).to_pylist()
                keys = batch.column("cls").slice(a, b - a).to_pylist()
                # a text may have been found under an id that several rows share: the set's hash tells whose it is
                rows = [(x, key, raw) for s, key, xs in zip(sets, keys, places) if _name(s) == key for raw in [packed(s)] for x in xs]
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "cls", "tokens"])

    sent = texts.mapInArrow(tidy(send), "bucket int, cls long, tokens binary")
    if not nameless:
        return sent

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                rows = {}
                for s in _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
                    if len(s) and (key := _name(s)) not in met:
                        met.add(key)
                        rows[key] = packed(s)
                if len(met) >= 1_000_000:
                    met.clear()
                yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int64()), pa.array(rows.values(), pa.binary())], ["cls", "tokens"])

    # classes whose rows all lack an id are found by their sets, once a task
    found = documents.filter(F.col("doc_id").cast("long").isNull()).select(F.col("text").cast("string")).mapInArrow(tidy(name), "cls long, tokens binary")
    found = found.join(wanted.filter("rep is null"), "cls").select(F.explode("buckets").alias("bucket"), "cls", "tokens")
    return sent.union(found.select("bucket", "cls", "tokens"))


def _name(tokens: np.ndarray) -> int:
    """A set's class."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _short(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token: enough to compare two sets (a chance agreement is likely once in a billion pairs)."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


_PAIR = ["cls_a as a", "cls_b as b", "n_a as na", "n_b as nb"]
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _long(raw) -> np.ndarray:
    """A set as sent, as numbers whose lower 16 bits are 0."""
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(_U).ravel()


def _known(sets: pa.Table, wanted: set[int] | None = None) -> dict[int, np.ndarray]:
    """cls → tokens as sent."""
    return {key: _long(raw.as_buffer()) for key, raw in zip(sets.column("cls").to_pylist(), sets.column("tokens")) if wanted is None or key in wanted}


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], common_from: int = 32, slice_tokens: int = 1 << 18) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets (sorted), token range by token range, so that what is sorted at a time is
    bounded. Tokens that many sets hold are columns of a product of 0/1 matrices; of the others, the few (left, right) places they share are
    counted one by one."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    sets = [*left, *right]
    slices = max(1, -(-sum(map(len, sets)) // slice_tokens))
    bounds = np.array([i * 2**64 // slices for i in range(1, slices)], _U)
    edges = np.array([[0, *np.searchsorted(s, bounds), len(s)] for s in sets])
    for k in range(slices):
        token = np.concatenate([s[e[k] : e[k + 1]] for s, e in zip(sets, edges)])
        owner = np.repeat(np.arange(n + m, dtype=np.int32), edges[:, k + 1] - edges[:, k])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        common = np.flatnonzero(size >= common_from)
        for a in range(0, len(common), 1024):
            some = common[a : a + 1024]
            x = np.zeros((n + m, len(some)), np.float32)
            rows = np.concatenate([owner[start[t] : start[t] + size[t]] for t in some])
            x[rows, np.repeat(np.arange(len(some)), size[some])] = 1
            out += x[:n] @ x[n:].T
        for d in range(2, common_from):
            some = start[size == d]
            for a in range(0, len(some), 20_000):
                rows = owner[some[a : a + 20_000, None] + np.arange(d)]
                for i in range(d):
                    for j in range(i + 1, d):  # owners of a token rise, so a left one comes before a right one
                        ok = (rows[:, i] < n) & (rows[:, j] >= n)
                        np.add.at(out, (rows[ok, i], rows[ok, j] - n), 1)
    return out


def _crowd_links(members: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """Links that join components, among the left or between the left and right classes of one pair of blocks."""
    known = _known(sets, set(members.column("cls").to_pylist()))
    rows = list(zip(members.column("cls").to_pylist(), members.column("comp").to_pylist(), members.column("side").to_pylist()))
    left, right = [r for r in rows if r[2] != "r"], [r for r in rows if r[2] != "l"]
    root = {r[1]: r[1] for r in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    if left and right:
        a, b = [known[r[0]] for r in left], [known[r[0]] for r in right]
        both = _overlaps(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None] - both
        for i, j in zip(*np.nonzero(100 * both >= percent * union)):
            x, y = find(left[i][1]), find(right[j][1])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((left[i][0], right[j][0]))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})


def _size_band(n: str):
    """Sets whose sizes can link are in the same or in neighbouring bands."""
    return lambda percent: F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / percent))).cast("int")


def _apart(rows: DataFrame, on: list[str]) -> DataFrame:
    """For each list (key ``on``) the number of its pairs of classes that are in different components, where there are any."""
    lists = rows.groupBy(*on, "comp").agg(F.count("*").alias("k")).groupBy(*on)
    return lists.agg(((F.pow(F.sum("k"), F.lit(2)) - F.sum(F.col("k") * F.col("k"))) / 2).alias("apart")).filter("apart > 0")


def _crowded(rows: DataFrame) -> DataFrame:
    """(cls, comp, n, crowd): ``rows`` (unit, cls, comp, n) whose units share classes are one crowd."""
    rows = durable(rows, "crowd-units")
    hub = rows.groupBy("unit").agg(F.min("cls").alias("hub"))
    groups = components(join_hot(rows.select("unit", "cls"), hub, ["unit"], "cls", at_most=rows.count()).select(F.col("hub").alias("u"), F.col("cls").alias("v")))
    named = groups.select(F.col("node").alias("cls"), F.col("comp").alias("crowd"))
    return durable(rows.select("cls", "comp", "n").distinct().join(named, "cls"), "crowd-classes")


def _split(documents: DataFrame, classes: DataFrame, own: DataFrame, many: int, k: int, percent: int, orders) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crowds by the second order: pairs (a, b, na, nb) of its small lists, rows (unit, cls, comp, n) of its large ones, and the rows of ``own``
    whose crowds it doesn't split."""

    sent = _send_sets(documents, classes, own.select("cls", F.lit(0).alias("bucket")), k, _second_prefix(percent, orders))
    digits = F.hex("tokens")  # eight a token
    p2 = F.transform(F.sequence(F.lit(0), (F.length("tokens") / 4).cast("int") - 1), lambda i: F.substring(digits, i * 8 + 1, F.lit(8)))
    second = sent.select("cls", p2.alias("p2")).join(own, "cls").dropDuplicates(["cls"]).withColumn("band", _size_band("n")(percent))
    lists = second.select("crowd", "cls", "comp", "n", "band", F.explode("p2").alias("t2")).withColumn("u", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    lists = durable(lists, "crowd-second-order")
    on = ["crowd", "t2", "u"]
    left = durable(_apart(lists, on), "crowd-lists")
    worth = left.groupBy("crowd").agg(F.sum("apart").alias("after")).join(_apart(own, ["crowd"]), "crowd", "right")
    worth = durable(worth.select("crowd", (F.coalesce("after", F.lit(0)) * 2 < F.col("apart")).alias("splits")), "crowd-splits")
    few, crowded = (left.filter(c).join(worth.filter("splits").select("crowd"), "crowd").select(*on) for c in (F.col("apart") <= CROWD, F.col("apart") > CROWD))
    lists_n = left.count()
    a = join_hot(lists, few, on, "cls", at_most=lists_n)
    a, b = (a.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "comp", "n", "band"))) for x in "ab")
    apart = (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("u") == F.least("band_a", "band_b"))
    pairs = a.join(b, on).filter(apart & _close("n_a", "n_b", percent)).selectExpr(*_PAIR)
    units = join_hot(lists, crowded, on, "cls", at_most=lists_n).select(F.xxhash64(*on).alias("unit"), "cls", "comp", "n")
    return pairs, units, join_hot(own, worth.filter("not splits").select("crowd"), ["crowd"], "cls", at_most=many)


def _crowd_blocks(documents: DataFrame, classes: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of crowds (cls, comp, n, crowd), block by block: a crowd's largest component with its other classes, and those with each other."""
    count = own.count()
    sizes = own.groupBy("crowd", "comp").agg(F.count("*").alias("m"))
    major = sizes.groupBy("crowd").agg(F.max_by("comp", "m").alias("major"))
    rows = join_hot(own, major, ["crowd"], "cls", at_most=count).withColumn("kind", (F.col("comp") == F.col("major")).cast("int")).withColumn("band", _size_band("n")(percent))
    rows = durable(rows, "crowd-rows")
    many = rows.groupBy("crowd", "kind", "band").agg(F.greatest(F.ceil(F.sum("n") / BUCKET_TOKENS), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("many"))
    # at each band what can link with it: at most two kinds in three bands
    near = many.select("crowd", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"), F.struct("kind", "band", "many").alias("x"))
    near = durable(near.groupBy("crowd", F.col("at").alias("band")).agg(F.collect_list("x").alias("near")), "crowd-bands")
    own_many = F.element_at(F.filter("near", lambda x: (x["kind"] == F.col("kind")) & (x["band"] == F.col("band"))), 1)["many"]
    rows = join_hot(rows, near, ["crowd", "band"], "cls", at_most=3 * count).withColumn("block", F.pmod(F.xxhash64("cls"), own_many).cast("int"))
    # each class stands in its block's pairs with all blocks that can link with it; pairs within the largest component are linked already
    others = F.filter("near", lambda x: (F.col("kind") + x["kind"]) < 2)
    others = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["many"] - 1), lambda i: F.struct(x["kind"].alias("kind"), x["band"].alias("band"), i.cast("int").alias("block")))))
    spread = rows.select("cls", "comp", "crowd", F.struct("kind", "band", "block").alias("x"), F.explode(others).alias("y"))
    side = F.when(F.col("x") < F.col("y"), "l").when(F.col("x") > F.col("y"), "r").otherwise("b")
    spread = spread.select("cls", "comp", side.alias("side"), F.xxhash64("crowd", F.least("x", "y"), F.greatest("x", "y")).alias("place"))
    spread = durable(spread.withColumn("bucket", F.pmod("place", F.lit(2**31 - 1)).cast("int")), "crowd-places")
    # buckets that by chance have one number are told apart by their places
    sets = _send_sets(documents, classes, spread.select("cls", "bucket"), k)
    several = lambda members, sets: pa.concat_tables([_crowd_links(members.filter(pa.compute.equal(members.column("place"), p)), sets, percent) for p in members.column("place").unique()] or [_LINKS.empty_table()])
    return spread.select("bucket", "place", "cls", "comp", "side").groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInArrow(tidy(several), "u long, v long")


def _verify(documents: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, orders) -> DataFrame:
    """The pairs (a, b, na, nb) that link: those whose prefixes under the second order share a token are compared on their whole sets."""

    def share(a: bytes, b: bytes, na: int, nb: int) -> bool:
        return _shared(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) > 0

    def link(a: bytes, b: bytes, na: int, nb: int) -> bool:
        inter = _shared(_long(a), _long(b))
        return 100 * inter >= percent * (na + nb - inter)

    passed = durable(_met(documents, classes, pairs, k, _second_prefix(percent, orders), share, (100 - percent) / 100), "pairs-passed")
    return _met(documents, classes, passed, k, _short, link, 1.0).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _met(documents: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, packed, keep, weight: float) -> DataFrame:
    """The pairs (a, b, na, nb) that ``keep`` (of both sets as ``packed``, and their sizes) holds for. The sets are made from their texts and
    meet in buckets: pairs of the same ``a`` together, in several buckets if their sets, of which ``weight`` is sent, are large or many."""
    load = pairs.groupBy("a").agg(((F.sum("nb") + F.max("na")) * weight).alias("load"))
    load = durable(load.select("a", "load", F.ceil(F.col("load") / BUCKET_TOKENS).alias("parts")), "pairs-load")
    total = load.agg(F.count("*").alias("n"), F.sum("load").alias("load")).first()
    many = max(partitions(documents.sparkSession), int(total.load or 0) // BUCKET_TOKENS + 1)
    dealt = join_hot(pairs, load.select("a", "parts"), ["a"], "b", at_most=total.n)
    dealt = durable(dealt.select("a", "b", "na", "nb", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(many)).cast("int").alias("bucket")), "pairs-dealt")
    places = dealt.select(F.col("a").alias("cls"), "bucket").union(dealt.select(F.col("b").alias("cls"), "bucket")).distinct()
    sets = _send_sets(documents, classes, places, k, packed)

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        known = {key: raw.as_buffer() for key, raw in zip(sets.column("cls").to_pylist(), sets.column("tokens"))}
        ok = [keep(known[a], known[b], na, nb) for a, b, na, nb in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "na", "nb")))]
        return pairs.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return dealt.groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInArrow(tidy(compare), "a long, b long, na int, nb int")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many tokens two sorted sets share."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def jaccard_components(documents: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows of the same set) for every document. Two documents link when
    100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles."""
    return _component_rows(documents, k, percent).select("doc_id", "n_shingles", "component_id", "n_copies")


def _component_rows(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """What ``jaccard_components`` gives, with cls and chief: whether cls names its component (null for an empty set)."""
    with Scratch() as scratch:
        return _found_rows(documents, k, percent, scratch)


def _found_rows(documents: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    orders = documents.sparkSession.sparkContext.broadcast(frequent_tokens(documents, k))
    table = durable(prefix_table(documents, k, percent, orders), "prefixes")
    # the rows of hot classes meet as partial sums
    classes = scratch.keep(durable(table.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes"))
    postings = table.filter("lead").select("cls", "n", F.posexplode("p1").alias("pos", "token"))
    hot = F.shiftrightunsigned("token", 58) > HOT_LEVEL

    def shared(postings: DataFrame) -> DataFrame:
        """Tokens of several classes: the least of these and its size, and how many postings there are."""
        found = postings.groupBy("token").agg(F.min(F.struct("cls", "n", "pos")).alias("low"), F.max("cls").alias("most"), F.count("*").alias("m")).filter("low.cls < most")
        return found.select("token", F.col("low.cls").alias("least"), F.col("low.n").alias("least_n"), "m")

    def met(postings: DataFrame, tokens: DataFrame) -> DataFrame:
        # a class that leads in several tasks has its rows once
        rest = [F.min(c).alias(c) for c in ("n", "pos", "least", "least_n", "m")]
        return postings.join(tokens, "token").groupBy("token", "cls").agg(*rest)

    # one shuffle serves both the count and the join
    total = table.filter("lead").agg(F.sum(F.size("p1"))).first()[0] or 0
    cold = postings.filter(~hot).repartition(max(partitions(documents.sparkSession), total // PARTITION_TOKENS), "token")
    rows = durable(met(cold, shared(cold)), "shared-tokens")
    hot_tokens = durable(shared(postings.filter(hot)), "hot-tokens")
    rows = rows.union(durable(met(postings.filter(hot), F.broadcast(hot_tokens)), "hot-postings"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with Scratch() as inner:
            return inner.keep(durable(_verify(documents, classes, pairs, k, percent, orders), name))

    star = rows.filter("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"), F.col("least_n").alias("na"), F.col("n").alias("nb"))
    star = durable(star.filter(_close("na", "nb", percent)).distinct(), "star-pairs")
    first = verified(star, "links-star")
    comps = components(first)

    placed = rows.join(comps, rows.cls == comps.node, "left").select("token", "cls", "n", "pos", "m", F.coalesce("comp", "cls").alias("comp"))
    # unit u holds the bands u and u + 1
    full = placed.filter(F.col("m") * (F.col("m") - 1) > 2 * CROWD).withColumn("band", _size_band("n")(percent)).withColumn("u", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    lists = durable(_apart(full, ["token", "u"]), "lists")
    full = durable(join_hot(full, lists, ["token", "u"], "cls", at_most=lists.count()), "placed")
    crowd = full.filter(F.col("apart") > CROWD).select(F.xxhash64("token", "u").alias("unit"), "cls", "comp", "n")
    split, third = star.limit(0), first.limit(0)
    if crowd.limit(1).count():
        with Scratch() as inner:
            own = _crowded(crowd)
            split, units, whole = _split(documents, classes, own, own.count(), k, percent, orders)
            split = inner.keep(durable(split, "pairs-split"))
            cols = ["cls", "comp", "n", "crowd"]
            whole = durable(whole.select(*cols).union(_crowded(units).select(*cols)) if units.limit(1).count() else whole.select(*cols), "crowd-whole")
            third = inner.keep(durable(_crowd_blocks(documents, classes, whole, k, percent), "links-crowds"))

    def pairs_of(few: DataFrame, on: list[str], once) -> DataFrame:
        a, b = (few.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in few.columns if c not in on)) for x in "ab")
        # the sets can still overlap enough if this is the first token that their prefixes share, and one earlier would tell as much
        reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
        apart = (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & once
        return a.join(b, on).filter(apart & _close("n_a", "n_b", percent) & reach).selectExpr(*_PAIR)

    small = placed.filter(F.col("m") * (F.col("m") - 1) <= 2 * CROWD).select("token", "cls", "n", "pos", "comp")
    banded = full.filter(F.col("apart") <= CROWD).select("token", "u", "cls", "n", "pos", "comp", "band")
    pairs = pairs_of(small, ["token"], F.lit(True)).union(pairs_of(banded, ["token", "u"], F.col("u") == F.least("band_a", "band_b"))).union(split).distinct()
    pairs = durable(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"), "cross-pairs")
    second = verified(pairs, "links-cross")
    comps = components(first.union(second).union(third))
    linked = comps.count()

    # a class that is linked with none names itself; of linked ones the smallest id names, a null one only where there is no other
    with_rep = comps.withColumnRenamed("node", "cls").join(classes.select("cls", "rep", "copies"), "cls")
    lowest = with_rep.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")).alias("low"))
    named = join_hot(with_rep, lowest, ["comp"], "cls", at_most=linked).select("cls", F.col("low.rep").alias("component_id"), (F.col("cls") == F.col("low.cls")).alias("chief"), "copies")
    alone = classes.filter("copies > 1").join(comps, classes.cls == comps.node, "left_anti").select("cls", F.col("rep").alias("component_id"), F.lit(True).alias("chief"), "copies")
    named = scratch.keep(durable(named.union(alone), "named"))
    own = scratch.keep(durable(table.select("doc_id", "cls", F.col("n").cast("long").alias("n_shingles")), "rows"))
    found = join_hot(own, named, ["cls"], "doc_id", at_most=named.count(), how="left")
    orders.destroy()
    chief = F.coalesce("chief", F.col("cls").isNotNull())
    return found.select("doc_id", "cls", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), chief.alias("chief"))


def _with_class(documents: DataFrame, k: int) -> DataFrame:
    """``documents`` and ``_cls``, the class of each row's set (null if empty)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "_cls long"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                sets = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                cls = pa.array([_name(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, cls], [*batch.schema.names, "_cls"])

    return documents.mapInArrow(tidy(name), schema)


def keep_one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without all but one row of each component: a row of the class that names it, under the component's id, the smallest
    text first. Rows with an empty set are copies of nothing and stay. Most rows are told by their id; those of a repeated or null id by
    the class of their text. Texts are shuffled only where the ids to drop are too many to broadcast, and for these odd rows."""
    found = durable(_component_rows(documents, k, percent).select("doc_id", "cls", "component_id", "chief"), "components-of-rows")
    kept = F.col("cls").isNull() | (F.col("chief") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(kept).alias("kept"), F.count("*").alias("many"))
    odd = durable(ids.filter("not kept or many > 1"), "odd-ids").select(F.col("doc_id").alias("odd_id"), "many")
    repeated = odd.filter("many > 1").select("odd_id")
    own = F.col("doc_id").cast("long")
    chiefs = found.filter(F.col("chief") & kept)
    chiefs = chiefs.filter("doc_id is null").union(chiefs.join(repeated, F.col("doc_id") == F.col("odd_id"), "left_semi"))
    chiefs = durable(chiefs.select(F.col("cls").alias("_chief"), F.col("doc_id").alias("_rep")).distinct(), "chiefs-of-odd-rows")
    if odd.count() <= BROADCAST_IDS:
        odd, repeated = F.broadcast(odd), F.broadcast(repeated)
    if chiefs.count() <= BROADCAST_IDS:
        chiefs = F.broadcast(chiefs)
    once = documents.filter(own.isNotNull()).join(odd, own == F.col("odd_id"), "left_anti")
    rest = documents.join(repeated, own == F.col("odd_id"), "left_semi").union(documents.filter(own.isNull()))
    rest = _with_class(rest, k)
    first = rest.join(chiefs, (F.col("_cls") == F.col("_chief")) & own.eqNullSafe(F.col("_rep")))
    row = F.struct(*documents.columns)  # compared as text and JSON, for maps have no order
    first = first.groupBy("_cls").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row"))
    return once.unionByName(first.select("_row.*")).unionByName(rest.filter("_cls is null").drop("_cls"))
