"""Approximate nearest neighbours by cross-polytope hashing.

A table is one or two pseudo-random rotations (three rounds of random signs and a fast Hadamard transform each); a vector's bucket is the
signed axis nearest to its rotated direction, or the pair of them in a table of more than ``PAIRED_FROM`` vectors, so that buckets grow in
number with the table. Each vector stands in one bucket of every table; a query probes the buckets nearest to it in every table. What shares
a probed bucket is reranked by the inner product in double precision.

How many buckets are probed is measured: ``TRIALS`` queries in hash order are compared with all vectors, and the least number is taken at
which their true neighbours stand in probed buckets in the share ``GOAL``. So the recall is about that at any size, and clustered vectors need
few probes.

Equal vectors are one class: a class is hashed and searched once and stands for the k + 1 smallest of its ids, which is all that any
query can need of it. Buckets are split into blocks by salt and a query meets every block, so a hot bucket is many groups of bounded size.

A query whose probed buckets hold too few vectors for a whole list is compared with all of them, block by block.

Vectors of unequal lengths get one more coordinate that makes their norms equal, so that the nearest direction is the largest product.

Defined cases: a vector that is null, zero, of another dimension than most, or that holds a null or non-finite component takes no part;
a null id takes no part; of rows with equal ids and vectors one counts; fewer than k candidates are all returned; ties go to the smaller id; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .runtime import BROADCAST_ROWS, durable, order_hash

TABLES = 8
#: Queries that the number of probes is measured on, and the share of their neighbours that is to be found.
TRIALS, GOAL = 64, 0.97
#: Vectors from which a bucket is a pair of axes.
PAIRED_FROM = 1 << 20
BLOCK_ROWS = 4096
SALTS = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def nearness(x: np.ndarray, table: int, rotations: int, seed: int) -> np.ndarray:
    """How near each row is to each bucket of a table: its product with the signed axis (2 * axis, plus 1 for its negative), or the sum of two."""
    both = []
    for r in range(rotations):
        turned = rotate(x, table * rotations + r, seed)
        signed = np.empty((len(x), 2 * x.shape[1]))
        signed[:, 0::2], signed[:, 1::2] = turned, -turned
        both.append(signed)
    return both[0] if rotations == 1 else (both[0][:, :, None] + both[1][:, None, :]).reshape(len(x), -1)


def buckets(x: np.ndarray, table: int, rotations: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each row."""
    near = nearness(x, table, rotations, seed)
    if probes == 1:
        return near.argmax(1)[:, None]
    return np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes]


def direction(x: np.ndarray, width: int, top: float | None, query: bool) -> np.ndarray:
    """Unit vectors as wide as the transform; ``top`` (the largest norm, if norms differ): one more coordinate makes the index's norms equal."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x / norm if top is None or query else x / top
    if top is not None and not query:
        wide[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / top) ** 2))
    return wide


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), dtype) for x in col]).astype(np.float64) if len(col) else np.zeros((0, 0))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(F.col("v"), lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].d if sizes else 0))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector: cls (its smallest id), v, ids (its ``most`` smallest). Cut down within salted parts first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = salted.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("r") <= most)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, most)
    return first.groupBy("v").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("cls"), "v", "ids")


def _hashed(found: DataFrame, tables: int, rotations: int, probes: int, width: int, top: float | None, seed: int, query: bool, dtype: str) -> DataFrame:
    """(tab, bucket, cls, vec) and, of the index, ids. ``dtype``: as which numbers vectors are sent (four bytes if the given ones had no more)."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1024 if rotations == 1 else 64
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column("v")
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(lists[0]))
                raw = [r.tobytes() for r in x.astype(dtype)]
                wide = direction(x, width, top, query)
                for t in range(tables):
                    near = buckets(wide, t, rotations, probes, seed)
                    many = near.shape[1]
                    take = pa.array(np.repeat(np.arange(len(x)), many))
                    cols = [pa.array(np.full(len(x) * many, t, np.int32)), pa.array(near.ravel().astype(np.int32)), part.column("cls").take(take), pa.array(raw, pa.binary()).take(take)]
                    names = ["tab", "bucket", "cls", "vec"]
                    if not query:
                        cols, names = [*cols, part.column("ids").take(take)], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return found.mapInArrow(hash_rows, "tab int, bucket int, cls long, vec binary" + ("" if query else ", ids array<long>"))


def probes_needed(found: DataFrame, queries: DataFrame, k: int, tables: int, rotations: int, width: int, top: float | None, seed: int, trials: int = TRIALS, goal: float = GOAL) -> int:
    """The least number of probes at which the share ``goal`` of the ``k`` nearest classes of ``trials`` queries is found. Each task keeps its
    own nearest of every trial; the few left of all tasks are collected with their vectors."""
    some = queries.orderBy(order_hash(F.col("cls"), seed=seed), "cls").limit(trials).collect()
    if not some:
        return 1
    q, own = np.array([r.v for r in some]), np.array([r.cls for r in some])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cls, vec = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                ids = part.column("cls").to_numpy()
                s = np.where(ids[None] == own[:, None], -np.inf, q @ x.T)
                pick = np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, :k]
                score = np.concatenate([score, np.take_along_axis(s, pick, 1)], 1)
                cls, vec = np.concatenate([cls, ids[pick]], 1), np.concatenate([vec, x[pick]], 1)
                keep = np.argsort(-score, axis=1)[:, :k]
                score, cls, vec = np.take_along_axis(score, keep, 1), np.take_along_axis(cls, keep, 1), np.take_along_axis(vec, keep[:, :, None], 1)
        row, col = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score[row, col]), pa.array(cls[row, col]), pa.array([v.tobytes() for v in vec[row, col]], pa.binary())], ["q", "score", "cls", "vec"])

    best = found.select("cls", "v").mapInArrow(nearest, "q long, score double, cls long, vec binary")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).filter(F.col("r") <= k).collect()
    if not best:
        return 1
    at = np.array([r.q for r in best])
    x = direction(np.stack([np.frombuffer(r.vec, np.float64) for r in best]), width, top, False)
    wide = direction(q, width, top, True)
    place = []
    for t in range(tables):
        near, its = nearness(wide, t, rotations, seed), np.concatenate([buckets(x[i : i + 64], t, rotations, 1, seed)[:, 0] for i in range(0, len(x), 64)])
        place.append([int((near[i] > near[i, b]).sum()) for i, b in zip(at, its)])
    place = np.sort(np.min(place, axis=0))  # probes before the neighbour's bucket, in the table where it is nearest
    return int(place[min(len(place) - 1, int(np.ceil(goal * len(place))) - 1)]) + 1


def _block_top(k: int, dtype: str):
    """Of one block of queries and vectors: each query's k best (score, then id), exactly scored."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("vec").combine_chunks(), dtype), _matrix(right.column("vec").combine_chunks(), dtype)
            cls = left.column("cls").to_numpy()
            ids = right.column("ids").to_pylist()
            owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            flat = np.array([v for i in ids for v in i], np.int64)
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else s.min(1)
                row, col = np.nonzero(s >= (kth - 1e-9 * np.maximum(1, np.abs(kth)))[:, None])
                exact = (q[a + row] * x[col]).sum(1)
                # expand classes to ids, then cut again
                start, count = np.searchsorted(owner, col), np.bincount(owner, minlength=len(x))[col]
                r = np.repeat(row, count)
                member = np.repeat(start, count) + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                score, vid = np.repeat(exact, count), flat[member]
                order = np.lexsort((vid, -score, r))
                r, score, vid = r[order], score[order], vid[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((cls[a + r[keep]], vid[keep], score[keep]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("cls", "vec_id", "score"), cols)))

    return best


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, paired_from: int = PAIRED_FROM, seed: int = 17, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector for whose id ``is_query`` (a condition on ``vec_id``) holds, the k others nearest by
    inner product among those that share a probed bucket, or among all where these are fewer than k."""
    rows = usable(vectors, vec_id, embedding)
    dtype = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    found = durable(classes(rows, k + 1), "vector-classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    shape = found.agg(F.max(norm).alias("top"), F.min(norm).alias("low"), F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    if shape.d is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    even = shape.top - shape.low <= 1e-3 * shape.top
    top = None if even else shape.top
    width = 1 << max(1, (shape.d + (not even) - 1).bit_length())
    rotations = 1 if shape.n < paired_from else 2
    asked = durable(rows.filter(is_query).distinct().join(found.select("cls", "v"), "v").select(F.col("vec_id").alias("query_id"), "cls"), "vector-queries")
    queries = found.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    probes = probes_needed(found, queries, k, tables, rotations, width, top, seed)
    index = _hashed(found, tables, rotations, 1, width, top, seed, False, dtype)
    probed = _hashed(queries, tables, rotations, probes, width, top, seed, True, dtype)
    # bucket sizes: at most tables * (2 * width) ** rotations rows
    sizes = index.groupBy("tab", "bucket").agg(F.count("*").alias("n")).join(probed.groupBy("tab", "bucket").agg(F.count("*").alias("m")), ["tab", "bucket"])
    sizes = durable(sizes.select("tab", "bucket", F.ceil(F.col("n") / BLOCK_ROWS).alias("xb"), F.ceil(F.col("m") / BLOCK_ROWS).alias("qb")), "vector-buckets")
    salt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["tab", "bucket", "xs", "qs"]
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    left = probed.join(sizes, ["tab", "bucket"]).withColumn("qs", salt("qb", 1)).withColumn("xs", spread("xb")).select(*keys, "cls", "vec")
    right = index.join(sizes, ["tab", "bucket"]).withColumn("xs", salt("xb", 2)).withColumn("qs", spread("qb")).select(*keys, "cls", "vec", "ids")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_top(k + 1, dtype), "cls long, vec_id long, score double")

    def lists(near: DataFrame) -> DataFrame:
        one = near.groupBy("cls", "vec_id").agg(F.max("score").alias("score"))
        top = one.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
        return top.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))

    ranked = durable(lists(near), "vector-lists")
    # with the query itself, a whole list has k + 1 entries
    if ranked.filter(F.size("near") <= k).limit(1).count():
        whole = min(k + 1, found.select(F.explode("ids").alias("id")).distinct().count())
        few = durable(queries.join(ranked.filter(F.size("near") < whole).select("cls"), "cls", "left_semi"), "vector-short-lists")
        xb, qb = (F.lit(-(-df.count() // BLOCK_ROWS) or 1).cast("long").alias(c) for df, c in ((found, "xb"), (few, "qb")))
        bytes_of = lambda df, query: _hashed(df, 1, 1, 1, width, top, seed, query, dtype).drop("tab", "bucket").select("*", xb, qb)
        left = bytes_of(few, True).withColumn("qs", salt("qb", 1)).withColumn("xs", spread("xb")).select("xs", "qs", "cls", "vec")
        right = bytes_of(found, False).withColumn("xs", salt("xb", 2)).withColumn("qs", spread("qb")).select("xs", "qs", "cls", "vec", "ids")
        full = left.groupBy("xs", "qs").cogroup(right.groupBy("xs", "qs")).applyInArrow(_block_top(k + 1, dtype), "cls long, vec_id long, score double")
        ranked = ranked.join(few.select("cls"), "cls", "left_anti").union(lists(full))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = asked.join(ranked, "cls").select("query_id", F.posexplode(others).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
