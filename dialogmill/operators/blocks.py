"""Nearest vectors by matrix products of Arrow blocks, and a stored index of cells.

The queries of one pass are a bounded block (``QUERY_BYTES``; more queries are more passes); the knowledge base is read where it lies, and
each task keeps the k best per query, so nothing of it is gathered and no row is a hot key. Within a batch, rows form groups around a centre
(the stored cells, or the nearest of a few pivots); a group whose angle from a query can't reach the query's k-th score is skipped, which
changes no result: two unit vectors that are a and r away from a centre are at least a - r away from each other.

Products of matrices may differ in the last bits by where a row stands, so they only choose candidates; scores are sums over one pair in a
fixed order, and equal vectors have equal scores.

Defined cases: a null vector, one with a null or non-finite component, and one whose length is not that of the first query take no part;
equal scores go by ascending id; rows that share an id are candidates each; empty sides give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of the query vectors of one pass, entries of a matrix product, and groups that a batch without cells is split into.
QUERY_BYTES, PRODUCT, PIVOTS = 4 << 20, 1 << 22, 16
#: By how much a product may differ from the sum over the pair.
SLACK = 1e-9


def matrix(col: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are finite vectors of ``dim`` components (of the first one's, if None), and their places."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    sizes = pc.fill_null(pc.list_value_length(col), -1).to_numpy()
    if dim is None:
        dim = next((int(n) for n in sizes if n > 0), 0)
    at = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    flat = col.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    fine = np.isfinite(flat).all(axis=1)
    return flat[fine], at[fine]


def top_k(pairs: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best per group with ``rank`` from 1. Spark cuts each partition to k rows a group before the shuffle (window group limit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """``queries`` (query_id, qv) in tables of about ``QUERY_BYTES`` of vectors."""
    size = queries.agg(F.sum(F.size("qv").cast("long") * 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        yield part.select("query_id", "qv").toArrow()


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.table = k, None
        self.kth = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        fresh = pa.table({"q": pa.array(query, pa.int64()), "score": pa.array(score, pa.float64()), "id": ids})
        both = fresh if self.table is None else pa.concat_tables([self.table, fresh])
        both = both.take(pc.sort_indices(both, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        q = both["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.table = both.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.kth[q[last]] = both["score"].to_numpy()[last]


def are_unit(rows: np.ndarray) -> bool:
    """Whether all vectors have length 1, or 0 (those score 0 and meet the bound as if they stood at a right angle)."""
    squares = (rows * rows).sum(axis=1)
    return bool(((np.abs(squares - 1) < 1e-6) | (squares == 0)).all())


def _groups(rows: np.ndarray, unit: bool) -> list[np.ndarray]:
    """Places of rows by the nearest of a few of them."""
    if not unit or len(rows) < 8 * PIVOTS:
        return [np.arange(len(rows))]
    nearest = np.argmax(rows @ rows[:: max(1, len(rows) // PIVOTS)].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(nearest[order])) + 1)


def meet(best: Best, qs: np.ndarray, allowed: np.ndarray | None, rows: np.ndarray, ids: pa.Array, own: np.ndarray | None, own_q: np.ndarray | None, far: bool = False, unit: bool = True) -> int:
    """Add what ``rows`` hold for the queries at ``allowed`` (None: all) to ``best``; how many pairs were compared. ``own``/``own_q``: codes of
    ids, equal ones are not compared. ``far``: the score is the negative distance, else the product. ``unit``: the queries are unit vectors."""
    compared, unit = 0, unit and not far and are_unit(rows)
    everyone = np.arange(len(qs)) if allowed is None else allowed
    groups = _groups(rows, unit)
    turns = [(g, everyone, None) for g in groups]
    if unit:
        # first each query meets its nearest group, then every other one that its k-th score doesn't rule out
        centres = np.array([rows[g].sum(axis=0) for g in groups])
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-300)
        wide = np.array([angles((rows[g] @ c).min()) for g, c in zip(groups, centres)])
        cosines = qs[everyone] @ centres.T
        reach = np.cos(np.maximum(0.0, angles(cosines) - wide))
        first = np.argmax(cosines, axis=1)
        turns = [(g, everyone[first == i], None) for i, g in enumerate(groups)] + [(g, everyone[first != i], reach[first != i, i]) for i, g in enumerate(groups)]
    for group, use, bound in turns:
        if bound is not None:
            use = use[bound + SLACK >= best.kth[use]]
        v = rows[group]
        step = max(16, PRODUCT // max(1, len(use)))
        for a in range(0, len(v) if len(use) else 0, step):
            part, at = v[a : a + step], group[a : a + step]
            q = qs[use]
            scores = part @ q.T
            compared += scores.size
            if far:
                scores = -np.sqrt(np.maximum(0.0, (part * part).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * scores))
            if own is not None:
                scores[own[at][:, None] == own_q[use][None, :]] = -np.inf
            slack = SLACK if not far else 1e-6
            least = best.kth[use]
            if len(part) > best.k:
                least = np.maximum(least, np.partition(scores, len(part) - best.k, axis=0)[len(part) - best.k])
            r, c = np.nonzero((scores >= least[None, :] - slack) & (scores > -np.inf))
            if not len(r):
                continue
            diff = part[r] - q[c] if far else None
            exact = -np.sqrt((diff * diff).sum(axis=1)) if far else (part[r] * q[c]).sum(axis=1)
            best.add(use[c], exact, ids.take(pa.array(at[r])))
    return compared


def _codes(ids: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(ids, value_set=known), -1).to_numpy(zero_copy_only=False)


def nearest(queries: DataFrame, kb: DataFrame, k: int, others: bool = False, probed: np.ndarray | None = None, table: pa.Table | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows of ``kb`` (id, kv) with the greatest products, per query (query_id, qv); unit vectors. ``others``: not the row of the
    query's own id. ``probed`` and ``table`` (of one block of queries): which cells each query looks into, ``kb`` holding ``cell`` as well."""
    spark = kb.sparkSession
    query_type, id_type = queries.schema["query_id"].dataType.simpleString(), kb.schema["id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    found = None
    for block in [table] if table is not None else query_blocks(queries):
        qs, at = matrix(block["qv"])
        names = block["query_id"].combine_chunks().take(pa.array(at)) if len(at) else None
        if not len(at):
            continue

        def search(batches: Iterator[pa.RecordBatch], qs=qs, names=names) -> Iterator[pa.RecordBatch]:
            best, dim, unit = Best(len(qs), k), qs.shape[1], are_unit(qs)
            known = pc.unique(names) if others else None
            own_q = _codes(names, known) if others else None
            for batch in batches:
                rows, places = matrix(batch.column("kv"), dim)
                if not len(rows):
                    continue
                ids = batch.column("id").take(pa.array(places))
                own = _codes(ids.cast(known.type), known) if others else None
                if own is not None:
                    own = np.where(own < 0, -2, own)  # ids that no query has
                cells = batch.column("cell").to_numpy()[places] if probed is not None else np.zeros(len(rows), int)
                for cell in np.unique(cells):
                    inside = np.flatnonzero(cells == cell)
                    allowed = np.flatnonzero(probed[:, cell]) if probed is not None else None
                    if allowed is None or len(allowed):
                        meet(best, qs, allowed, rows[inside], ids.take(pa.array(inside)), None if own is None else own[inside], own_q, unit=unit)
            if best.table is not None:
                t = best.table.combine_chunks()
                for b in t.to_batches():
                    yield pa.RecordBatch.from_arrays([names.take(b["q"]), b["id"], b["score"]], ["query_id", "id", "score"])

        columns = ["id", "kv"] + (["cell"] if probed is not None else [])
        part = kb.select(*columns).mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return top_k(found, k)


def all_pairs(queries: DataFrame, kb: DataFrame, others: bool = False) -> DataFrame:
    """query_id, id, score of each query with each row of ``kb``: as many rows as that, block by block."""
    spark = kb.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kb.schema['id'].dataType.simpleString()}, score double"
    found = spark.createDataFrame([], schema)
    for block in query_blocks(queries):
        qs, at = matrix(block["qv"])
        if not len(at):
            continue
        names = block["query_id"].combine_chunks().take(pa.array(at))

        def pairs(batches: Iterator[pa.RecordBatch], qs=qs, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, places = matrix(batch.column("kv"), qs.shape[1])
                step = max(1, PRODUCT // qs.size)
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    scores = (part[:, None, :] * qs[None, :, :]).sum(axis=2)
                    ids = batch.column("id").take(pa.array(np.repeat(places[a : a + step], len(qs))))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.tile(np.arange(len(qs)), len(part)))), ids, pa.array(scores.ravel())], ["query_id", "id", "score"])

        found = found.union(kb.select("id", "kv").mapInArrow(pairs, schema))
    return found.filter(~F.col("query_id").eqNullSafe(F.col("id"))) if others else found


#: Terms with counts of the passages of one pass, and pairs of a query's and a passage's term that a task holds at once.
PASSAGE_TERMS, MEETINGS = 500_000, 2_000_000


def _bags(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, counts and row of each entry of a column of term counts, and the norm of each row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    flat = col.flatten()
    counts = flat.field("n").cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return flat.field("t"), counts, row, np.sqrt(np.bincount(row, counts * counts, minlength=len(sizes)))


def nearest_bags(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """query_id, id, score (rounded to 10 places, so that the order of sums decides nothing), rank: the k ``passages`` (id, bag) of the greatest
    cosine per query (query_id, bag) among those that share a term; equal scores by ascending id. Passages come in blocks of about ``PASSAGE_TERMS``, a pass over
    the queries each. Null and empty bags find nothing."""
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {passages.schema['id'].dataType.simpleString()}, score double"
    many = passages.agg(F.sum(F.size("bag").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(many / PASSAGE_TERMS))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = passages if blocks == 1 else passages.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        block = part.select("id", "bag").orderBy("id").toArrow()  # so that a passage's place follows its id
        terms, counts, row, norms = _bags(block["bag"])
        names = pc.unique(terms)
        if not len(names):
            continue
        code = pc.index_in(terms, value_set=names).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], np.arange(len(names) + 1))
        held, weight, ids = row[order], counts[order], block["id"].combine_chunks()

        def search(batches: Iterator[pa.RecordBatch], names=names, at=at, held=held, weight=weight, ids=ids, norms=norms) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms, counts, row, own = _bags(batch.column("bag"))
                code = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(code >= 0)
                sizes = at[code[known] + 1] - at[code[known]]
                ends = np.cumsum(sizes)
                # cut between queries, so that a query's meetings stay together
                first = np.searchsorted(row[known], np.arange(len(own) + 1))
                before = np.concatenate(([0], ends))[first]
                a = 0
                while a < len(own):
                    z = max(a + 1, int(np.searchsorted(before, before[a] + MEETINGS, side="right")) - 1)
                    use = slice(first[a], first[z])
                    entry = np.repeat(known[use], sizes[use])
                    start = np.repeat(at[code[known[use]]] - (ends[use] - sizes[use]) + (before[a]), sizes[use])
                    place = start + np.arange(len(entry))
                    pairs, inverse = np.unique(row[entry] * len(norms) + held[place], return_inverse=True)
                    dots = np.bincount(inverse, counts[entry] * weight[place], minlength=len(pairs))
                    q, p = np.divmod(pairs, len(norms))
                    score = np.round(dots / (own[q] * norms[p]), 10)
                    best = np.lexsort((p, -score, q))
                    keep = best[np.arange(len(best)) - np.searchsorted(q[best], q[best]) < k]
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q[keep])), ids.take(pa.array(p[keep])), pa.array(score[keep])], ["query_id", "id", "score"])
                    a = z

        found = found.union(queries.select("query_id", "bag").mapInArrow(search, schema))
    return top_k(found, k)


#: Rows of a group's chunks, and of its queries, that one task compares.
GROUP_ROWS = 4096


def nearest_in_group(queries: DataFrame, rows: DataFrame, by: str, k: int, others: bool = False) -> DataFrame:
    """query_id, id, score (the negative distance), rank: the k ``rows`` (id, kv) of a query's own group ``by`` that are nearest to it. A group is dealt into
    parts of about ``GROUP_ROWS`` rows, and so are its queries; every part of the one meets every part of the other in a task of its own, k rows a query
    are left there, and those meet. A null group has no rows."""
    parts = lambda df, to: df.filter(f"{by} is not null").groupBy(by).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(to))
    sizes = parts(queries, "q_parts").join(parts(rows, "r_parts"), by)
    dealt = lambda df, key, own, other, mine, theirs: (
        df.join(sizes, by).withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    left = dealt(queries.select(by, "query_id", "qv"), "query_id", "q_parts", "r_parts", "qp", "rp").select(F.col(by).alias("g"), "qp", "rp", "query_id", "qv")
    right = dealt(rows.select(by, "id", "kv"), "id", "r_parts", "q_parts", "rp", "qp").select(F.col(by).alias("g"), "qp", "rp", "id", "kv")

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        qs, at = matrix(asked["qv"])
        found, places = matrix(held["kv"], qs.shape[1])
        names, ids = asked["query_id"].combine_chunks().take(pa.array(at)), held["id"].combine_chunks().take(pa.array(places))
        best = Best(len(qs), k)
        if len(qs) and len(found):
            known = pc.unique(names)
            own = _codes(ids.cast(known.type), known) if others else None
            meet(best, qs, None, found, ids, None if own is None else np.where(own < 0, -2, own), _codes(names, known) if others else None, far=True)
        if best.table is None:
            return pa.table({"query_id": names.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table({"query_id": names.take(best.table["q"].combine_chunks()), "id": best.table["id"], "score": best.table["score"]})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return top_k(left.groupBy("g", "qp", "rp").cogroup(right.groupBy("g", "qp", "rp")).applyInArrow(near, schema), k)


# ---- the stored index ----

#: Rows that the centres are fitted on (at most twice as many), the most cells, and vectors that the number of probes is measured with.
SAMPLE, MOST_CELLS, TRIALS = 50_000, 4096, 64


@dataclass
class CellIndex:
    """An index under ``path``: ``vectors`` (of ``schema``) partitioned by cell, ``centres`` (cell, cv, n, radius), and ``about``, this row.
    ``probes`` cells hold ``recall`` of the trial vectors' neighbours."""

    path: str
    schema: str
    probes: int
    recall: float

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(path, **spark.read.parquet(f"{path}/about").first().asDict())

    def save(self, spark: SparkSession) -> CellIndex:
        spark.createDataFrame([(self.schema, self.probes, self.recall)], "schema string, probes int, recall double").coalesce(1).write.parquet(f"{self.path}/about")
        return self

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def centres(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
        """Centres (unit vectors) and radii (angles), by cell; a bounded table."""
        t = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()
        return matrix(t["cv"])[0], t["radius"].to_numpy()


def build_cells(kb: DataFrame, path: str, cells: int | None = None, k: int = 5, target: float = 0.95, sample: int = SAMPLE, seed: int = 1) -> CellIndex:
    """Write an index of ``kb`` (id, kv: unit vectors) under ``path``. Centres come from K-means over a sample of about ``sample`` rows by the hash of their id;
    every row is placed by its nearest centre. A crowded cell is many files (rebalanced), and a cell's files are read only by queries that
    probe it. How many cells a query must probe is measured: ``TRIALS`` rows are searched exactly, and the least number is taken at which
    ``target`` of their k neighbours are found."""
    spark = kb.sparkSession
    fine = kb.select("id", "kv").filter(F.col("kv").isNotNull())
    n = fine.count()
    cells = cells or min(MOST_CELLS, max(1, math.ceil(math.sqrt(n))))
    drawn = fine.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // sample))) == 0).limit(2 * sample)
    fitted = KMeans(k=cells, seed=seed, maxIter=5, initSteps=1, featuresCol="f").fit(drawn.select(array_to_vector("kv").alias("f"))).clusterCenters() if n else []
    centres = np.array(fitted, float) if len(fitted) else np.zeros((0, 0))
    centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-300)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column("kv"), centres.shape[1])
            cosines = rows @ centres.T
            cell = np.argmax(cosines, axis=1) if len(rows) else np.zeros(0, int)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([out["id"], out["kv"], pa.array(angles(cosines[np.arange(len(rows)), cell])), pa.array(cell, pa.int32())], ["id", "kv", "away", "cell"])

    id_type, kv_type = (kb.schema[c].dataType.simpleString() for c in ("id", "kv"))
    schema = f"id {id_type}, kv {kv_type}, away double, cell int"
    placed = fine.mapInArrow(place, schema) if len(centres) else spark.createDataFrame([], schema)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    if not n:
        spark.createDataFrame([], "cell int, cv array<double>, n long, radius double").write.parquet(f"{path}/centres")
        return CellIndex(path, schema, 0, 1.0).save(spark)
    index = CellIndex(path, schema, len(centres), 1.0)
    stored = index.vectors(spark)
    held = {r.cell: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    spark.createDataFrame([(i, [float(x) for x in c], held[i].n if i in held else 0, held[i].radius if i in held else 0.0) for i, c in enumerate(centres)], "cell int, cv array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/centres")
    trial = stored.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(TRIALS).select(F.col("id").alias("query_id"), F.col("kv").alias("qv"))
    block = trial.toArrow()
    found = search_cells(spark.createDataFrame(block, trial.schema), index, k, others=True, exact=True, first=1).join(stored.select("id", "cell"), "id").select("query_id", "cell").toArrow()
    qs, at = matrix(block["qv"])
    ranks = np.argsort(np.argsort(-(qs @ centres.T), axis=1), axis=1)
    names = {q: i for i, q in enumerate(block["query_id"].take(pa.array(at)).to_pylist())}
    depth = np.sort([ranks[names[q], c] for q, c in zip(found["query_id"].to_pylist(), found["cell"].to_pylist())])
    if len(depth):
        index.probes = int(depth[min(len(depth) - 1, math.ceil(target * len(depth)) - 1)]) + 1
        index.recall = float((depth < index.probes).mean())
    return index.save(spark)


def search_cells(queries: DataFrame, index: CellIndex, k: int, others: bool = False, exact: bool = False, first: int | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best rows in the ``index.probes`` (or ``first``) nearest cells of each query. ``exact``: then also of every cell
    that a better row may lie in, by the angle to its centre less its radius, so the result is that of a search of all rows."""
    spark = queries.sparkSession
    centres, radius = index.centres(spark)
    stored = index.vectors(spark)
    found = None
    for block in query_blocks(queries):
        qs, at = matrix(block["qv"])
        if not len(at) or not len(centres):
            continue
        table = block.take(pa.array(at))
        cosines = qs @ centres.T
        rank = np.argsort(np.argsort(-cosines, axis=1), axis=1)
        probed = rank < (first or index.probes)
        part = nearest(queries, _cells_of(stored, probed), k, others, probed, table)
        if exact and not probed.all():
            part = part.drop("rank")
            rows = part.toArrow()  # k rows a query of one block
            part = spark.createDataFrame(rows, part.schema)
            of: dict = {}
            for q, score in zip(rows["query_id"].to_pylist(), rows["score"].to_pylist()):
                of.setdefault(q, []).append(score)
            least = np.array([min(of[q]) if len(of.get(q, [])) >= k else -np.inf for q in table["query_id"].to_pylist()])
            reach = np.cos(np.maximum(0.0, angles(cosines) - radius[None, :]))
            more = ~probed & (reach + SLACK >= least[:, None])
            if more.any():
                part = part.union(nearest(queries, _cells_of(stored, more), k, others, more, table).drop("rank"))
            part = top_k(part, k)
        found = part if found is None else found.union(part)
    if found is None:
        return nearest(queries, stored.limit(0), k, others)
    return found


def _cells_of(stored: DataFrame, probed: np.ndarray) -> DataFrame:
    """The rows of the cells that any query probes: a filter on the partition column, so other cells' files are not opened."""
    cells = np.flatnonzero(probed.any(axis=0))
    return stored if len(cells) == probed.shape[1] else stored.filter(F.col("cell").isin(cells.tolist()))
