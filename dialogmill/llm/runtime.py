"""What the operators share: the folder for cut lineage, block iteration over Arrow batches, label folds."""

from __future__ import annotations

import functools
import gc
import inspect
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that one numpy block covers; a longer single text forms a block of its own.
BLOCK_BYTES = 1 << 19
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of our own only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dialogmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation. What the
    write shuffled is not needed again, so Spark is asked to delete it at the write's end instead of at some later collection."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dialogmill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if Scratch._open:
        Scratch._open[-1].tables[path] = spark
    return out


class Scratch:
    """Written tables of a block of code: at its end those that ``keep`` wasn't told of are deleted (their readers must be done), and the
    others belong to the block around it, if any."""

    _open: list[Scratch] = []

    def __init__(self):
        self.tables: dict[str, SparkSession] = {}

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        if self.tables.pop(df.written_at, None) and len(Scratch._open) > 1:
            Scratch._open[-2].tables[df.written_at] = df.sparkSession
        return df

    def discard(self, df: DataFrame) -> None:
        self._delete(df.written_at, self.tables.pop(df.written_at))

    def _delete(self, path: str, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __exit__(self, *_) -> None:
        Scratch._open.pop()
        for path, spark in self.tables.items():
            self._delete(path, spark)
            # broadcasts of plans that are done stay in the memory of driver and executors until the driver's JVM collects what refers to them
            last = spark
        if self.tables:
            gc.collect()
            last._jvm.System.gc()


#: Rows of a few numbers up to which a table is broadcast (some MB).
BROADCAST_ROWS = 200_000


def join_hot(rows: DataFrame, one: DataFrame, on: list[str], by: str, at_most: int | None = None, salts: int = 32, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``one`` (a row of a few numbers a key), where a key may hold most of ``rows``. ``at_most``: a counted bound
    on the rows of ``one``. Where that is small ``one`` is broadcast; else ``rows`` are dealt by a salt of the column ``by``, and a row of
    ``one`` goes to those salts alone at which its key occurs."""
    if at_most is not None and at_most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(one), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = one.join(salted.select(*on, "_salt").distinct(), on)
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def tidy(fn: Callable) -> Callable:
    """The same function of Arrow batches, or of two groups; at its end Arrow's pool in the worker hands back what it holds unused. Workers live on between stages,
    and what the longest texts needed would else stay with each of them."""

    @functools.wraps(fn)
    def run(*args):
        try:
            yield from fn(*args)
        finally:
            pa.default_memory_pool().release_unused()

    def call(left, right):
        try:
            return fn(left, right)
        finally:
            pa.default_memory_pool().release_unused()

    return run if inspect.isgeneratorfunction(fn) else call


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Spark feed Python 4 MB at a time instead of its default of 64 MB, unless the session says otherwise: executor and worker each hold
    several copies of a batch, for every task."""
    if spark.conf.get(_BATCH) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column, nulls as empty texts; no copy of the bytes where Arrow has them whole."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose texts hold at most ``most`` bytes together (a single longer text stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def order_hash(*cols: Column, seed: int = 0) -> Column:
    """A pseudo-random order that depends on the row alone."""
    return F.xxhash64(F.lit(seed), *cols)


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the training rows: held-out ids, null labels and null ids never take part; an id counts once."""
    fold = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fold.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sample_weights(labels: DataFrame, label: str, limit: int) -> dict[int, float]:
    """How many training rows one row of ``labelled_sample`` stands for, by label: 1 where all of a label fit into the sample."""
    counts = labelled_ids(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()
    return {r.y: r.n / min(r.n, limit // 2) for r in counts}


def sample_texts(sample: DataFrame, most: int) -> DataFrame:
    """(doc_id, y, text) of ``labelled_sample``: of rows of one id the one with the least hash of its text, and only texts of at most ``most``
    bytes, so that what a fit collects is bounded. Texts are whole."""
    rows = sample.select("doc_id", "y", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= most)
    one = rows.groupBy("doc_id").agg(F.min(F.struct(order_hash(F.col("text")).alias("h"), "text", "y")).alias("row"))
    return one.select("doc_id", "row.y", "row.text")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int, seed: int = 11) -> DataFrame:
    """At most ``limit`` labelled training rows (doc_id, text, y) in hash order, at most half of them of the rarer label's
    complement: up to ``limit // 2`` rows of each label. Held-out ids, null labels and null ids never take part. The id list
    is bounded by ``limit``, so its broadcast is too; the texts are those of whole documents."""
    spark = documents.sparkSession
    one = labelled_ids(labels, label)
    pick = one.filter("y = 1").orderBy(order_hash(F.col("doc_id"), seed=seed), "doc_id").limit(limit // 2)
    rest = one.filter("y = 0").orderBy(order_hash(F.col("doc_id"), seed=seed), "doc_id").limit(limit // 2)
    ids = spark.createDataFrame(pick.union(rest).toPandas().astype("int64"), "doc_id long, y long")
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
