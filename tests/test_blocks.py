"""Blocked search, the stored cell index and search within groups against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogmill.operators import blocks, vectors
from dialogmill.plans import base


def unit(rng, n, dim=16, around=None):
    v = rng.normal(size=(n, dim)) if around is None else around[rng.integers(0, len(around), n)] + 0.15 * rng.normal(size=(n, dim))
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def frame(spark, ids, v, id_="id", col="kv"):
    return spark.createDataFrame([(int(i), None if x is None else [float(y) for y in x]) for i, x in zip(ids, v)], f"{id_} long, {col} array<double>")


def brute(qids, q, ids, v, k, others=False, far=False):
    out = {}
    for i, x in zip(qids, q):
        score = -np.sqrt(((v - x) ** 2).sum(axis=1)) if far else (v * x).sum(axis=1)
        rows = sorted((-s, n) for s, n in zip(score, ids) if not (others and n == i))
        out[i] = [n for _, n in rows[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("around", [None, 12])
def test_nearest(spark, around, monkeypatch):
    rng = np.random.default_rng(3)
    v = unit(rng, 3000, around=None if around is None else unit(rng, around))
    v[100:160] = v[50]  # ties
    ids = rng.permutation(3000)
    q = v[:40]
    want = brute(ids[:40], q, ids, v, 7, others=True)
    kb, qs = frame(spark, ids, v).repartition(3), frame(spark, ids[:40], q, "query_id", "qv")
    assert lists(blocks.nearest(qs, kb, 7, others=True)) == want
    monkeypatch.setattr(blocks, "QUERY_BYTES", 16 * 8 * 9)  # several blocks of queries
    monkeypatch.setattr(blocks, "PRODUCT", 2000)
    assert lists(blocks.nearest(qs, kb, 7, others=True)) == want
    pairs = blocks.all_pairs(qs, kb, others=True)
    assert pairs.count() == 40 * 2999 and pairs.select("query_id", "id").distinct().count() == 40 * 2999
    assert "k = 0" not in pairs._jdf.queryExecution().toString() and "Join" not in pairs._jdf.queryExecution().toString()


def test_groups_are_skipped_but_none_that_counts():
    rng = np.random.default_rng(4)
    v = unit(rng, 16, 32)[rng.integers(0, 16, 4000)] + 0.03 * rng.normal(size=(4000, 32))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    q = v[:8]
    import pyarrow as pa

    best = blocks.Best(8, 5)
    compared = sum(blocks.meet(best, q, None, v[a : a + 1000], pa.array(range(a, a + 1000)), None, None) for a in range(0, 4000, 1000))
    assert compared < 0.5 * 8 * 4000
    got = {}
    for x, n in zip(best.table["q"].to_pylist(), best.table["id"].to_pylist()):
        got.setdefault(x, []).append(n)
    assert got == brute(range(8), q, range(4000), v, 5)


def test_nearest_odd_rows(spark):
    v = [None, [1.0, 0.0], [0.0, 0.0], [float("nan"), 1.0], [1.0], [0.6, 0.8], [0.6, 0.8], [-1.0, 0.0]]
    kb = frame(spark, [1, 2, 3, 4, 5, 6, 6, 7], v).selectExpr("*", "1 as score", "2 as rank", "3 as q")
    qs = frame(spark, [2, 9, 8, 10], [[1.0, 0.0], None, [0.0, 0.0], [float("inf"), 0.0]], "query_id", "qv").selectExpr("*", "5 as id")
    assert lists(blocks.nearest(qs, kb, 9)) == {2: [2, 6, 6, 3, 7], 8: [2, 3, 6, 6, 7]}
    assert lists(blocks.nearest(qs, kb, 9, others=True))[2] == [6, 6, 3, 7]
    assert blocks.nearest(qs.limit(0), kb, 3).count() == 0 and blocks.nearest(qs, kb.limit(0), 3).count() == 0
    nameless = kb.filter("id = 2").select(F.lit(None).cast("long").alias("id"), "kv").union(kb.filter("id = 7").select("id", "kv"))
    assert lists(blocks.nearest(qs, nameless, 3)) == {2: [None, 7], 8: [None, 7]} or lists(blocks.nearest(qs, nameless, 3)) == {2: [None, 7], 8: [7, None]}


@pytest.mark.parametrize("around", [None, 60])
def test_cells_recall(spark, around):
    """12,000 vectors, without structure and in clusters: the measured probes give at least 0.9, the exact way gives all."""
    rng = np.random.default_rng(5)
    v = unit(rng, 12_000, around=None if around is None else unit(rng, around))
    v[:3000] = v[0]  # a quarter in one cell
    kb = frame(spark, range(12_000), v).repartition(8)
    asked = [i for i in range(12_000) if i % 100 == 7]
    qs = frame(spark, asked, v[asked], "query_id", "qv")
    index = blocks.build_cells(kb, base.folder(spark), cells=80)
    assert index.recall >= 0.95 and index.vectors(spark).count() == 12_000
    full = lists(blocks.nearest(qs, kb, 5, others=True))
    assert blocks.CellIndex.open(spark, index.path) == index
    some = lists(blocks.search_cells(qs, index, 5, others=True))
    assert sum(len(set(full[q]) & set(some.get(q, []))) for q in full) >= 0.9 * sum(map(len, full.values()))
    assert lists(blocks.search_cells(qs, index, 5, others=True, exact=True)) == full
    if around:
        assert index.probes < 20
        plan = blocks._cells_of(index.vectors(spark), np.eye(80, dtype=bool)[:1])._jdf.queryExecution().toString()
        assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "PartitionFilters: [isnotnull(cell" in plan


def test_empty_index(spark):
    index = blocks.build_cells(frame(spark, [], []), base.folder(spark))
    assert blocks.search_cells(frame(spark, [1], [[1.0]], "query_id", "qv"), index, 3).count() == 0


def test_sessions_are_split(spark, monkeypatch):
    """One session holds half of all rows: its chunks and queries are dealt into parts."""
    monkeypatch.setattr(blocks, "GROUP_ROWS", 100)
    rng = np.random.default_rng(6)
    v, session = unit(rng, 1500), np.where(rng.random(1500) < 0.5, 0, rng.integers(1, 20, 1500))
    rows = frame(spark, range(1500), v).join(spark.createDataFrame([(i, int(s)) for i, s in enumerate(session)], "id long, session_id long"), "id")
    asked = rows.filter("id % 4 = 0").select(F.col("id").alias("query_id"), "session_id", F.col("kv").alias("qv"))
    got = blocks.nearest_in_group(asked, rows, "session_id", 3, others=True)
    want = {}
    for s in set(session):
        own = np.flatnonzero(session == s)
        want |= brute([i for i in own if i % 4 == 0], v[[i for i in own if i % 4 == 0]], own, v[own], 3, others=True, far=True)
    assert lists(got) == {k: x for k, x in want.items() if x}
    odd = rows.limit(3).withColumn("session_id", F.lit(None).cast("long"))
    assert blocks.nearest_in_group(asked, odd, "session_id", 3).count() == 0


def test_retrieve_with_an_index(spark):
    rng = np.random.default_rng(7)
    v = unit(rng, 400, around=unit(rng, 5))
    kb = frame(spark, range(400), v).select("id", "kv", F.lit("s").alias("source"), F.concat(F.lit("text "), "id").alias("text"))
    qs = frame(spark, [3, 9], v[[3, 9]], "query_id", "qv")
    plain = vectors.retrieve(qs, kb, 10, 3, 0.1)
    index = blocks.build_cells(kb.select("id", "kv"), base.folder(spark), cells=5)
    index.probes = 5
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, vectors.retrieve(qs, kb, 10, 3, 0.1, index=index).collect()))
