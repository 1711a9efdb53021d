"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each source has a mean repetition rate, target rows / own rows. A document's copies are a Poisson draw of that mean, inverted from
uniform numbers that an md5 of seed and doc_id gives, so a rerun draws the same. Rates above ``PART`` are split into equal parts whose
independent draws add up (a sum of Poisson draws is Poisson), which keeps every table of cumulative probabilities at ``TERMS`` entries.

Defined cases: a null source counts as the empty source; a null doc_id draws as the text "null"; repeated rows draw alike; null and long
texts and extra columns of any name are carried along untouched, but ``copy`` and ``order_key`` are the result's own; a source with weight 0 or
without a weight is left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import durable, partitions

PART, TERMS = 16, 64
#: Rows of the rates table (600 bytes a row) up to which it is broadcast; beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 10_000, 32


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _key(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def target_rates(documents: DataFrame, weights: DataFrame | None = None, rows: int | None = None, power: float = 0.5, by: str = "source") -> DataFrame:
    """mix_key, own_rows, rate. ``weights`` (columns ``by``, weight) are relative; by default a source weighs own rows ** ``power``.
    ``rows`` is the expected size of the mix, by default that of the input."""
    own = durable(documents.groupBy(_key(by).alias("mix_key")).agg(F.count("*").alias("own_rows")), "source-rows")
    if weights is None:
        own = own.withColumn("weight", F.pow(F.col("own_rows").cast("double"), F.lit(power)))
    else:
        own = own.join(weights.select(_key(by).alias("mix_key"), F.col("weight").cast("double")).groupBy("mix_key").agg(F.sum("weight").alias("weight")), "mix_key")
    total = own.agg(F.sum("weight").alias("w"), F.sum("own_rows").alias("n")).first()
    scale = float(rows if rows is not None else total.n or 0) / (total.w or 1.0)
    return own.withColumn("rate", F.col("weight") * F.lit(scale) / F.col("own_rows")).select("mix_key", "own_rows", "rate")


def _with_cdf(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``: cumulative probabilities of 0, 1, ... for the mean rate / parts."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    first = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + acc["p"] * F.col("mean") / k).alias("c")),
        lambda acc: acc["c"],
    )
    return rates.withColumn("cdf", cdf).select("mix_key", "parts", "cdf")


def mix_sources(documents: DataFrame, weights: DataFrame | None = None, rows: int | None = None, power: float = 0.5, seed: int = 7, by: str = "source", shuffled: bool = True) -> DataFrame:
    """All columns of ``documents``, and ``copy`` (from 1) and ``order_key``: the mix's global random order is that of ``order_key``.
    Rows are dealt to partitions by its hash and sorted within each."""
    own = documents.drop("copy", "order_key")
    rates = durable(_with_cdf(target_rates(own, weights, rows, power, by)), "rates")
    # the row travels as one struct, so that no name of its columns can clash
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = own.select(F.struct(*own.columns).alias("row"), _key(by).alias("mix_key"), doc.alias("doc"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), "mix_key")
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["mix_key", "salt"])
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda n, j: n + F.size(F.filter(F.col("cdf"), lambda c: c <= _uniform(F.lit(str(seed)), F.col("doc"), j.cast("string")))),
    )
    drawn = joined.select("row", "doc", draw.alias("copies")).filter("copies > 0")
    out = drawn.select("row", "doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col("doc"), F.col("copy").cast("string")).cast("binary"))
    out = out.select("row.*", "copy", order.alias("order_key"))
    return out.repartition(partitions(own.sparkSession), "order_key").sortWithinPartitions("order_key") if shuffled else out


ORACLE = """
with own as (select coalesce(source, '') as k, count(*) as n from documents group by 1),
rates as (select k, sqrt(n) * (select sum(n) from own) / (select sum(sqrt(n)) from own) / n as rate from own),
means as (select k, greatest(1, ceil(rate / 16))::int as parts, rate / greatest(1, ceil(rate / 16)) as mean from rates),
terms as (select k, parts, i, exp(i * ln(mean) - mean - lgamma(i + 1)) as p from means, range(0, 65) r(i)),
cdf as (select k, parts, i, sum(p) over (partition by k order by i) as c from terms),
draws as (select d.doc_id, m.k, j, ('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, 'null') || ':' || j), 1, 13))::bigint / 4503599627370496.0 as u
  from documents d join means m on coalesce(d.source, '') = m.k, range(1, m.parts + 1) t(j)),
counted as (select doc_id, sum((select count(*) from cdf where cdf.k = draws.k and cdf.c <= draws.u)) as copies from draws group by doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::int as copy, md5('order7:' || coalesce(d.doc_id::varchar, 'null') || ':' || c.copy) as order_key
from documents d join (select doc_id, unnest(range(1, copies::bigint + 1)) as copy from counted) c on d.doc_id = c.doc_id
"""
