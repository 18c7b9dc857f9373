"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n rows that is to have the share w of a mix of `size` rows has the mean repetition rate size * w / n.
Each row's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from the seed
and the row's id, so the same row has the same count wherever and whenever it is computed. Rows are exploded by their
counts and dealt over all partitions by a hash of id and copy, and each partition is put in the order of that hash: a
global shuffle that moves each copy once.

Null source is a source like others. A row without id is hashed by its text. Repeated rows get equal counts. A source
with no weight in `targets`, or weight 0 or null, gives no rows. An empty table gives an empty result. Of columns that
clash with the output's `copy`, the input's is dropped; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh

#: Up to so many sources their distributions (of about 40 to 700 doubles each) are broadcast, up to so many more their rates
#: (some 30 bytes and the name), from which each row makes its distribution; beyond, rows are dealt to SALTS tasks a source.
BROADCAST_SOURCES, BROADCAST_RATES, SALTS = 2_000, 300_000, 32
#: A larger mean is drawn as a sum of equal parts with at most this mean each.
LARGEST_MEAN = 400.0


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of md5(seed|part|...)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as doubles tell it from 1."""
    last = (mean + 10 * F.sqrt(mean) + 25).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["c"])


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, size: int | None = None, temperature: float = 0.5, seed: str = "mix", source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, repeated so that sources have their target weights; `copy` counts a row's repetitions from 1.

    targets: (source, weight); without it a source of n rows weighs n ** temperature. size: expected rows of the mix,
    as many as docs has by default.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "copy"])
    w, n, mean, parts, cdf, sid, row_key, count, uniforms, salt = fresh([*docs.columns, "copy"], "w", "n", "mean", "parts", "cdf", "sid", "row_key", "count", "uniforms", "salt")
    rates = docs.groupBy(F.col(source).alias(sid)).agg(F.count(F.lit(1)).alias(n))
    if targets is None:
        rates = rates.withColumn(w, F.pow(F.col(n).cast("double"), F.lit(temperature)))
    else:
        wanted = targets.select(F.col(targets.columns[0]).alias("__s"), F.col(targets.columns[1]).cast("double").alias(w)).groupBy("__s").agg(F.sum(w).alias(w))
        rates = rates.join(wanted, F.col(sid).eqNullSafe(F.col("__s")), "left").drop("__s")
    rates = rates.filter(F.col(w) > 0)
    total = rates.agg(F.sum(n).alias("n"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("sources")).first()
    if size is None and targets is not None:
        size = docs.count()
    size = total["n"] or 0 if size is None else size
    rates = rates.withColumn(mean, F.lit(float(size)) * F.col(w) / F.lit(total["w"] or 1.0) / F.col(n))
    rates = rates.withColumn(parts, F.ceil(F.col(mean) / LARGEST_MEAN).cast("int")).select(sid, mean, parts)
    made = F.when(F.col(mean).isNotNull(), poisson_cdf(F.col(mean) / F.col(parts)))
    keyed = docs.withColumn(row_key, F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    us = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: hashed_uniform(seed, F.col(row_key), i.cast("string")))
    one = F.aggregate(F.col(uniforms), F.lit(0).cast("long"), lambda a, u: a + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    same = F.col(source).eqNullSafe(F.col(sid))
    if total["sources"] <= BROADCAST_SOURCES:
        told = keyed.join(F.broadcast(rates.withColumn(cdf, made)), same)
    elif total["sources"] <= BROADCAST_RATES:
        told = keyed.join(F.broadcast(rates), same).withColumn(cdf, made)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        (own,) = fresh([*docs.columns, "copy", salt], "own_salt")
        told = keyed.withColumn(own, F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(own) == F.col(salt))).withColumn(cdf, made)
    counted = told.withColumn(uniforms, us).withColumn(count, one).filter(F.col(count) > 0)
    copies = counted.select(*docs.columns, row_key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))).alias("copy"))
    (order,) = fresh(copies.columns, "order")
    dealt = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(row_key), F.col("copy"))).repartition(F.col(order))
    return dealt.sortWithinPartitions(order).select(*docs.columns, "copy")
