"""Seeded draws. Order is by md5 of seed and key, so a draw is the same anywhere and with any partitioning.

Strata are few and large. Ranks are therefore taken in two steps: within salts of a stratum first, so that at most
`limit` rows of each salt go on, and then over these. Where a rank depends on the stratum's size, the sizes are counted
first and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def order_key(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def ranked(df: DataFrame, by: list[str], limit: Column | int, seed: str, key: str = "doc_id") -> DataFrame:
    """Rows with the first places (column `place`, from 1) of their stratum; limit may be a column that is constant in it."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    rows = df.withColumns({"__o": order_key(seed, key), "__salt": F.pmod(F.xxhash64(key), F.lit(SALTS)), "__limit": limit})
    first = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy("__o", key))
    rows = rows.withColumn("place", first).filter(F.col("place") <= F.col("__limit"))
    second = F.row_number().over(Window.partitionBy(*by).orderBy("__o", key))
    return rows.withColumn("place", second).filter(F.col("place") <= F.col("__limit")).drop("__o", "__salt", "__limit")


def draw(df: DataFrame, by: str, n: int, seed: str, key: str = "doc_id") -> DataFrame:
    """At most n rows of each stratum."""
    return ranked(df, [by], n, seed, key).drop("place")


def draw_share(df: DataFrame, by: str, share: float, seed: str, key: str = "doc_id", nearest: bool = False) -> DataFrame:
    """A share of each stratum, one row at least; rounded down, or to the nearest (half to even)."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    want = F.bround(F.col("__n") * share) if nearest else F.floor(F.col("__n") * share)
    rows = df.join(sizes, df[by].eqNullSafe(sizes[by]), "left").drop(sizes[by])
    return ranked(rows, [by], F.greatest(F.lit(1), want).cast("int"), seed, key).drop("place", "__n")


def split(df: DataFrame, by: str, n_test: int, dev_share: float, test_seed: str, dev_seed: str, key: str = "doc_id") -> DataFrame:
    """df with split: test (at most n_test of each stratum), dev (a share of what is left), train (the rest)."""
    test = draw(df, by, n_test, test_seed, key).select(key)
    rest = df.join(test, key, "left_anti")
    dev = draw_share(rest, by, dev_share, dev_seed, key).select(key)
    out = df.join(test.withColumn("__t", F.lit(True)), key, "left").join(dev.withColumn("__d", F.lit(True)), key, "left")
    return out.withColumn("split", F.when(F.col("__t"), "test").when(F.col("__d"), "dev").otherwise("train")).drop("__t", "__d")


def enriched(df: DataFrame, disputed: str, classes, per_class: int, seed: str, key: str = "uid") -> DataFrame:
    """uid and class: for one class after the other, in the given order, per_class rows in which it is disputed and that no earlier class has taken.

    Of the i-th class only the first i * per_class rows in the seed's order can be taken, as no more than the others are gone by then: so many of each class, found
    in salts, are all that the driver chooses among.
    """
    classes = list(classes)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.array_contains(disputed, c).alias("held")) for i, c in enumerate(classes)])
    rows = df.select(key, F.explode(F.filter(each, lambda x: x["held"])).alias("x")).select(key, "x.i")
    first = ranked(rows, ["i"], (F.col("i") + 1) * per_class, seed, key).select(key, "i", "place").collect()
    taken: dict = {}
    for i in range(len(classes)):
        free = [r[key] for r in sorted((r for r in first if r["i"] == i), key=lambda r: r["place"]) if r[key] not in taken]
        taken |= dict.fromkeys(free[:per_class], classes[i])
    return df.sparkSession.createDataFrame(list(taken.items()), f"{key} {df.schema[key].dataType.simpleString()}, class string")


def topped_up(df: DataFrame, disputed: str, classes, per_class: int, total: int, seed: str, key: str = "uid") -> DataFrame:
    """enriched(), and as many further rows with anything disputed, in the seed's order and with class null, as are missing to `total`."""
    picked = enriched(df, disputed, classes, per_class, seed, key)
    n = picked.count()  # per_class rows of each class at most
    rest = df.filter(F.size(disputed) > 0).join(picked.select(key), key, "left_anti").select(key, F.lit(None).cast("string").alias("class"))
    if n >= total:
        return picked
    return picked.unionByName(ranked(rest, ["class"], total - n, f"{seed} more", key).select(key, "class"))


def balanced(df: DataFrame, wanted: Column, ratio: float, copies: int, seed: str, key: str = "doc_id") -> DataFrame:
    """All wanted rows, `copies` times each, and ratio times as many of the others; `copy` counts from 1."""
    rows = df.withColumn("__w", wanted)
    n = rows.agg(F.count(F.when(F.col("__w"), 1)).alias("n")).first()["n"]
    others = ranked(rows.filter("not __w"), ["__w"], int(n * ratio), seed, key).drop("place")
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("__w"), copies).otherwise(1).cast("long")))
    return rows.filter("__w").unionByName(others).withColumn("copy", repeat).drop("__w")
