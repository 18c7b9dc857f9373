"""Joins with frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are looked up in a broadcast part of a table at most, and rows that a key has at least to be one of them.
HOT_KEYS = 1_000
HOT_ROWS = 256
#: Bytes of that part at most.
HOT_BYTES = 64 << 20


def join_hot(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", size: Column | None = None) -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each value of the column `on`.

    The most frequent keys of rows, HOT_KEYS at most and HOT_BYTES of table's rows at most (`size`: a column of bytes a row,
    by default 100), are looked up in a broadcast; the others are shuffled. So a shuffled key has fewer than HOT_ROWS rows or
    less than one in HOT_KEYS of all, unless table's rows are very large. rows should be a written table, as it is read
    twice. Null keys are found nowhere.
    """
    frequent = rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= HOT_ROWS).orderBy(F.desc("__n"), on).limit(HOT_KEYS).collect()
    if not frequent:
        return rows.join(table, on, how)
    spark = rows.sparkSession
    named = lambda keys: F.broadcast(spark.createDataFrame([(k,) for k in keys], rows.select(on).schema))
    keys = [r[on] for r in frequent]
    if size is not None:
        total, sizes = 0, {r[on]: r["__b"] for r in table.join(named(keys), on, "left_semi").select(on, size.alias("__b")).collect()}
        kept = []
        for k in keys:
            total += sizes.get(k, 0)
            if total > HOT_BYTES:
                break
            kept.append(k)
        keys = kept
    if not keys:
        return rows.join(table, on, how)
    near = F.broadcast(table.join(named(keys), on, "left_semi"))
    looked_up = rows.join(named(keys), on, "left_semi").join(near, on, how)
    return looked_up.unionByName(rows.join(named(keys), on, "left_anti").join(table, on, how))
