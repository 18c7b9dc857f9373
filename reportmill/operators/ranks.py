"""Running sums over sorted values of few, large groups, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that small() broadcasts at most.
SMALL_ROWS = 50_000
#: Distinct values up to which one window a group is used.
FEW_VALUES = 200_000
#: Ranges that larger groups' values are cut into.
RANGES = 256


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df computed once and to be broadcast if it has at most `most` rows; else df as it is, to be joined by shuffle."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def _alike(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that both have, null as a value."""
    named = right.select(*[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(F.broadcast(named) if right.isLocal() else named, same).drop(*[f"__on_{c}" for c in on])


def running(bins: DataFrame, by: list[str], sums: list[str], value: str = "s", least: tuple[str, ...] = ()) -> DataFrame:
    """bins (a row for each group and value) with, for each column of sums, upto_<c> (its sum over values at or above the row's) and all_<c>, and for each of least lowest_<c> (its least at these).

    With many values each group is cut into RANGES ranges of about as many values: sums and leasts run within a range, and the
    ranges' totals are carried on. No task holds a whole group.
    """
    group = by or [F.lit(1).alias("__one")]
    stats = bins.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], F.lit(10_000)).alias("__cuts"))
    found = stats.limit(SMALL_ROWS + 1).collect()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    if sum(r["__n"] for r in found) <= FEW_VALUES or len(found) > SMALL_ROWS:
        return bins.withColumns({f"upto_{c}": F.sum(c).over(upto) for c in sums} | {f"all_{c}": F.sum(c).over(w) for c in sums} | {f"lowest_{c}": F.min(c).over(upto) for c in least})
    cuts = bins.sparkSession.createDataFrame(found, stats.schema).drop("__n")
    cuts = F.broadcast(cuts if by else cuts.drop("__one"))
    told = (_alike(bins, cuts, by) if by else bins.crossJoin(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = told.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums], *[F.min(c).alias(f"__l_{c}") for c in least])
    over = w.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{c}").over(over), F.lit(0)).alias(f"__above_{c}") for c in sums], *[F.sum(f"__{c}").over(w).alias(f"all_{c}") for c in sums], *[F.min(f"__l_{c}").over(over).alias(f"__beyond_{c}") for c in least])
    own = Window.partitionBy(*by, "__range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = told.withColumns({f"__own_{c}": F.sum(c).over(own) for c in sums} | {f"__low_{c}": F.min(c).over(own) for c in least})
    rows = _alike(rows, small(totals, RANGES * 1000), [*by, "__range"])
    return rows.select(*bins.columns, *[(F.col(f"__above_{c}") + F.col(f"__own_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums], *[F.least(f"__low_{c}", f"__beyond_{c}").alias(f"lowest_{c}") for c in least])


def quantiles(bins: DataFrame, by: list[str], steps: int, sums: tuple[str, ...] = (), value: str = "s") -> DataFrame:
    """groups, i (0 to steps), t (the i-th of steps + 1 quantiles, linear between neighbours) and, for n and each of sums, upto_<c> and all_<c> at t.

    bins: a row for each group and value, with n rows at it. The places next to a quantile are found from running counts, so a
    group's values are never in one task. t is the very value where a quantile falls on one, and above the lower neighbour where it doesn't.
    """
    sums = tuple(dict.fromkeys(("n", *sums)))
    rows = running(bins, by, list(sums), value).withColumn("__a", F.col("all_n") - F.col("upto_n")).withColumn("__g", F.col("all_n") - 1)
    rows = rows.withColumn("__b", F.col("__a") + F.col("n") - 1)
    one = F.col("__g") == 0
    upto = lambda name: F.struct(*[F.col(f"upto_{c}") for c in sums]).alias(name)
    # Quantile i lies at i * g / steps: its lower neighbour is at the floor of that, its upper at the ceiling.
    first = F.when(one, 0).otherwise(F.expr(f"({steps} * __a + __g - 1) div greatest(__g, 1)"))
    last = F.when(one, steps).otherwise(F.least(F.lit(steps), F.expr(f"({steps} * __b + {steps} - 1) div greatest(__g, 1)")))
    lower = rows.filter(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("i"), F.col(value).alias("lo"), upto("lo_upto"), "__g", *[f"all_{c}" for c in sums])
    first = F.when(one | (F.col("__a") == 0), 0).otherwise(F.expr(f"({steps} * (__a - 1)) div greatest(__g, 1) + 1"))
    last = F.when(one, steps).otherwise(F.expr(f"({steps} * __b) div greatest(__g, 1)"))
    upper = rows.filter(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("i"), F.col(value).alias("hi"), upto("hi_upto"))
    both = lower.join(upper, [*by, "i"])
    rest = (F.col("i") * F.col("__g")) % steps
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * rest / steps
    exact = (rest == 0) | (F.col("lo") == F.col("hi"))
    at = F.when(exact, F.col("lo_upto")).otherwise(F.col("hi_upto"))
    t = F.when(exact, F.col("lo")).when(between > F.col("lo"), F.least(between, F.col("hi"))).otherwise(F.col("hi"))
    return both.select(*by, "i", t.alias("t"), *[at[f"upto_{c}"].alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])
