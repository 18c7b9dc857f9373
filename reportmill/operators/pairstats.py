"""Paired statistics of conditions over the same uids. Spark reduces to a few sums or to histograms; p-values are closed forms on about ten rows."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, running, small
from .sums import steady_mean


def paired(df: DataFrame, conditions: list[str], value: str, uid: str = "uid", condition: str = "prompt_condition", order: str | None = None) -> DataFrame:
    """uid and a column c0, c1, ... for each condition: the mean of its values, null where there are none.

    Equal values give equal means in any partitioning, as ties of means are counted. With order the values of a uid and
    condition are added up one by one in the order of that column, as a single thread does that reads them so.
    """
    return _wide(df, conditions, {"c": value}, uid, condition, order)


def _wide(df: DataFrame, conditions: list[str], values: dict[str, str], uid: str = "uid", condition: str = "prompt_condition", order: str | None = None) -> DataFrame:
    """paired for several values at once: uid and columns <name>0, <name>1, ... for each name of values."""
    by = [uid, condition]
    if order:
        upto = Window.partitionBy(*by).orderBy(order, *values.values()).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.select(*by, F.row_number().over(upto).alias("__row"), *[F.avg(v).over(upto).alias(f"__{n}") for n, v in values.items()])
        means = rows.groupBy(*by).agg(*[F.max_by(f"__{n}", "__row").alias(f"__{n}") for n in values])
    else:
        of_type = dict(df.dtypes)
        mean = lambda v: (steady_mean if of_type[v] in ("double", "float") else F.avg)(F.col(v))
        means = df.groupBy(*by).agg(*[mean(v).alias(f"__{n}") for n, v in values.items()])
    return means.groupBy(uid).agg(*[F.max(F.when(F.col(condition) == c, F.col(f"__{n}"))).alias(f"{n}{i}") for n in values for i, c in enumerate(conditions)])


def mcnemar_counts(df: DataFrame, conditions: list[str], value: str = "correct", **how) -> DataFrame:
    """a, b, n, mean_a, mean_b, n01 and n10 of each pair of conditions over the uids that have all; means of duplicates are cut to integers. One aggregation for all pairs."""
    wide = paired(df, conditions, value, **how).filter(" and ".join(f"c{i} is not null" for i in range(len(conditions))))
    v = [F.col(f"c{i}").cast("int") for i in range(len(conditions))]
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("n"), F.avg(v[i]).alias("mean_a"), F.avg(v[j]).alias("mean_b"), one((v[i] == 0) & (v[j] == 1)).alias("n01"), one((v[i] == 1) & (v[j] == 0)).alias("n10")) for (i, a), (j, b) in combinations(enumerate(conditions), 2)]
    return wide.agg(*[e.alias(f"p{k}") for k, e in enumerate(each)]).select(F.explode(F.array(*[F.col(f"p{k}") for k in range(len(each))])).alias("p")).select("p.*")


def chi_square_p(x: float) -> float:
    """Upper tail with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def binomial_p(k: int, n: int) -> float:
    """Two-sided exact p of k successes of n at one half."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))


def mcnemar_p(n01: int, n10: int, exact_below: int = 25) -> tuple[float, float]:
    """Statistic and two-sided p: exact with fewer than exact_below discordant pairs, else chi-square with continuity correction; without discordant pairs 0 and 1."""
    n = n01 + n10
    if n < exact_below or not n:
        return float(min(n01, n10)), binomial_p(n01, n)
    statistic = (abs(n01 - n10) - 1) ** 2 / n
    return statistic, chi_square_p(statistic)


_MCNEMAR = "a string, b string, n long, mean_a double, mean_b double, n01 long, n10 long, statistic double, p_value double"


def mcnemar(df: DataFrame, conditions: list[str], value: str = "correct", exact_below: int = 25, **how) -> DataFrame:
    """mcnemar_counts with statistic, p_value and p_fdr. exact_below=0: always chi-square."""
    rows = mcnemar_counts(df, conditions, value, **how).collect()  # a row for each pair of conditions
    out = [(r["a"], r["b"], r["n"], r["mean_a"], r["mean_b"], r["n01"] or 0, r["n10"] or 0, *mcnemar_p(r["n01"] or 0, r["n10"] or 0, exact_below)) for r in rows]
    return fdr(df.sparkSession.createDataFrame(out, _MCNEMAR), [], "p_value")


def mcnemar_best(df: DataFrame, conditions: list[str], best: str, value: str = "correct", alpha: float = 0.05, **how) -> DataFrame:
    """condition, wins and losses of the best condition against it, p_value (always chi-square, with correction) and significant."""
    rows = mcnemar_counts(df, [best, *[c for c in conditions if c != best]], value, **how).filter(F.col("a") == best).collect()  # a row for each other condition
    out = [(r["b"], r["n10"] or 0, r["n01"] or 0, mcnemar_p(r["n01"] or 0, r["n10"] or 0, 0)[1]) for r in rows]
    return df.sparkSession.createDataFrame([(*r, r[3] < alpha) for r in out], "condition string, wins long, losses long, p_value double, significant boolean")


def fdr(df: DataFrame, by: list[str], p: str, name: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg values within each group; null for a null p, which counts for nothing.

    Equal p-values are counted first; ranks and the least of all scaled values from a p on upwards run over ranges of p, so a
    family of any size lies in many tasks.
    """
    bins = df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("s")).agg(F.count(F.lit(1)).alias("t"))
    ranked = running(bins, by, ["t"]).withColumn("x", F.col("s") * F.col("all_t") / (F.col("all_t") - F.col("upto_t") + F.col("t")))
    told = running(ranked.select(*by, "s", "x"), by, [], least=("x",)).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("s").alias("__s"), F.least(F.lit(1.0), "lowest_x").alias(name))
    on = F.col(p) == F.col("__s")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(small(told), on, "left").drop("__s", *[f"__{c}" for c in by])


def _pairs(df: DataFrame, conditions: list[str], value: str, **how) -> DataFrame:
    """a, b, x and y of every uid that has both conditions of a pair."""
    wide = paired(df, conditions, value, **how)
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for (i, a), (j, b) in combinations(enumerate(conditions), 2)]
    return wide.select(F.explode(F.array(*each)).alias("p")).select("p.*").filter("x is not null and y is not null")


def _differences(rows: DataFrame, by: list[str], d: Column) -> DataFrame:
    """A row for each group and size s of differences d: pos (how many are above zero) and t (how many there are)."""
    return rows.groupBy(*by, F.abs(d).alias("s")).agg(F.sum(F.when(d > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("t"))


def _rank_sums(bins: DataFrame, by: list[str]) -> DataFrame:
    """n, w_plus, w_minus and ties of each group of _differences; zeros have no rank."""
    ranked = running(bins.filter("s > 0"), by, ["t"]).withColumn("rank", F.col("all_t") - F.col("upto_t") + (F.col("t") + 1) / 2)
    return ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("pos"))).alias("w_minus"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))


def signed_ranks(df: DataFrame, conditions: list[str], value: str, **how) -> DataFrame:
    """Of each pair of conditions that some uid has both of: a, b, pairs, n (pairs with a difference), medians, w_plus, w_minus and ties (sum of t^3 - t) of the signed-rank test.

    Equal differences and equal values are counted first; ranks and medians come from running counts.
    """
    rows = _pairs(df, conditions, value, **how)
    d = F.col("x") - F.col("y")
    sums = _rank_sums(_differences(rows, ["a", "b"], d), ["a", "b"])
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("s")) for k, c in (("a", "x"), ("b", "y"))])
    values = rows.select("a", "b", F.explode(sides).alias("v")).groupBy("a", "b", "v.side", "v.s").agg(F.count(F.lit(1)).alias("n"))
    middle = quantiles(values, ["a", "b", "side"], 2).filter("i = 1")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("t")))
    whole = middle.groupBy("a", "b").agg(F.max("all_n").alias("pairs"), of("a").alias("median_a"), of("b").alias("median_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return whole.join(sums, ["a", "b"], "left").select("a", "b", "pairs", F.coalesce("n", F.lit(0)).alias("n"), "median_a", "median_b", zero("w_plus"), zero("w_minus"), zero("ties"))


def wilcoxon_p(pairs: int, n: int, w_plus: float, w_minus: float, ties: float) -> float:
    """Two-sided p of n differences in so many pairs: 1 with fewer than 5 pairs or no difference; exact for up to 50 pairs without ties and zeros, else normal with the tie correction."""
    if pairs < 5 or not n:
        return 1.0
    w = min(w_plus, w_minus)
    if n == pairs <= 50 and not ties:
        ways = [1.0]
        for r in range(1, n + 1):
            longer = ways + [0.0] * r
            for s, x in enumerate(ways):
                longer[s + r] += x
            ways = longer
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def wilcoxon(df: DataFrame, conditions: list[str], value: str, **how) -> DataFrame:
    """A row for each pair of conditions: medians, statistic, p_value, p_fdr and Cliff's delta. Without a difference, or with fewer than 5 pairs, the statistic is null, p 1 and delta 0."""
    rows = signed_ranks(df, conditions, value, **how).collect()  # a row for each pair of conditions
    delta = {(r["a"], r["b"]): r["delta"] for r in cliffs_delta(df, conditions, value, **how).collect()}
    out = []
    for r in rows:
        told = r["pairs"] >= 5 and r["n"] > 0
        out.append((r["a"], r["b"], r["pairs"], r["median_a"], r["median_b"], float(min(r["w_plus"], r["w_minus"])) if told else None, wilcoxon_p(r["pairs"], r["n"], r["w_plus"], r["w_minus"], r["ties"]), float(delta[r["a"], r["b"]]) if told else 0.0))
    return fdr(df.sparkSession.createDataFrame(out, "a string, b string, pairs long, median_a double, median_b double, statistic double, p_value double, delta double"), [], "p_value")


def cliffs_delta(df: DataFrame, conditions: list[str], value: str, **how) -> DataFrame:
    """a, b and delta of each pair of conditions, from counts of the values of uids that have both: no pairs of rows are formed."""
    rows = _pairs(df, conditions, value, **how)
    values = rows.select("a", "b", F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")), F.struct(F.col("y").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))).alias("p"))
    bins = values.groupBy("a", "b", F.col("p.v").alias("s")).agg(F.sum("p.na").alias("na"), F.sum("p.nb").alias("nb"))
    above = F.col("upto_nb") - F.col("nb")
    net = F.col("na") * (F.col("all_nb") - F.col("upto_nb") - above).cast("double")
    return running(bins, ["a", "b"], ["nb"]).withColumn("net", net).groupBy("a", "b").agg((F.sum("net") / (F.sum("na").cast("double") * F.sum("nb"))).alias("delta"))


def paired_dissociation(df: DataFrame, base: str, conditions: list[str], persuasive: list[str], faithful: list[str], alpha: float = 0.05, **how) -> DataFrame:
    """condition, and for each measure d_, p_ and n_: mean difference from the base, p of the paired signed-rank test (null with fewer than 10 pairs or no difference); persuasive_up and faithful_up (some measure rises significantly) and dissociation (the former without the latter)."""
    others, measures = [c for c in conditions if c != base], [*persuasive, *faithful]
    found: dict[str, dict] = {c: {} for c in others}
    # All measures together: one pass over the rows, and from then on only counts of differences.
    wide = _wide(df, [base, *others], {f"m{k}_": m for k, m in enumerate(measures)}, **how)
    each = [F.struct(F.lit(k).alias("m"), F.lit(c).alias("b"), (F.col(f"m{k}_{i}") - F.col(f"m{k}_0")).alias("d")) for k in range(len(measures)) for i, c in enumerate(others, 1)]
    bins = _differences(wide.select(F.inline(F.array(*each))).filter("d is not null"), ["m", "b"], F.col("d")).persist()
    means = {(r["b"], r["m"]): r for r in bins.groupBy("m", "b").agg(F.sum("t").alias("n"), (F.sum(F.col("s") * (2 * F.col("pos") - F.col("t"))) / F.sum("t")).alias("d")).collect()}  # a row for each measure and condition
    tests = {(r["b"], r["m"]): r for r in _rank_sums(bins, ["m", "b"]).collect()}
    bins.unpersist()
    for c in others:
        for k, m in enumerate(measures):
            r, t = means.get((c, k)), tests.get((c, k))
            told = bool(r and t and r["n"] >= 10 and t["n"])
            found[c][m] = (r["d"] if told else None, wilcoxon_p(r["n"], t["n"], t["w_plus"], t["w_minus"], t["ties"]) if told else None, r["n"] if r else 0)
    rises = lambda x: x[1] is not None and x[1] < alpha and x[0] > 0
    rows = []
    for c, of in found.items():
        p, f = any(rises(of[m]) for m in persuasive), any(rises(of[m]) for m in faithful)
        rows.append((c, *[x for m in [*persuasive, *faithful] for x in of[m]], p, f, p and not f))
    measures = ", ".join(f"d_{m} double, p_{m} double, n_{m} long" for m in [*persuasive, *faithful])
    return df.sparkSession.createDataFrame(rows, f"prompt_condition string, {measures}, persuasive_up boolean, faithful_up boolean, dissociation boolean")


def dissociation(df: DataFrame, base: str, coherence: str, faithfulness: str, condition: str = "prompt_condition", slack: float = 0.05) -> DataFrame:
    """Mean differences of each condition from the base, and whether coherence rises without faithfulness rising."""
    means = df.groupBy(condition).agg(F.avg(coherence).alias("c"), F.avg(faithfulness).alias("f"))
    ref = means.filter(F.col(condition) == base).select(F.lit(1).alias("one"), F.col("c").alias("c0"), F.col("f").alias("f0"))
    rows = means.filter(F.col(condition) != base).withColumn("one", F.lit(1)).join(ref, "one")
    dc, df_ = F.col("c") - F.col("c0"), F.col("f") - F.col("f0")
    return rows.select(condition, dc.alias("d_coherence"), df_.alias("d_faithfulness"), ((dc > 0) & (df_ <= slack)).alias("dissociation"))
