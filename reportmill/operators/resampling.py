"""Bootstrap intervals and a random-intercept model from sums over uids.

Each uid has a Poisson(1) weight for each replicate, hashed from the uid and the replicate: weights don't depend on how
rows are partitioned, and a replicate is a weighted sum that partitions add up for themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights that are held at once.
HELD = 2_000_000
#: Tasks to a core that the sums of replicates are made in at most.
TASKS = 4
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights [key, replicate] of 64-bit keys; replicate 0 has weight 1 throughout."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64)[:, None] + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    w = np.searchsorted(_CDF, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), "right").astype(np.float64)
    w[:, 0] = 1
    return w


def replicate_sums(rows: DataFrame, key: str, columns: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """replicate and the weighted sum of each column; null counts as 0, and n is the sum of weights."""
    # Partitions share tasks, each with one sum for all of its partitions: what is shuffled grows with the cluster, not with the rows.
    slots = rows.sparkSession.sparkContext.defaultParallelism * TASKS
    kept = rows.select(F.xxhash64(key).alias("k"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)]).coalesce(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns) + 1, replicates))
        for b in batches:
            step = max(1, HELD // replicates)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                w = poisson_weights(part.column(0).to_numpy(zero_copy_only=False), replicates, seed)
                values = np.stack([np.ones(part.num_rows), *(part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns)))])
                total += values @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int64)), *(pa.array(t) for t in total)], ["replicate", "n", *(f"s{i}" for i in range(len(columns)))])

    sums = kept.mapInArrow(run, "replicate long, n double, " + ", ".join(f"s{i} double" for i in range(len(columns))))
    return sums.groupBy("replicate").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(c) for i, c in enumerate(columns)])


class _Area:
    """Sums of one class's cells in ascending order of their scores, for all replicates: of positives, of negatives, and of wins (positives over negatives below, ties half)."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.net = (np.zeros(replicates) for _ in range(3))
        self.value, self.tied = None, np.zeros((2, replicates))

    def _settle(self) -> None:
        self.net += self.tied[0] * (self.neg + self.tied[1] / 2)
        self.pos += self.tied[0]
        self.neg += self.tied[1]

    def add(self, scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Further cells, not below those before."""
        begins = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        pos, neg = np.add.reduceat(w * (y == 1)[:, None], begins), np.add.reduceat(w * (y != 1)[:, None], begins)
        if self.value == scores[0]:
            pos[0] += self.tied[0]
            neg[0] += self.tied[1]
        else:
            self._settle()
        self.value, self.tied = scores[-1], np.stack([pos[-1], neg[-1]])
        pos, neg = pos[:-1], neg[:-1]
        below = np.cumsum(neg, axis=0) - neg + self.neg
        self.net += (pos * (below + neg / 2)).sum(axis=0)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)

    def done(self) -> list[bytes]:
        self._settle()
        self.tied = np.zeros_like(self.tied)
        return [x.tobytes() for x in (self.pos, self.neg, self.net)]


def _carried(parts: pd.DataFrame) -> pd.DataFrame:
    """The sums of a class over its ranges of scores, lower ranges' negatives carried on. Parts of one range are of one score."""
    pos = neg = net = 0.0
    for _, own in parts.sort_values("range").groupby("range"):
        p, n, wins = (sum(np.frombuffer(v, np.float64) for v in own[c]) for c in ("pos", "neg", "net"))
        net = net + (wins if len(own) == 1 else p * n / 2) + p * neg
        pos, neg = pos + p, neg + n
    return pd.DataFrame({"form": parts["form"].iloc[0], "class": parts["class"].iloc[0], "replicate": np.arange(len(pos)), "pos": pos, "neg": neg, "net": net})


def _below(score: Column):
    return lambda cut: cut < score


def auroc_replicates(cells: DataFrame, key: str, scores: list[str], replicates: int, least: int = 5, ranges: int = 256, salts: int = 32, seed: int = 0) -> DataFrame:
    """replicate, and for each score pooled_<score> (AUROC over all cells) and macro_<score> (mean of the classes' AUROCs, of those with `least` positives).

    cells: key, class, y and the scores; rows with a null among them are left out. Exact for any number of scores: cells are dealt to `ranges` ranges of scores,
    in a range they are read in order with their weights' sums for all replicates, and lower ranges' sums are carried on. What leaves a range is three
    vectors a class, however many cells and partitions there are. A score that fills ranges by itself is dealt over `salts` tasks.
    """
    kept = cells.select(F.xxhash64(key).alias("k"), F.col("class").cast("string").alias("class"), F.col("y").cast("int").alias("y"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)]).dropna()
    grid = [i / ranges for i in range(1, ranges)]
    cuts = [row or [] for row in kept.agg(*[F.percentile_approx(f"s{i}", grid, F.lit(10_000)) for i in range(len(scores))]).first()]
    each = []
    for i, found in enumerate(cuts):
        ends = sorted(set(found))
        # Every cut ends a range; one that is several quantiles is a range of its own.
        full = {v for v in ends if found.count(v) > 1}
        bounds = sorted({*ends, *(math.nextafter(v, -math.inf) for v in full)})
        score = F.col(f"s{i}")
        at = F.size(F.filter(F.lit(bounds).cast("array<double>") if bounds else F.array().cast("array<double>"), _below(score)))
        own = F.when(F.array_contains(F.array(*[F.lit(bounds.index(v)) for v in sorted(full)]), at), F.pmod(F.xxhash64("k"), F.lit(salts))).otherwise(0) if full else F.lit(0)
        each.append(F.struct(F.lit(i).alias("form"), at.alias("range"), own.cast("int").alias("salt"), score.alias("s")))
    dealt = kept.select("k", "class", "y", F.explode(F.array(*each)).alias("v")).select("k", "class", "y", "v.*")
    ordered = dealt.repartition("form", "range", "salt").sortWithinPartitions("form", "range", "salt", "s").select("form", "range", "salt", "class", "k", "y", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def hand_on():
            out = [(now[0], now[1], c, *area.done()) for c, area in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 3), strict=True)], ["form", "range", "class", "pos", "neg", "net"])

        for b in batches:
            names = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            step = max(1, HELD // replicates)
            for begin, end in zip(cut[:-1], cut[1:], strict=True):
                if now != (told := tuple(names[begin].tolist())):
                    if held:
                        yield hand_on()
                    now, held = told, {}
                for lo in range(begin, end, step):
                    part = b.slice(lo, min(step, end - lo))
                    w = poisson_weights(part.column(4).to_numpy(zero_copy_only=False), replicates, seed)
                    of, y, s = np.array(part.column(3).to_pylist(), object), part.column(5).to_numpy(zero_copy_only=False), part.column(6).to_numpy(zero_copy_only=False)
                    held.setdefault(None, _Area(replicates)).add(s, y, w)
                    for c in dict.fromkeys(of.tolist()):
                        own = np.flatnonzero(of == c)
                        held.setdefault(c, _Area(replicates)).add(s[own], y[own], w[own])
        if held:
            yield hand_on()

    parts = ordered.mapInArrow(run, "form int, range int, class string, pos binary, neg binary, net binary")
    sums = parts.groupBy("form", "class").applyInPandas(_carried, "form int, class string, replicate long, pos double, neg double, net double")
    area = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("net") / (F.col("pos") * F.col("neg")))
    of = lambda i, c: F.when((F.col("form") == i) & c, area)
    pooled = [F.max(of(i, F.col("class").isNull())).alias(f"pooled_{s}") for i, s in enumerate(scores)]
    macro = [F.avg(of(i, F.col("class").isNotNull() & (F.col("pos") >= least))).alias(f"macro_{s}") for i, s in enumerate(scores)]
    return sums.groupBy("replicate").agg(*pooled, *macro)


def interval(sums: DataFrame, statistic: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """point, ci_low, ci_high and p (two-sided, of 0) of a column expression over the sums, for each group of `by`. Replicates in which it is null don't count."""
    rows = sums.select(*by, "replicate", statistic.alias("v"))
    drawn = F.when(F.col("replicate") > 0, F.col("v"))
    share = lambda c: F.avg(F.when(drawn.isNotNull(), F.when(c, 1.0).otherwise(0.0)))
    aggs = [F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("point"), F.percentile(drawn, F.lit(0.025)).alias("ci_low"), F.percentile(drawn, F.lit(0.975)).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("v") <= 0), share(F.col("v") >= 0))).alias("p")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def _per_uid(columns: int):
    """mapInArrow function: of groups' rows ([x..., y] each), by number of rows, how many groups and the sums of z z' over rows and of (sum z)(sum z)' over groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            each = b.column(0)
            sizes = each.value_lengths().to_numpy(zero_copy_only=False)
            flat = each.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
            start = np.r_[0, np.cumsum(sizes)]
            for n in set(sizes.tolist()):
                if n == 0:
                    continue
                own = np.flatnonzero(sizes == n)
                z = flat[(start[own][:, None] + np.arange(n)).reshape(-1)].reshape(len(own), n, columns)
                total = held.setdefault(n, [0, np.zeros((columns, columns)), np.zeros((columns, columns))])
                total[0] += len(own)
                rows, sums = z.reshape(-1, columns), z.sum(axis=1)
                total[1] += rows.T @ rows
                total[2] += sums.T @ sums
        out = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([t[0] for _, t in out], pa.int64()), pa.array([t[1].tobytes() for _, t in out], pa.binary()), pa.array([t[2].tobytes() for _, t in out], pa.binary())], ["n", "uids", "zz", "ss"])

    return run


def random_intercept(df: DataFrame, columns: list[str], outcome: str, uid: str = "uid") -> list[tuple[str, float, float]]:
    """(term, estimate, standard error) of outcome on 0/1 or numeric columns with a random intercept for each uid, by REML.

    Spark reduces the rows to products of sums for each number of rows that a uid has; the one variance ratio is then
    searched on the driver over these few matrices. No rows: no entries. The last two entries are the residual and the intercept's variance.
    """
    p = len(columns)
    rows = df.select(uid, F.array(*[F.col(c).cast("double") for c in (*columns, outcome)]).alias("z")).filter(F.forall("z", lambda x: x.isNotNull()))
    groups = rows.groupBy(uid).agg(F.collect_list("z").alias("z")).select("z")  # a uid's own rows
    by_n: dict[int, list] = {}
    for r in groups.mapInArrow(_per_uid(p + 1), "n long, uids long, zz binary, ss binary").collect():  # a row for each partition and number of rows of a uid
        total = by_n.setdefault(r["n"], [0, 0.0, 0.0])
        total[0] += r["uids"]
        for i, k in ((1, "zz"), (2, "ss")):
            total[i] = total[i] + np.frombuffer(bytes(r[k]), np.float64).reshape(p + 1, p + 1)
    total = sum(n * t[0] for n, t in by_n.items())
    if not total:
        return []

    def solve(ratio: float):
        m, logs = np.zeros((p + 1, p + 1)), 0.0
        for n, (uids, zz, ss) in by_n.items():
            m += zz - ratio / (1 + ratio * n) * ss
            logs += uids * math.log1p(ratio * n)
        a, b, c = m[:p, :p], m[:p, p], m[p, p]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        rss = max(1e-12, c - b @ beta)
        sign, det = np.linalg.slogdet(a + 1e-9 * np.eye(p))
        return beta, a, rss, (total - p) * math.log(rss / max(1, total - p)) + logs + det

    lo, hi = -12.0, 6.0
    golden = (math.sqrt(5) - 1) / 2
    x1, x2 = hi - golden * (hi - lo), lo + golden * (hi - lo)
    f1, f2 = solve(math.exp(x1))[3], solve(math.exp(x2))[3]
    for _ in range(60):
        if f1 < f2:
            hi, x2, f2 = x2, x1, f1
            x1 = hi - golden * (hi - lo)
            f1 = solve(math.exp(x1))[3]
        else:
            lo, x1, f1 = x1, x2, f2
            x2 = lo + golden * (hi - lo)
            f2 = solve(math.exp(x2))[3]
    ratio = math.exp((lo + hi) / 2)
    beta, a, rss, _ = solve(ratio)
    variance = rss / max(1, total - p)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(a)) * variance))
    return [*zip(columns, beta.tolist(), se.tolist(), strict=True), ("residual variance", float(variance), 0.0), ("intercept variance", float(ratio * variance), 0.0)]
