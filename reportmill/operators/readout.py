"""Thresholds, AUROC, probes and prior shift over scores of (uid, class) cells.

Classes are few and their cells many. Whatever needs an order of scores works on counts of cells by score, with running
sums in ranges of scores (`ranks.running`), so no task holds all cells of a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import ratio
from .ranks import quantiles, running, small
from .sums import Passes, minimise

#: Digits to which probabilities are told apart when a prior is fitted.
PRIOR_DIGITS = 4
#: A cutoff that no probability reaches, and that of slots without positives.
NO_CALLS, UNTOLD = 1.1, 0.5


def histogram(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """groups, s, n and pos: cells and positive cells at each score."""
    return scores.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"))


def auroc(scores: DataFrame, by: list[str], least: int = 1, **how) -> DataFrame:
    """groups, n_pos, n_neg and auroc (ties count half); groups with fewer than `least` positives or negatives are left out."""
    bins = histogram(scores, by, **how).withColumn("neg", F.col("n") - F.col("pos"))
    below = F.col("all_neg") - F.col("upto_neg")
    rows = running(bins, by, ["neg"]).withColumn("net", F.col("pos") * (below + F.col("neg") / 2.0))
    total = rows.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("net").alias("net"))
    return total.filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least)).select(*by, "n_pos", "n_neg", (F.col("net") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def f1_threshold(scores: DataFrame, by: list[str], **how) -> DataFrame:
    """groups, threshold and f1: the cutoff (calls are scores at or above it) with the best f1; of equals the largest cutoff. Without positives nothing is called: the largest score + 1."""
    rows = running(histogram(scores, by, **how), by, ["pos", "n"])
    rows = rows.withColumn("f1", ratio(2.0 * F.col("upto_pos"), F.col("upto_n") + F.col("all_pos")))
    best = rows.groupBy(*by).agg(F.max(F.struct("f1", "s")).alias("m"), F.max("s").alias("top"), F.max("all_pos").alias("pos"))
    return best.select(*by, F.when(F.col("pos") > 0, F.col("m.s")).otherwise(F.col("top") + 1).alias("threshold"), F.col("m.f1").alias("f1"))


def apply_threshold(scores: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """scores with called (0 or 1). Thresholds are broadcast while they are few."""
    return scores.join(small(thresholds.select(*by, "threshold")), by).withColumn("called", F.when(F.col(score) >= F.col("threshold"), 1).otherwise(0)).drop("threshold")


def prevalence_threshold(dev: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """groups, k and threshold: k is the dev rate of positives times the test cells (half to even), the threshold the k-th largest test score, or for k = 0 the largest + 1."""
    rate = dev.groupBy(*by).agg(F.avg("y").alias("rate"))
    bins = running(histogram(test, by), by, ["n"])
    size = test.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"))
    want = rate.join(size, by).select(*by, F.bround(F.col("rate") * F.col("cells")).cast("long").alias("k"))
    found = bins.join(small(want), by).filter(F.col("upto_n") >= F.col("k")).groupBy(*by, "k").agg(F.max("s").alias("s"))
    return found.select(*by, "k", F.when(F.col("k") > 0, F.col("s")).otherwise(F.col("s") + 1).alias("threshold"))


def expected_f1_threshold(probabilities: DataFrame, by: list[str]) -> DataFrame:
    """groups, k, threshold and expected f1: the number of calls, from the largest probability down, with the best 2 * sum(p) / (k + sum of all p). Where all probabilities are 0 nothing is called: k = 0, threshold NO_CALLS."""
    bins = probabilities.groupBy(*by, F.col("score").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    rows = running(bins.withColumn("mass", F.col("n") * F.col("s")), by, ["n", "mass"])
    rows = rows.withColumn("f", ratio(2.0 * F.col("upto_mass"), F.col("upto_n") + F.col("all_mass")))
    best = rows.groupBy(*by).agg(F.max(F.struct("f", "s", "upto_n")).alias("m"), F.max("all_mass").alias("mass"))
    told = lambda c, other: F.when(F.col("mass") > 0, F.col(c)).otherwise(other)
    return best.select(*by, told("m.upto_n", 0).alias("k"), told("m.s", NO_CALLS).alias("threshold"), told("m.f", 0.0).alias("expected_f1"))


def quantile_threshold(scores: DataFrame, by: list[str], steps: int = 200) -> DataFrame:
    """groups, threshold and f1: the best of steps + 1 quantiles of the scores; of equals the smallest. Without positives UNTOLD."""
    rows = quantiles(histogram(scores, by), by, steps, ("pos",)).withColumn("f1", ratio(2.0 * F.col("upto_pos"), F.col("upto_n") + F.col("all_pos")))
    best = rows.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("t")).alias("u"))).alias("m"), F.max("all_pos").alias("pos"))
    return best.select(*by, F.when(F.col("pos") > 0, -F.col("m.u")).otherwise(UNTOLD).alias("threshold"), F.col("m.f1").alias("f1"))


def matched_calls(scores: DataFrame, calls: DataFrame, by: list[str], uid: str = "uid") -> DataFrame:
    """groups and uid of as many top scores as there are calls in each group, ties by uid.

    The cutoff comes from running counts; only the cells at the cutoff are ranked, in salts of their group.
    """
    want = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    bins = running(histogram(scores.withColumn("y", F.lit(0)), by), by, ["n"]).join(small(want), by)
    cut = bins.filter(F.col("upto_n") >= F.col("k")).groupBy(*by, "k").agg(F.max(F.struct("s", (F.col("upto_n") - F.col("n")).alias("before"))).alias("m")).select(*by, F.col("m.s").alias("cut"), (F.col("k") - F.col("m.before")).alias("left"))
    rows = scores.join(small(cut), by)
    over = rows.filter(F.col("score") > F.col("cut")).select(*by, uid)
    edge = rows.filter(F.col("score") == F.col("cut")).withColumn("__salt", F.pmod(F.xxhash64(uid), F.lit(64)))
    first = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(uid))
    edge = edge.withColumn("__r", first).filter(F.col("__r") <= F.col("left"))
    second = F.row_number().over(Window.partitionBy(*by).orderBy(uid))
    return over.unionByName(edge.withColumn("__r", second).filter(F.col("__r") <= F.col("left")).select(*by, uid))


def pool_tokens(vectors: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """groups and vec: the mean of each dimension, then the largest of each."""
    each = vectors.select(*by, F.posexplode(vec).alias("dim", "v")).groupBy(*by, "dim").agg(F.avg("v").alias("m"), F.max("v").alias("x"))
    held = F.array_sort(F.collect_list(F.struct("dim", "m", "x")))  # a row for each dimension
    return each.groupBy(*by).agg(held.alias("d")).select(*by, F.concat(F.col("d.m"), F.col("d.x").cast("array<double>")).alias("vec"))


def fit_logistic(rows: DataFrame, targets: int, c_grid: tuple[float, ...], most: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Weights [target, C, dimension + 1] of balanced L2 logistic regressions, all fitted at once.

    rows, which are kept (cached or written): vec (doubles) and hot, the numbers of the targets that are positive for the row. Every pass over the rows gives
    loss and gradient of all regressions at their trial points; L-BFGS with halved steps goes on for each by itself. A target
    without both kinds of rows keeps weights of 0, and so probabilities of one half.
    """
    spark = rows.sparkSession
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, d, grid = total["n"], total["d"] or 0, len(c_grid)
    w = np.zeros((targets, grid, d + 1))
    if not n or not targets:
        return w
    pos = np.zeros(targets)
    for r in rows.select(F.explode("hot").alias("t")).groupBy("t").count().collect():  # a row for each target
        pos[r["t"]] = r["count"]
    live = np.flatnonzero((pos > 0) & (pos < n))
    share = np.stack([n / (2 * np.maximum(1, n - pos)), n / (2 * np.maximum(1, pos))])[:, live]
    penalty = 1 / (np.array(c_grid) * n)

    passes = Passes(rows.select("vec", "hot"))

    def losses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((points, live, share))

        def add(b: pa.RecordBatch) -> np.ndarray:
            p, own, share = shared.value
            place = np.full(targets, -1)
            place[own] = np.arange(len(own))
            x = np.c_[b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d), np.ones(b.num_rows)]
            y = np.zeros((b.num_rows, len(own)))
            hot = b.column(1)
            t = place[hot.flatten().to_numpy(zero_copy_only=False)] if len(hot.flatten()) else np.zeros(0, int)
            row = np.repeat(np.arange(b.num_rows), hot.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            y[row[t >= 0], t[t >= 0]] = 1
            z = (x @ p.T).reshape(b.num_rows, len(own), grid)
            weight = np.where(y == 1, share[1], share[0])[:, :, None]
            f = (weight * np.logaddexp(0, np.where(y[:, :, None] == 1, -z, z))).sum(axis=0)
            slope = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[:, :, None])
            return np.r_[f.reshape(-1), (slope.reshape(b.num_rows, -1).T @ x).reshape(-1)]

        total = passes.total(add, points.size + len(points))
        shared.destroy()
        ridge = np.tile(penalty, len(live))[:, None] * points
        ridge[:, -1] = 0
        return total[: len(points)] / n + (ridge * points).sum(axis=1) / 2, total[len(points) :].reshape(points.shape) / n + ridge

    w[live] = minimise(losses, np.zeros((len(live) * grid, d + 1)), most, tolerance).reshape(len(live), grid, d + 1)
    return w


def _standardised(features: DataFrame, columns: list[str], vec: str, split: str) -> DataFrame:
    """columns and vec, scaled by the training rows' mean and deviation."""
    rows = features.select(*columns, array_to_vector(F.col(vec).cast("array<double>")).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows.filter(F.col(split) == "train"))
    return scaler.transform(rows).select(*columns, vector_to_array("scaled").alias("vec"))


def _probabilities(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """keep, target, c (numbers) and p of every row and regression."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        many, d = w.shape[0] * w.shape[1], w.shape[2]
        target, c = (pa.array(a.reshape(-1).astype(np.int32)) for a in np.indices(w.shape[:2]))
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                x = np.c_[part.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d - 1), np.ones(part.num_rows)]
                p = 1 / (1 + np.exp(-np.clip(x @ w.reshape(many, d).T, -500, 500)))
                at = pa.array(np.repeat(np.arange(part.num_rows), many))
                tile = pa.array(np.tile(np.arange(many), part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(keep))), target.take(tile), c.take(tile), pa.array(p.reshape(-1))], [*keep, "target", "c", "p"])

    return rows.select(*keep, "vec").mapInArrow(run, f"{kinds}, target int, c int, p double")


def probe(features: DataFrame, classes: list, c_grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0), vec: str = "vec", label: str = "label", split: str = "split", uid: str = "uid") -> DataFrame:
    """uid, class, y, split, c and p of a balanced logistic probe for each class, all fitted at once on the training rows; C is chosen by dev AUROC, of equals the first."""
    rows = _standardised(features, [uid, label, split], vec, split).persist()
    number = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(classes)], F.lit(-1))
    hot = F.when(number(label) >= 0, F.array(number(label))).otherwise(F.array().cast("array<int>"))
    weights = fit_logistic(rows.filter(F.col(split) == "train").select("vec", hot.alias("hot")), len(classes), c_grid)
    told = _probabilities(rows, weights, [uid, label, split]).withColumn("y", F.when(number(label) == F.col("target"), 1).otherwise(0))
    quality = {(r["target"], r["c"]): r["auroc"] for r in auroc(told.filter(F.col(split) == "dev").withColumnRenamed("p", "score"), ["target", "c"]).collect()}  # a row for each class and C
    best = np.array([max(range(len(c_grid)), key=lambda j: (quality.get((i, j), 0.5), -j)) for i in range(len(classes))], int)
    rows.unpersist()
    chosen = np.stack([weights[i, j] for i, j in enumerate(best)])[:, None, :]
    out = _probabilities(_standardised(features, [uid, label, split], vec, split), chosen, [uid, label, split])
    kind = features.schema[label].dataType.simpleString()
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("target") + 1).cast(kind)
    return out.select(uid, pick(classes, kind).alias("class"), F.when(number(label) == F.col("target"), 1).otherwise(0).alias("y"), split, pick([float(c_grid[j]) for j in best], "double").alias("c"), "p")


def drawn_numbers(keys: np.ndarray, targets: int) -> np.ndarray:
    """A 64-bit number for each key and target; numbers of one target are as distinct as the keys."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64)[:, None] + (np.arange(targets, dtype=np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def smallest(keys: DataFrame, wanted: np.ndarray, digit: int = 12) -> np.ndarray:
    """For each target the number up to which just wanted[target] of the keys (a table of one long column, kept) have theirs.

    Numbers are told apart `digit` bits a pass, from the highest down: a pass adds up a histogram a target, no row is moved.
    """
    passes, targets, spark = Passes(keys), len(wanted), keys.sparkSession
    found, before, shift, done = np.zeros(targets, np.uint64), np.zeros(targets), 64, np.zeros(targets, bool)
    while shift and not done.all():
        width = min(digit, shift)
        shift -= width
        shared = spark.sparkContext.broadcast((found, shift, width))

        def add(b: pa.RecordBatch, shared=shared) -> np.ndarray:
            found, shift, width = shared.value
            total = np.zeros((targets, 1 << width))
            values = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(values), 2000):
                x = drawn_numbers(values[lo : lo + 2000], targets)
                at, of = np.nonzero((x >> np.uint64(shift) >> np.uint64(width)) == found if shift + width < 64 else np.ones(x.shape, bool))
                np.add.at(total, (of, (x[at, of] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)), 1)
            return total.reshape(-1)

        upto = before[:, None] + np.cumsum(passes.total(add, targets << width).reshape(targets, -1), axis=1)
        shared.destroy()
        place = np.array([np.searchsorted(u, w) for u, w in zip(upto, wanted, strict=True)]).clip(0, (1 << width) - 1)
        at = np.arange(targets)
        # A digit whose last number is the last wanted one ends the search: all further bits are ones.
        exact = upto[at, place] == wanted
        before = np.where(done, before, np.where(place > 0, upto[at, place - 1], before))
        found = np.where(done, found << np.uint64(width) | np.uint64((1 << width) - 1), found << np.uint64(width) | place.astype(np.uint64))
        done |= exact
    return found << np.uint64(shift) | np.uint64((1 << shift) - 1) if shift else found


def shuffled_null(features: DataFrame, classes: list, shuffles: int, c: float = 0.01, seed: str = "shuffle", vec: str = "vec", label: str = "label", split: str = "split", uid: str = "uid") -> DataFrame:
    """class, auroc on the test rows, mean and 2.5 and 97.5 % points of the AUROCs of probes fitted on permuted training labels, and perm_p.

    A permutation of 0/1 labels is a draw of as many rows as there are positives: those with the smallest numbers hashed from
    seed, uid and shuffle. Draws are told in the rows themselves, so no row is moved or repeated for them.
    """
    rows = _standardised(features, [uid, label, split], vec, split).persist()
    own = F.coalesce(*[F.when(F.col(label) == v, F.lit(i)) for i, v in enumerate(classes)], F.lit(-1))
    train = rows.filter(F.col(split) == "train").select(F.xxhash64(F.lit(seed), uid).alias("key"), own.alias("own"), "vec").persist()
    many = np.zeros(len(classes), np.int64)
    for r in train.filter("own >= 0").groupBy("own").count().collect():  # a row for each class
        many[r["own"]] = r["count"]
    each = shuffles + 1
    upto = smallest(train.select("key"), np.repeat(many, shuffles)) if shuffles else np.zeros(0, np.uint64)
    target = np.array([i * each + s + 1 for i in range(len(classes)) for s in range(shuffles)], np.int64)
    some = np.repeat(many > 0, shuffles)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hot = [(i * each,) if i >= 0 else () for i in b.column(1).to_pylist()]
            drawn = (drawn_numbers(b.column(0).to_numpy(zero_copy_only=False), len(target)) <= upto) & some
            told = pa.array([[*h, *target[d].tolist()] for h, d in zip(hot, drawn, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(2), told], ["vec", "hot"])

    fitted = train.mapInArrow(marked, "vec array<double>, hot array<int>").persist()
    weights = fit_logistic(fitted, len(classes) * each, (c,))
    fitted.unpersist()
    train.unpersist()
    told = _probabilities(rows.filter(F.col(split) == "test"), weights, [uid, label])
    meant = F.element_at(F.array(*[F.lit(v) for v in classes]), F.floor(F.col("target") / each).cast("int") + 1)
    got = auroc(told.withColumn("y", F.when(F.col(label) == meant, 1).otherwise(0)).withColumnRenamed("p", "score"), ["target"]).collect()  # a row for each class and shuffle
    rows.unpersist()
    by_class: dict[int, dict[int, float]] = {}
    for r in got:
        by_class.setdefault(r["target"] // each, {})[r["target"] % each] = r["auroc"]
    out = []
    for i, of in sorted(by_class.items()):
        null = [x for s, x in of.items() if s]
        if 0 in of and null:
            lo, hi = np.percentile(null, [2.5, 97.5])
            out.append((classes[i], of[0], float(np.mean(null)), float(lo), float(hi), permutation_p(of[0], null)))
    return features.sparkSession.createDataFrame(out, f"class {features.schema[label].dataType.simpleString()}, auroc double, null_mean double, null_lo double, null_hi double, perm_p double")


def platt(dev: DataFrame, scores: DataFrame, by: str = "class", score: str = "score", y: str = "y") -> DataFrame:
    """scores with p, by a logistic regression of y on the score for each class over dev, all fitted at once on counts by score; classes that dev hasn't are left out."""
    bins = histogram(dev, [by], score, y).persist()
    names = [r[by] for r in bins.select(by).distinct().orderBy(by).collect()]  # a class each
    kind = f"{by} {dev.schema[by].dataType.simpleString()}, __a double, __b double"
    spark, at = scores.sparkSession, {c: i for i, c in enumerate(names)}
    line = lambda points: F.broadcast(spark.createDataFrame([(c, *map(float, points[i])) for c, i in at.items()], kind))
    z = F.col("__a") * F.col("s") + F.col("__b")

    def losses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = bins.join(line(points), by).withColumn("__z", z).withColumn("__r", F.col("n") / (1 + F.exp(-F.col("__z"))) - F.col("pos"))
        loss = F.col("n") * (F.greatest("__z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("__z")))) - F.col("pos") * F.col("__z")
        found = rows.groupBy(by).agg(F.sum("n").alias("n"), F.sum(loss).alias("f"), F.sum(F.col("__r") * F.col("s")).alias("a"), F.sum("__r").alias("b")).collect()
        f, g = np.zeros(len(names)), np.zeros((len(names), 2))
        for r in found:
            f[at[r[by]]], g[at[r[by]]] = r["f"] / r["n"], (r["a"] / r["n"], r["b"] / r["n"])
        return f, g

    fitted = minimise(losses, np.zeros((len(names), 2)), 60, 1e-7) if names else np.zeros((0, 2))
    bins.unpersist()
    return scores.join(line(fitted), by).withColumn("p", 1 / (1 + F.exp(-(F.col("__a") * F.col(score) + F.col("__b"))))).drop("__a", "__b")


def clipped(prior: float) -> float:
    """A prior that leaves both answers possible."""
    return min(max(prior, 1e-6), 1 - 1e-6)


def em_prior(bins: list[tuple[float, int]], source: float, tolerance: float = 1e-7, most: int = 200) -> float:
    """Prior of a shifted set from (probability, count) bins of probabilities made under the source prior; both are clipped."""
    p, n = np.array([b[0] for b in bins]), np.array([b[1] for b in bins], float)
    prior = source = clipped(source)
    for _ in range(most):
        new = float((shifted(p, source, prior) * n).sum() / max(1.0, n.sum()))
        done, prior = abs(new - prior) < tolerance, new
        if done:
            break
    return clipped(prior)


def shifted(p, source: float, prior: float):
    """Probability (a number or array) under another prior."""
    a, b = prior / source * p, (1 - prior) / (1 - source) * (1 - p)
    return a / np.maximum(a + b, 1e-12)


def shifted_column(p: Column, source: Column, prior: Column) -> Column:
    """Probability under another prior; the source's is clipped."""
    told = F.least(F.greatest(source, F.lit(1e-6)), F.lit(1 - 1e-6))
    a, b = prior / told * p, (1 - prior) / (1 - told) * (1 - p)
    return a / F.greatest(a + b, F.lit(1e-12))


def shift_prior(scores: DataFrame, source: dict, by: str = "class", digits: int = PRIOR_DIGITS, p: str = "p") -> DataFrame:
    """scores with prior (by EM for each class from the source's, on the means of at most 10 ** digits + 1 bins) and p_shifted."""
    bins: dict = {}
    for r in scores.groupBy(by, F.round(p, digits)).agg(F.avg(p).alias("p"), F.count(F.lit(1)).alias("count")).select(by, "p", "count").collect():
        bins.setdefault(r[by], []).append((r["p"], r["count"]))
    prior = {c: em_prior(b, source[c]) for c, b in bins.items()}
    pick = lambda d: F.coalesce(*[F.when(F.col(by) == c, F.lit(float(v))) for c, v in d.items()]) if d else F.lit(None).cast("double")
    rows = scores.withColumn("prior", pick(prior))
    return rows.withColumn("p_shifted", shifted_column(F.col(p), pick({c: source[c] for c in prior}), F.col("prior")))


def site_mean(scores: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(p).alias(p))


def site_posteriors(scores: DataFrame, train: DataFrame, dev: DataFrame, by: list[str], uid: str = "uid", p: str = "p") -> DataFrame:
    """by, uid and of each cell the posteriors raw (as given), dev (under the dev rate) and em (under the prior found by EM), from the training rate's prior.

    by: site and class. scores, train and dev hold cells of each site; a site's class without training cells is left out.
    """
    rate = lambda df, name: df.groupBy(*by).agg(F.avg("y").cast("double").alias(name))
    rates = small(rate(train, "__source").join(rate(dev, "__dev"), by))
    rows = scores.join(rates, by).withColumn("__key", F.struct(*by))
    source = {tuple(r[c] for c in by): r["__source"] for r in rates.collect()}  # a row for each site and class
    names = {k: i for i, k in enumerate(source)}
    number = F.coalesce(*[F.when(_all(F.col(c) == v for c, v in zip(by, k, strict=True)), F.lit(i)) for k, i in names.items()], F.lit(-1))
    told = shift_prior(rows.withColumn("__n", number), {i: source[k] for k, i in names.items()}, "__n", p=p)
    return told.select(uid, *by, F.col(p).alias("raw"), shifted_column(F.col(p), F.col("__source"), F.col("__dev")).alias("dev"), F.col("p_shifted").alias("em"))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def decide(posteriors: DataFrame, by: list[str], dev: DataFrame | None = None) -> DataFrame:
    """posteriors (score) with called: at or above the cutoff of the best expected f1 under the posteriors themselves or, with dev's scores and labels, that of the best f1 on dev. Classes without mass, or without both labels on dev, call nothing."""
    if dev is None:
        cut = expected_f1_threshold(posteriors, by)
    else:
        both = dev.groupBy(*by).agg(F.min("y").alias("__lo"), F.max("y").alias("__hi")).filter("__lo = 0 and __hi = 1").select(*by)
        cut = f1_threshold(dev.join(small(both), by, "left_semi"), by)
    mass = posteriors.groupBy(*by).agg(F.max("score").alias("__top")).filter("__top > 0").select(*by)
    thresholds = small(cut.join(mass, by, "left_semi").select(*by, "threshold"))
    return posteriors.join(thresholds, by, "left").withColumn("called", F.when(F.col("score") >= F.col("threshold"), 1).otherwise(0)).drop("threshold")


def conversion(cells: DataFrame, by: list[str], truth: str = "t", model: str = "m", found: str = "r", said: str = "x") -> DataFrame:
    """By group: misses of the model, those recovered by a probe, the share of recovered ones that a second answer states, and its flag rate. Columns are 0 or 1."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    miss = (F.col(truth) == 1) & (F.col(model) == 0)
    got = miss & (F.col(found) == 1)
    rows = cells.groupBy(*by).agg(one(miss).alias("misses"), one(got).alias("recovered"), one(got & (F.col(said) == 1)).alias("expressed"), F.avg(said).alias("flag_rate"))
    return rows.withColumn("conversion", ratio(F.col("expressed"), F.col("recovered")))


def permutation_p(observed: float, null: list[float]) -> float:
    """Share of shuffled results at least as large as the observed one, itself counted."""
    return (sum(x >= observed for x in null) + 1) / (len(null) + 1)


def probe_report(scores: DataFrame, calls: DataFrame, by: list[str], uid: str = "uid", y: str = "y") -> DataFrame:
    """By group: f1 of a model's calls and of as many top scores, their difference, the model's misses and those that the scores recover."""
    model = calls.select(*by, uid).distinct().withColumn("m", F.lit(1))
    matched = matched_calls(scores, calls, by, uid).withColumn("r", F.lit(1))
    cells = scores.select(*by, uid, F.col(y).alias("y")).join(model, [*by, uid], "left").join(matched, [*by, uid], "left").fillna(0, ["m", "r"])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    total = cells.groupBy(*by).agg(F.sum("y").alias("pos"), F.sum("m").alias("called"), n((F.col("y") == 1) & (F.col("m") == 1)).alias("tp_m"), n((F.col("y") == 1) & (F.col("r") == 1)).alias("tp_r"), F.sum("r").alias("called_r"), n((F.col("y") == 1) & (F.col("m") == 0)).alias("misses"), n((F.col("y") == 1) & (F.col("m") == 0) & (F.col("r") == 1)).alias("recovered"))
    f1 = lambda tp, called: ratio(2.0 * F.col(tp), F.col("pos") + F.col(called))
    return total.select(*by, f1("tp_m", "called").alias("f1_model"), f1("tp_r", "called_r").alias("f1_probe"), (f1("tp_r", "called_r") - f1("tp_m", "called")).alias("gain"), "misses", "recovered")
