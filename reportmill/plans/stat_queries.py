"""Queries of paired statistics, resampling, thresholds and probes, over events, embeddings and derived scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itertools import combinations

from .. import taxonomy as tx
from ..functions import sets
from ..operators import pairstats, ranks, readout, resampling, scoring
from ..sources import studies
from .derived import CONDITIONS, _lists, sql, table
from .score_queries import _F1, _H, _LEVELS, _P, _R, EVENTS, events, scored
from .text_queries import query

TYPES = ["click", "error", "purchase", "signup", "view"]
_PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]


def _wide(value: str) -> str:
    return "SELECT uid, " + ", ".join(f"avg({value}) FILTER (WHERE prompt_condition = '{t}') AS c{i}" for i, t in enumerate(TYPES)) + " FROM ev GROUP BY uid"


_MC = {"ev": EVENTS, "wide": _wide("correct"), "ints": "SELECT " + ", ".join(f"CAST(trunc(c{i}) AS INTEGER) AS c{i}" for i in range(5)) + " FROM wide WHERE " + " AND ".join(f"c{i} IS NOT NULL" for i in range(5))}
_MC_SQL = " UNION ALL ".join(f"SELECT '{TYPES[i]}' AS a, '{TYPES[j]}' AS b, count(*) AS n, avg(c{i}) AS mean_a, avg(c{j}) AS mean_b, CAST(sum(CASE WHEN c{i} = 0 AND c{j} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n01, CAST(sum(CASE WHEN c{i} = 1 AND c{j} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n10 FROM ints" for i, j in _PAIRS)


@query("mcnemar_pairs", sql(_MC_SQL, more=_MC))
def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairstats.mcnemar_counts(events(spark, sf_dir), TYPES)


@query("mcnemar_tests", None)
def mcnemar_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("ok", F.when(F.col("correct"), 1).otherwise(0))
    return pairstats.mcnemar(rows, ["direct", "cot", "ddx", "evidence_first", "uncertainty_first"], "ok")


@query("mcnemar_best", None)
def mcnemar_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition that is right most often against each other one."""
    rows = scored(spark, sf_dir).withColumn("ok", F.when(F.col("correct"), 1).otherwise(0))
    best = rows.groupBy("prompt_condition").agg(F.avg("ok").alias("v")).orderBy(F.desc("v"), "prompt_condition").first()["prompt_condition"]
    return pairstats.mcnemar_best(rows, list(CONDITIONS), best, "ok")


_XY = {"ev": EVENTS, "wide": _wide("value"), "xy": " UNION ALL ".join(f"SELECT '{TYPES[i]}' AS a, '{TYPES[j]}' AS b, c{i} AS x, c{j} AS y, c{i} - c{j} AS d FROM wide WHERE c{i} IS NOT NULL AND c{j} IS NOT NULL" for i, j in _PAIRS)}
_RANKS = {"r": "SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM xy WHERE d <> 0"}


@query("wilcoxon_pairs", sql("""SELECT p.a, p.b, p.pairs, coalesce(w.n, 0) AS n, p.median_a, p.median_b, coalesce(w_plus, 0.0::DOUBLE) AS w_plus, coalesce(w_minus, 0.0::DOUBLE) AS w_minus, coalesce(ties, 0.0::DOUBLE) AS ties
  FROM (SELECT a, b, count(*) AS pairs, quantile_cont(x, 0.5) AS median_a, quantile_cont(y, 0.5) AS median_b FROM xy GROUP BY a, b) p
  LEFT JOIN (SELECT a, b, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY a, b) w USING (a, b)""", more=_XY | _RANKS))
def wilcoxon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairstats.signed_ranks(events(spark, sf_dir), TYPES, "value", order="event_id")


@query("wilcoxon_tests", None)
def wilcoxon_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairstats.wilcoxon(events(spark, sf_dir), TYPES, "value", order="event_id")


@query("cliffs_delta", sql("SELECT p.a, p.b, sum(CASE WHEN p.x > q.y THEN 1.0 WHEN p.x < q.y THEN -1.0 ELSE 0.0 END) / count(*) AS delta FROM xy p JOIN xy q ON p.a = q.a AND p.b = q.b GROUP BY 1, 2", more=_XY))
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairstats.cliffs_delta(events(spark, sf_dir), TYPES, "value", order="event_id")


@query("bh_fdr", """WITH p AS (SELECT c_nationkey AS family, c_custkey, (c_custkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
  SELECT family, c_custkey, p, least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY p DESC)) AS p_fdr FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("family"), "c_custkey", ((F.col("c_custkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return pairstats.fdr(p, ["family"], "p")


@query("dissociation", sql("SELECT a.c AS prompt_condition, a.v - b.v AS d_coherence, a.k - b.k AS d_faithfulness, a.v - b.v > 0 AND a.k - b.k <= 0.05 AS dissociation FROM m a, m b WHERE b.c = 'click' AND a.c <> 'click'", more={"ev": EVENTS, "m": "SELECT prompt_condition AS c, avg(value) AS v, avg(confidence) AS k FROM ev GROUP BY 1"}))
def dissociation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairstats.dissociation(events(spark, sf_dir), "click", "value", "confidence")


@query("paired_dissociation", None)
def paired_dissociation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions whose value or confidence rises significantly against the base while neither rate of right answers does."""
    rows = events(spark, sf_dir).withColumns({"rate": F.col("correct") * 1.0, "surety": F.col("confidence") * F.col("correct")})
    return pairstats.paired_dissociation(rows, "click", TYPES, ["value", "confidence"], ["rate", "surety"])


def _by_pair(sums: DataFrame, names, statistic) -> DataFrame:
    """replicate, a, b and v of each pair of names from one table of replicates."""
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), statistic(i, j).alias("v")) for (i, a), (j, b) in combinations(enumerate(names), 2)])
    return sums.select("replicate", F.explode(each).alias("s")).select("replicate", "s.*")


@query("bootstrap_diff", None)
def bootstrap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each of the ten pairs of conditions over the uids that have both, with 10,000 replicates."""
    wide = pairstats.paired(events(spark, sf_dir), TYPES, "value")
    both = lambda i, j: F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
    named = {f"d{i}{j}": F.when(both(i, j), F.col(f"c{i}") - F.col(f"c{j}")).otherwise(0.0) for i, j in _PAIRS} | {f"n{i}{j}": F.when(both(i, j), 1.0).otherwise(0.0) for i, j in _PAIRS}
    sums = resampling.replicate_sums(wide.select("uid", *[c.alias(n) for n, c in named.items()]), "uid", list(named), 10_000)
    pairs = _by_pair(sums, TYPES, lambda i, j: F.when(F.col(f"n{i}{j}") > 0, F.col(f"d{i}{j}") / F.col(f"n{i}{j}")))
    return resampling.interval(pairs, F.col("v"), ("a", "b"))


def _arm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("uid", "k", "difficulty", *sets.confusion(F.col("truth_h"), F.col("pred_h"), tx.FINDINGS), F.when(F.col("correct"), 1).otherwise(0).alias("ok"))
    return rows.groupBy("uid").agg(*[F.sum(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(5) for c in ("tp", "fp", "fn", "ok")], F.max("difficulty").alias("difficulty"))


@query("bootstrap_f1", None)
def bootstrap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of micro f1 (b - a) of each of the ten pairs of conditions."""
    names = [f"{c}{k}" for k in range(5) for c in ("tp", "fp", "fn")]
    sums = resampling.replicate_sums(_arm_counts(spark, sf_dir), "uid", names, 2000)
    f1 = lambda k: sets.ratio(2 * F.col(f"tp{k}"), 2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}"))
    return resampling.interval(_by_pair(sums, CONDITIONS, lambda i, j: f1(j) - f1(i)), F.col("v"), ("a", "b"))


@query("bootstrap_did", None)
def bootstrap_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each condition: its gain over the first one among ambiguous reports less that among the others."""
    in_ = F.col("difficulty") == "ambiguous"
    named = {"n1": F.when(in_, 1).otherwise(0), "n0": F.when(in_, 0).otherwise(1)}
    for k in range(1, 5):
        d = F.col(f"ok{k}") - F.col("ok0")
        named |= {f"d1{k}": F.when(in_, d).otherwise(0), f"d0{k}": F.when(in_, 0).otherwise(d)}
    sums = resampling.replicate_sums(_arm_counts(spark, sf_dir).select("uid", *[c.alias(n) for n, c in named.items()]), "uid", list(named), 2000)
    each = F.array(*[F.struct(F.lit(CONDITIONS[k]).alias("prompt_condition"), (sets.ratio(F.col(f"d1{k}"), F.col("n1")) - sets.ratio(F.col(f"d0{k}"), F.col("n0"))).alias("v")) for k in range(1, 5)])
    return resampling.interval(sums.select("replicate", F.explode(each).alias("s")).select("replicate", "s.*"), F.col("v"), ("prompt_condition",))


LABELS = 10


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, class, score, other, y and split of each embedding and class: every tenth component of the first half makes the score, of the second half another."""
    e = table(spark, sf_dir, "embeddings")
    part_sum = lambda at, c: F.aggregate(F.filter(F.slice("v", at, 32), lambda x, i: i % LABELS == c), F.lit(0.0), lambda a, x: a + x)
    each = F.transform(F.sequence(F.lit(0), F.lit(LABELS - 1)), lambda c: F.struct(c.alias("class"), part_sum(1, c).alias("score"), part_sum(33, c).alias("other"), F.when(F.col("label") == c, 1).otherwise(0).alias("y")))
    part = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "dev").otherwise("test")
    return e.select(F.col("vec_id").alias("uid"), part.alias("split"), F.col("embedding").cast("array<double>").alias("v"), "label").select("uid", "split", F.explode(each).alias("c")).select("uid", "split", "c.*")


def rare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells, and those of class 10, which has no positives, and of class 11, whose scores are all the least."""
    e = table(spark, sf_dir, "embeddings")
    part = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "dev").otherwise("test")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("class"), s.alias("score"), at(1).alias("other"), F.lit(0).alias("y")) for c, s in ((LABELS, at(0)), (LABELS + 1, F.lit(-1.0)))])
    return cells(spark, sf_dir).unionByName(e.select(F.col("vec_id").alias("uid"), part.alias("split"), F.explode(each).alias("c")).select("uid", "split", "c.*"))


_PART = lambda at: f"list_sum(list_filter(CAST(embedding[{at}:{at + 31}] AS DOUBLE[]), lambda x, i: (i - 1) % 10 = c))"
CELLS = {"cells": f"SELECT vec_id AS uid, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split, CAST(c AS INTEGER) AS class, {_PART(1)} AS score, {_PART(33)} AS other, CASE WHEN label = c THEN 1 ELSE 0 END AS y FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS c)"}
#: Cells of two more classes, one without positives and one without mass.
RARE_CELLS = {"cells": f"{CELLS['cells']} UNION ALL SELECT vec_id, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'dev' ELSE 'test' END, c, CASE WHEN c = 10 THEN CAST(embedding[1] AS DOUBLE) ELSE -1.0::DOUBLE END, CAST(embedding[2] AS DOUBLE), 0 FROM embeddings, (SELECT unnest([10, 11]) AS c)"}
_BINS = lambda where="TRUE": f"SELECT class, score AS s, count(*) AS n, sum(y) AS pos FROM cells WHERE {where} GROUP BY 1, 2"


@query("auroc", sql("SELECT class, CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg, sum(pos * (below + (n - pos) / 2.0)) / (any_value(np) * any_value(nn)) AS auroc FROM (SELECT *, sum(pos) OVER (PARTITION BY class) AS np, sum(n - pos) OVER (PARTITION BY class) AS nn, coalesce(sum(n - pos) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bins) GROUP BY class", more=CELLS | {"bins": _BINS()}))
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readout.auroc(cells(spark, sf_dir), ["class"])


@query("auroc_summary", sql("SELECT 'pooled' AS form, CAST(any_value(np) AS BIGINT) AS n_pos, sum(pos * (below + (n - pos) / 2.0)) / (any_value(np) * any_value(nn)) AS auroc FROM (SELECT *, sum(pos) OVER () AS np, sum(n - pos) OVER () AS nn, coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT s, sum(n) AS n, sum(pos) AS pos FROM bins GROUP BY s)) UNION ALL SELECT 'macro', CAST(sum(np) AS BIGINT), avg(a) FROM (SELECT class, any_value(np) AS np, sum(pos * (below + (n - pos) / 2.0)) / (any_value(np) * any_value(nn)) AS a FROM (SELECT *, sum(pos) OVER (PARTITION BY class) AS np, sum(n - pos) OVER (PARTITION BY class) AS nn, coalesce(sum(n - pos) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bins) GROUP BY class HAVING any_value(np) >= 5)", more=RARE_CELLS | {"bins": _BINS()}))
def auroc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC over all cells, and the mean of the classes' with five positives or more."""
    rows = rare_cells(spark, sf_dir)
    pooled = readout.auroc(rows, []).select(F.lit("pooled").alias("form"), "n_pos", "auroc")
    return pooled.unionByName(readout.auroc(rows, ["class"], least=1).filter("n_pos >= 5").agg(F.sum("n_pos").alias("n_pos"), F.avg("auroc").alias("auroc")).select(F.lit("macro").alias("form"), "n_pos", "auroc"))


@query("confidence_auroc", sql("SELECT prompt_condition, CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg, sum(pos * (below + (n - pos) / 2.0)) / (any_value(np) * any_value(nn)) AS auroc FROM (SELECT *, sum(pos) OVER (PARTITION BY prompt_condition) AS np, sum(n - pos) OVER (PARTITION BY prompt_condition) AS nn, coalesce(sum(n - pos) OVER (PARTITION BY prompt_condition ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bins) GROUP BY 1", "scored", more={"bins": "SELECT prompt_condition, confidence AS s, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS pos FROM scored GROUP BY 1, 2"}))
def confidence_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("prompt_condition", F.col("confidence").cast("double").alias("score"), F.when(F.col("correct"), 1).otherwise(0).alias("y"))
    return readout.auroc(rows, ["prompt_condition"])


_CUM = "SELECT class, s, n, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY class) AS total FROM bins WINDOW w AS (PARTITION BY class ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_BEST_CUT = "SELECT class, CASE WHEN total > 0 THEN s ELSE top + 1 END AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, s DESC) AS r, max(s) OVER (PARTITION BY class) AS top FROM (SELECT class, s, total, 2.0::DOUBLE * tp / (called + total) AS f1 FROM cum)) WHERE r = 1"


@query("f1max_threshold", sql(_BEST_CUT, more=RARE_CELLS | {"bins": _BINS("split = 'dev'"), "cum": _CUM}))
def f1max_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readout.f1_threshold(rare_cells(spark, sf_dir).filter("split = 'dev'"), ["class"])


@query("threshold_on_test", sql("SELECT c.class, CAST(sum(CASE WHEN c.score >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS called, CAST(sum(CASE WHEN c.score >= t.threshold THEN y ELSE 0 END) AS BIGINT) AS tp FROM cells c JOIN best t USING (class) WHERE c.split = 'test' GROUP BY c.class", more=RARE_CELLS | {"bins": _BINS("split = 'dev'"), "cum": _CUM, "best": _BEST_CUT}))
def threshold_on_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rare_cells(spark, sf_dir)
    called = readout.apply_threshold(rows.filter("split = 'test'"), readout.f1_threshold(rows.filter("split = 'dev'"), ["class"]), ["class"])
    return called.groupBy("class").agg(F.sum("called").alias("called"), F.sum(F.col("called") * F.col("y")).alias("tp"))


@query("prevalence_threshold", sql("SELECT class, k, CASE WHEN k > 0 THEN max(s) ELSE max(s) + 1 END AS threshold FROM cum JOIN (SELECT d.class, CAST(round_even(d.rate * t.n, 0) AS BIGINT) AS k FROM (SELECT class, avg(y) AS rate FROM cells WHERE split = 'dev' GROUP BY 1) d JOIN (SELECT class, count(*) AS n FROM cells WHERE split = 'test' GROUP BY 1) t USING (class)) USING (class) WHERE called >= k GROUP BY 1, 2", more=RARE_CELLS | {"bins": _BINS("split = 'test'"), "cum": _CUM}))
def prevalence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rare_cells(spark, sf_dir)
    return readout.prevalence_threshold(rows.filter("split = 'dev'"), rows.filter("split = 'test'"), ["class"])


_PROB = {"prob": "SELECT class, (score + 1) / 2 AS s, count(*) AS n FROM cells GROUP BY 1, 2", "cump": "SELECT class, s, CAST(sum(n) OVER w AS BIGINT) AS k, sum(n * s) OVER w AS mass, sum(n * s) OVER (PARTITION BY class) AS total FROM prob WINDOW w AS (PARTITION BY class ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}


@query("expected_f1_threshold", sql("SELECT class, CASE WHEN total > 0 THEN k ELSE 0 END AS k, CASE WHEN total > 0 THEN s ELSE 1.1::DOUBLE END AS threshold, CASE WHEN total > 0 THEN f ELSE 0.0::DOUBLE END AS expected_f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f DESC, s DESC) AS r FROM (SELECT *, 2.0 * mass / (k + total) AS f FROM cump)) WHERE r = 1", more=RARE_CELLS | _PROB))
def expected_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readout.expected_f1_threshold(rare_cells(spark, sf_dir).withColumn("score", (F.col("score") + 1) / 2), ["class"])


@query("quantile_threshold", sql("""SELECT class, CASE WHEN total > 0 THEN t ELSE 0.5::DOUBLE END AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, t) AS r FROM (
  SELECT b.class, q.t, sum(pos) AS total, 2.0::DOUBLE * sum(CASE WHEN s >= t THEN pos ELSE 0 END) / (sum(CASE WHEN s >= t THEN n ELSE 0 END) + sum(pos)) AS f1 FROM bins b JOIN grid q USING (class) GROUP BY 1, 2)) WHERE r = 1""", more=RARE_CELLS | {"bins": _BINS("split = 'dev'"),
  "listed": "SELECT class, list_sort(list(score)) AS v, count(*) AS n FROM cells WHERE split = 'dev' GROUP BY class",
  "places": "SELECT class, v[(i * (n - 1)) // 200 + 1] AS lo, v[least((i * (n - 1)) // 200 + 2, n)] AS hi, (i * (n - 1)) % 200 AS rest FROM listed, (SELECT unnest(range(201)) AS i)",
  "grid": "SELECT DISTINCT class, CASE WHEN rest = 0 OR lo = hi THEN lo WHEN lo + (hi - lo) * rest / 200 > lo THEN least(lo + (hi - lo) * rest / 200, hi) ELSE hi END AS t FROM places"}))
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readout.quantile_threshold(rare_cells(spark, sf_dir).filter("split = 'dev'"), ["class"])


_SCORE_GRID = {"listed": "SELECT event_type AS name, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1", "places": "SELECT name, i, v[(i * (n - 1)) // 20 + 1] AS lo, v[least((i * (n - 1)) // 20 + 2, n)] AS hi, (i * (n - 1)) % 20 AS rest FROM listed, (SELECT unnest(range(21)) AS i)"}


@query("value_quantiles", sql("SELECT name, CAST(i AS INTEGER) AS i, CASE WHEN rest = 0 OR lo = hi THEN lo ELSE lo + (hi - lo) * rest / 20 END AS t FROM places", more=_SCORE_GRID))
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact twentieths of each kind's values, from running counts by ranges."""
    bins = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.col("value").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.quantiles(bins, ["name"], 20).select("name", F.col("i").cast("int").alias("i"), "t")


@query("matched_commitment", sql("SELECT class, uid FROM (SELECT class, uid, row_number() OVER (PARTITION BY class ORDER BY score DESC, uid) AS r, sum(CASE WHEN other > 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY class) AS k FROM cells) WHERE r <= k", more=CELLS))
def matched_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    return readout.matched_calls(rows, rows.filter("other > 0.15"), ["class"])


@query("posterior_mean", sql("SELECT class, avg((score + other + 2) / 4) AS p, count(*) AS n FROM cells GROUP BY 1", more=CELLS))
def posterior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    sites = rows.select("uid", "class", F.explode(F.array("score", "other")).alias("s")).withColumn("p", (F.col("s") + 1) / 2)
    return readout.site_mean(sites, ["uid", "class"]).groupBy("class").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))


@query("conversion", sql("SELECT class, misses, recovered, expressed, flag_rate, CASE WHEN recovered > 0 THEN expressed * 1.0 / recovered ELSE 0.0 END AS conversion FROM (SELECT class, CAST(sum(CASE WHEN y = 1 AND NOT (score > 0.05) THEN 1 ELSE 0 END) AS BIGINT) AS misses, CAST(sum(CASE WHEN y = 1 AND NOT (score > 0.05) AND other > 0 THEN 1 ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN y = 1 AND NOT (score > 0.05) AND other > 0 AND uid % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS expressed, avg(CASE WHEN uid % 2 = 0 THEN 1 ELSE 0 END) AS flag_rate FROM cells GROUP BY 1)", more=CELLS))
def conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = cells(spark, sf_dir).select("class", F.col("y").alias("t"), one(F.col("score") > 0.05).alias("m"), one(F.col("other") > 0).alias("r"), one(F.col("uid") % 2 == 0).alias("x"))
    return readout.conversion(rows, ["class"])


@query("token_pool", "SELECT label, dim - 1 AS dim, avg(v) AS mean, CAST(max(v) AS DOUBLE) AS largest FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2")
def token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = readout.pool_tokens(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    half = F.size("vec") / 2
    return pooled.withColumn("h", half.cast("int")).select("label", "h", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - F.lit(1).cast("long"))).alias("dim")).select("label", "dim", F.get("vec", F.col("dim").cast("int")).alias("mean"), F.get("vec", (F.col("dim") + F.col("h")).cast("int")).alias("largest"))


@query("feature_concat", "SELECT vec_id AS uid, len(embedding) AS dims, CAST(embedding[41] AS DOUBLE) AS first, CAST(embedding[40] AS DOUBLE) AS last, list_sum(CAST(embedding AS DOUBLE[])) AS total FROM embeddings")
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").cast("array<double>").alias("v"))
    sites = e.select("uid", F.explode(F.array(F.struct(F.lit("proj").alias("site"), F.slice("v", 1, 40).alias("vec")), F.struct(F.lit("layer").alias("site"), F.slice("v", 41, 24).alias("vec")))).alias("s")).select("uid", "s.*")
    both = studies.load_features(sites, ["layer", "proj"])
    return both.select("uid", F.size("vec").cast("long").alias("dims"), F.get("vec", F.lit(0)).alias("first"), F.element_at("vec", -1).alias("last"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "dev").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"), "label", part.alias("split"))


def _tested(p: DataFrame) -> DataFrame:
    return readout.auroc(p.filter("split = 'test'").withColumnRenamed("p", "score"), ["class"])


@query("probe_fit", None)
def probe_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC on the test rows of a probe for each label, C of four chosen on the dev rows."""
    return _tested(readout.probe(_probe_rows(spark, sf_dir), list(range(LABELS))))


@query("shuffle_control", None)
def shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of each label's probe against 20 probes fitted on permuted labels."""
    return readout.shuffled_null(_probe_rows(spark, sf_dir), list(range(LABELS)), shuffles=20)


@query("platt", None)
def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    p = readout.platt(rows.filter("split = 'dev'"), rows.filter("split = 'test'"))
    return p.groupBy("class").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))


@query("em_prior", None)
def em_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of the test rows by EM from the training rows' rates, on probabilities calibrated on the dev rows."""
    rows = cells(spark, sf_dir)
    source = {r["class"]: float(r["rate"]) for r in rows.filter("split = 'train'").groupBy("class").agg(F.avg("y").alias("rate")).collect()}  # a row for each class
    p = readout.platt(rows.filter("split = 'dev'"), rows.filter("split = 'test'").join(ranks.small(spark.createDataFrame([(c,) for c in source], "class int")), "class"))
    return readout.shift_prior(p, source).groupBy("class").agg(F.max("prior").alias("prior"), F.avg("p_shifted").alias("mean_p"), F.count(F.lit(1)).alias("n"))


@query("bootstrap_auroc", None)
def bootstrap_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scores' AUROCs, over all cells and as the mean of the classes' (of those with five positives)."""
    sums = resampling.auroc_replicates(cells(spark, sf_dir), "uid", ["score", "other"], 2000)
    each = F.array(*[F.struct(F.lit(k).alias("form"), (F.col(f"{k}_score") - F.col(f"{k}_other")).alias("v")) for k in ("pooled", "macro")])
    return resampling.interval(sums.select("replicate", F.explode(each).alias("s")).select("replicate", "s.*"), F.col("v"), ("form",))


STRATA = ("easy_normal", "easy_abnormal", "intermediate", "hard_multi", "rare", "ambiguous")


@query("glmm_interaction", None)
def glmm_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right or wrong on condition, stratum (those that occur, against the first) and their interaction, with a random intercept for each report."""
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = scored(spark, sf_dir).select("uid", "k", "difficulty", one(F.col("correct")).alias("ok"))
    there = {r["difficulty"] for r in rows.select("difficulty").distinct().collect()}  # six at most
    strata = [s for s in STRATA if s in there][1:]
    at, is_ = (lambda k: F.col("k") == k), (lambda s: F.col("difficulty") == s)
    terms = {"base": F.lit(1)} | {CONDITIONS[k]: one(at(k)) for k in range(1, 5)} | {s: one(is_(s)) for s in strata} | {f"{CONDITIONS[k]}:{s}": one(at(k) & is_(s)) for k in range(1, 5) for s in strata}
    fitted = resampling.random_intercept(rows.select("uid", "ok", *[c.alias(f"t{i}") for i, c in enumerate(terms.values())]), [f"t{i}" for i in range(len(terms))], "ok")
    named = {f"t{i}": n for i, n in enumerate(terms)}
    return spark.createDataFrame([(named.get(t, t), b, e) for t, b, e in fitted], "term string, estimate double, std_error double")


# ---- A ladder of two sites' posteriors. ----

_SITES = {
    "posts": """SELECT uid, split, class, y, site, least(greatest((x + 1) / 2, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM (SELECT uid, split, class, y, 'score' AS site, score AS x FROM cells UNION ALL SELECT uid, split, class, y, 'other', other FROM cells)""",
    "rates": "SELECT site, class, greatest(avg(y) FILTER (WHERE split = 'train'), 1e-6::DOUBLE) AS src, avg(y) FILTER (WHERE split = 'dev') AS tgt FROM posts GROUP BY 1, 2",
    "shifted": "SELECT uid, site, class, p AS raw, (tgt / src * p) / greatest(tgt / src * p + (1 - tgt) / (1 - src) * (1 - p), 1e-12::DOUBLE) AS dev FROM posts JOIN rates USING (site, class) WHERE split = 'test'",
    "configs": """SELECT 'one site' AS config, uid, class, raw AS s FROM shifted WHERE site = 'score' UNION ALL SELECT 'one site, dev prior', uid, class, dev FROM shifted WHERE site = 'score'
      UNION ALL SELECT 'both sites', uid, class, avg(raw) FROM shifted GROUP BY 2, 3 UNION ALL SELECT 'both sites, dev prior', uid, class, avg(dev) FROM shifted GROUP BY 2, 3
      UNION ALL SELECT 'one site, dev cutoff', uid, class, raw FROM shifted WHERE site = 'score' UNION ALL SELECT 'both sites, dev cutoff', uid, class, avg(raw) FROM shifted GROUP BY 2, 3""",
    "devs": "SELECT 'one site, dev cutoff' AS config, uid, class, y, p AS s FROM posts WHERE split = 'dev' AND site = 'score' UNION ALL SELECT 'both sites, dev cutoff', uid, class, any_value(y), avg(p) FROM posts WHERE split = 'dev' GROUP BY 2, 3",
    "mass": "SELECT config, class, s, sum(n) OVER w AS k, sum(n * s) OVER w AS mass, sum(n * s) OVER (PARTITION BY config, class) AS total FROM (SELECT config, class, s, count(*) AS n FROM configs WHERE config NOT LIKE '%cutoff' GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY config, class ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "curve": "SELECT config, class, s, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY config, class) AS total, sum(n) OVER (PARTITION BY config, class) AS all_n FROM (SELECT config, class, s, count(*) AS n, sum(y) AS pos FROM devs GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY config, class ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "cuts": """SELECT config, class, s AS threshold FROM mass QUALIFY row_number() OVER (PARTITION BY config, class ORDER BY 2.0 * mass / (k + total) DESC, s DESC) = 1
      UNION ALL SELECT config, class, s FROM curve WHERE total > 0 AND total < all_n QUALIFY row_number() OVER (PARTITION BY config, class ORDER BY 2.0::DOUBLE * tp / (k + total) DESC, s DESC) = 1""",
    "names": "SELECT CAST(i - 1 AS INTEGER) AS class, list_extract(" + _lists(tx.FINDINGS) + ", CAST(i AS INTEGER)) AS name FROM (SELECT unnest(range(1, 11)) AS i)",
    "sets": """SELECT c.config, c.uid, coalesce(list(n.name) FILTER (WHERE c.s >= t.threshold), []) AS pred FROM configs c JOIN names n USING (class) LEFT JOIN cuts t USING (config, class) GROUP BY 1, 2""",
    "truths": "SELECT uid, coalesce(list(n.name) FILTER (WHERE y = 1), []) AS truth FROM cells JOIN names n USING (class) GROUP BY 1",
    "scored": f"SELECT config AS prompt_condition, '' AS difficulty, {_H('pred')} AS pred_h, {_H('truth')} AS truth_h FROM sets JOIN truths USING (uid)",
    "levels": _LEVELS,
}


def site_posteriors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posteriors of the test rows by two sites, and the dev rows' probabilities and labels."""
    p = lambda c: F.least(F.greatest((F.col(c) + 1) / 2, F.lit(1e-6)), F.lit(1 - 1e-6))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("site"), p(c).alias("p")) for c in ("score", "other")])).alias("s")
    rows = cells(spark, sf_dir).select("uid", "split", "class", "y", each).select("uid", "split", "class", "y", "s.*")
    of = {k: rows.filter(F.col("split") == k).drop("split") for k in ("train", "dev", "test")}
    return readout.site_posteriors(of["test"], of["train"], of["dev"], ["site", "class"]), of["dev"]


def ladder_configs(posteriors: DataFrame, dev: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """config, uid, class, score and called: of one site and of both sites' means, for each kind of posterior the cutoff of the best expected f1, and for the raw one the dev rows' best."""
    both = posteriors.groupBy("uid", "class").agg(*[F.avg(k).alias(k) for k in kinds])
    one = posteriors.filter("site = 'score'")
    each = lambda df, name: df.select("uid", "class", F.explode(F.array(*[F.struct(F.lit(f"{name}{note}").alias("config"), F.col(k).alias("score")) for k, note in kinds.items()])).alias("c")).select("uid", "class", "c.*")
    raw = lambda df, name, *more: df.select("uid", "class", F.lit(f"{name}, dev cutoff").alias("config"), F.col(more[0]).alias("score"), *more[1:])
    chosen = readout.decide(each(one, "one site").unionByName(each(both, "both sites")), ["config", "class"])
    told = raw(dev.filter("site = 'score'"), "one site", "p", "y").unionByName(raw(dev.groupBy("uid", "class").agg(F.avg("p").alias("p"), F.max("y").alias("y")), "both sites", "p", "y"))
    held = readout.decide(raw(one, "one site", "raw").unionByName(raw(both, "both sites", "raw")), ["config", "class"], told)
    return chosen.unionByName(held)


@query("site_ladder", sql(f"SELECT prompt_condition AS config, level, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM levels GROUP BY 1, 2", more=CELLS | _SITES))
def site_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at every level of the posteriors of one site and of two sites' means: as given, under the dev rows' prior, and with the dev rows' cutoffs."""
    rows = ladder_configs(*site_posteriors(spark, sf_dir), {"raw": "", "dev": ", dev prior"})
    name = F.element_at(F.array(*[F.lit(c) for c in tx.FINDINGS]), F.col("class") + 1)
    pred = rows.groupBy("config", "uid").agg(F.collect_set(F.when(F.col("called") == 1, name)).alias("pred"))  # a name for each class at most
    truth = cells(spark, sf_dir).filter("split = 'test'").groupBy("uid").agg(F.collect_set(F.when(F.col("y") == 1, name)).alias("truth"))
    return scoring.ladder(pred.join(truth, "uid"), sets.with_parents(F.col("truth")), sets.with_parents(F.col("pred")), ("config",))
