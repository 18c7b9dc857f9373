"""Queries of the study's further tables: agreement of labelers and judges, confidence levels, gates, ladders, manifests, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import sets
from ..operators import experiments, labeling, requests, responses, sampling, scoring, zones
from ..sources import studies
from . import derived
from .derived import _lists, quoted, sql, table
from .score_queries import _AB, _ACUTE, _F1, _H, _JUDGED, _P, _R, _VOTES, checked, counts, judged, key_k, scored, vote_counts
from .text_queries import PICKS, S, images, labelled, query, split

# ---- Labels and labelers. ----

_SPLIT = {
    "drawn": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('draw|' || doc_id), doc_id) AS place FROM documents",
    "left_over": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('dev|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM drawn WHERE place > 100",
    "parts": "SELECT doc_id AS uid, 'test' AS split FROM drawn WHERE place <= 100 UNION ALL SELECT doc_id, CASE WHEN place <= greatest(1, CAST(floor(0.18 * n) AS BIGINT)) THEN 'dev' ELSE 'train' END FROM left_over",
}


@query("prevalence_by_split", sql(f"""SELECT p.split, c.class, avg(CASE WHEN rank = 3 THEN 1.0 ELSE 0.0 END) AS positive, avg(CASE WHEN rank = 2 THEN 1.0 ELSE 0.0 END) AS uncertain, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS negative, avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END) AS unmentioned
  FROM parts p CROSS JOIN (SELECT unnest({_lists(tx.FINDINGS)}) AS class) c LEFT JOIN ranks r ON r.uid = p.uid AND r.src = 'report' AND r.class = c.class GROUP BY 1, 2""", "ranks", more=_SPLIT))
def prevalence_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split(spark, sf_dir).select(F.col("doc_id").alias("uid"), "split")
    return labeling.prevalence(labelled(spark, sf_dir).join(parts, "uid"), by=("split",))


@query("split_positive_rates", sql(f"""SELECT p.split, count(*) AS n, sum(len(t.pos)) * 1.0 / (count(*) * {len(tx.FINDINGS)}) AS rate FROM parts p JOIN truth t ON t.uid = p.uid AND t.src = 'report' GROUP BY 1""", "truth", more=_SPLIT))
def split_positive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of positive cells of the training, dev and test rows."""
    parts = split(spark, sf_dir).select(F.col("doc_id").alias("uid"), "split")
    rows = labelled(spark, sf_dir).join(parts, "uid")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.size("pos")) / (F.count(F.lit(1)) * len(tx.FINDINGS))).alias("rate"))


@query("positive_counts", sql("SELECT CAST(n_positive AS INTEGER) AS n_positive, count(*) AS n FROM strata GROUP BY 1", "strata"))
def positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy(F.size("pos").alias("n_positive")).agg(F.count(F.lit(1)).alias("n"))


@query("top_errors", sql("SELECT prompt_condition, CAST(place AS INTEGER) AS place, text, n FROM (SELECT prompt_condition, errors AS text, count(*) AS n, row_number() OVER (PARTITION BY prompt_condition ORDER BY count(*) DESC, errors) AS place FROM e GROUP BY 1, 2) WHERE place <= 3", "predictions", more={"e": "SELECT prompt_condition, array_to_string(errors, ';') AS errors FROM predictions"}))
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent error strings of each condition's answers ('' for valid ones)."""
    rows = checked(spark, sf_dir).withColumn("errors", F.array_join("errors", ";"))
    return experiments.top_texts(rows, ("prompt_condition",), "errors", most=3)


def two_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, a and b: positive sets from the report and from its impression alone."""
    rows = labelled(spark, sf_dir).select("uid", "impression", F.col("pos").alias("a"))
    return labeling.label_texts(rows, "impression").select("uid", "a", F.col("pos").alias("b"))


_TWO = {"two": "SELECT a.uid, a.pos AS a, b.pos AS b FROM truth a JOIN truth b ON b.uid = a.uid AND b.src = 'impression' WHERE a.src = 'report'"}
_KAPPA = f"""SELECT class, n, po AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END AS kappa FROM (SELECT class, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe
  FROM (SELECT c.class, CASE WHEN list_contains(a, c.class) THEN 1 ELSE 0 END AS x, CASE WHEN list_contains(b, c.class) THEN 1 ELSE 0 END AS y FROM two, (SELECT unnest({_lists(tx.FINDINGS)}) AS class) c) GROUP BY class)"""


@query("positive_agreement", sql(_KAPPA, "truth", more=_TWO))
def positive_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.positive_agreement(two_labelers(spark, sf_dir), "a", "b")


@query("agreement_summary", sql(f"SELECT k.mean_kappa, s.exact, s.precision, s.recall, s.f1 FROM (SELECT avg(kappa) AS mean_kappa FROM kappas) k, (SELECT avg(same) AS exact, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (SELECT CASE WHEN list_sort(a) = list_sort(b) THEN 1.0 ELSE 0.0 END AS same, {counts('b', 'a', tx.FINDINGS)} FROM two)) s", "truth", more=_TWO | {"kappas": _KAPPA}))
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.agreement_summary(two_labelers(spark, sf_dir), "a", "b")


# ---- Confidence of the reference: report, impression and findings as three labelers. ----

_STATE = lambda x: f"coalesce(CASE {x}.rank WHEN 3 THEN 'PRESENT' WHEN 2 THEN 'UNCERTAIN' END, 'ABSENT')"
_CONF = {
    "three": f"""SELECT r.uid, c.class, {_STATE('a')} AS x, {_STATE('b')} AS y, {_STATE('d')} AS z FROM reports r CROSS JOIN (SELECT unnest({_lists(tx.RELIABLE)}) AS class) c
      LEFT JOIN ranks a ON a.uid = r.uid AND a.class = c.class AND a.src = 'report' LEFT JOIN ranks b ON b.uid = r.uid AND b.class = c.class AND b.src = 'impression' LEFT JOIN ranks d ON d.uid = r.uid AND d.class = c.class AND d.src = 'findings'""",
    "voted": "SELECT uid, class, CAST(x = 'PRESENT' AS INTEGER) + CAST(y = 'PRESENT' AS INTEGER) + CAST(z = 'PRESENT' AS INTEGER) AS p, CAST(x = 'ABSENT' AS INTEGER) + CAST(y = 'ABSENT' AS INTEGER) + CAST(z = 'ABSENT' AS INTEGER) AS q FROM three",
    "sure": "SELECT uid, class, CASE WHEN p + q = 3 THEN CASE WHEN greatest(p, q) = 3 THEN 'HIGH' ELSE 'MEDIUM' END WHEN greatest(p, q) = p + q AND greatest(p, q) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM voted",
    "told": f"""SELECT s.prompt_condition, m.confidence, CASE WHEN list_contains(s.truth_h, m.class) AND list_contains(s.pred_h, m.class) THEN 1 ELSE 0 END AS tp, CASE WHEN NOT list_contains(s.truth_h, m.class) AND list_contains(s.pred_h, m.class) THEN 1 ELSE 0 END AS fp,
      CASE WHEN list_contains(s.truth_h, m.class) AND NOT list_contains(s.pred_h, m.class) THEN 1 ELSE 0 END AS fn FROM scored s JOIN sure m ON m.uid = s.uid""",
}


def three_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, class and confidence of every cell of the reliable classes."""
    rows = labelled(spark, sf_dir).select("uid", "impression", "findings", *[F.col(c).alias(f"a_{c}") for c in ("pos", "unc")])
    rows = labeling.label_texts(rows, "impression").select("uid", "findings", "a_pos", "a_unc", *[F.col(c).alias(f"b_{c}") for c in ("pos", "unc")])
    rows = labeling.label_texts(rows, "findings")
    state = lambda p, c: F.when(F.array_contains(f"{p}pos", c), 1).when(F.array_contains(f"{p}unc", c), -1).otherwise(0)
    each = F.array(*[F.struct(F.lit(c).alias("class"), state("a_", c).alias("x"), state("b_", c).alias("y"), state("", c).alias("z")) for c in tx.RELIABLE])
    return labeling.with_confidence(rows.select("uid", F.explode(each).alias("c")).select("uid", "c.*"), ["x", "y", "z"]).select("uid", "class", "confidence")


@query("f1_by_level", sql(f"SELECT prompt_condition, level, cumulative, {_F1} AS f1, CAST(sum(tp + fp + fn) AS BIGINT) AS n_cells FROM (SELECT *, confidence AS level, false AS cumulative FROM told UNION ALL SELECT t.*, l.level, true FROM told t JOIN (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2)) l(level, o) ON l.o <= CASE t.confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) GROUP BY 1, 2, 3 HAVING sum(tp + fp + fn) > 0", "scored", more=_CONF))
def f1_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro f1 over the cells at each level of confidence, and at each level or above."""
    rows = scoring.masked_counts(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), three_labelers(spark, sf_dir), ("prompt_condition",), tx.RELIABLE)
    per = rows.groupBy("prompt_condition", "confidence").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    total = per.withColumn("l", F.explode(labeling.level_rows(F.col("confidence")))).groupBy("prompt_condition", "l.level", "l.cumulative").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return total.select("prompt_condition", "level", "cumulative", sets.prf("tp", "fp", "fn")[2], (F.col("tp") + F.col("fp") + F.col("fn")).alias("n_cells"))


# ---- Policies for uncertain cells. ----

_POLICY = {"pol": f"SELECT *, {_H('t_ignore')} AS zero_h, {_H('unc')} AS unc_h FROM scored"}
_OF = {"ones": ("truth_h", "pred_h"), "zeros": ("zero_h", "pred_h"), "ignore": ("list_filter(zero_h, lambda c: NOT list_contains(unc_h, c))", "list_filter(pred_h, lambda c: NOT list_contains(unc_h, c))")}
_LEVELS = {"all": tx.FINDINGS, "reliable": tx.RELIABLE}
_SPREAD = "SELECT level, prompt_condition, f1_ones, f1_zeros, f1_ignore, greatest(f1_ones, f1_zeros, f1_ignore) - least(f1_ones, f1_zeros, f1_ignore) AS spread FROM (" + "SELECT level, prompt_condition, " + ", ".join(f"max(f1) FILTER (WHERE policy = '{p}') AS f1_{p}" for p in _OF) + " FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS level, prompt_condition, '{p}' AS policy, {_F1} AS f1 FROM (SELECT prompt_condition, {counts(t, q, c)} FROM pol) GROUP BY 2" for n, c in _LEVELS.items() for p, (t, q) in _OF.items()) + ") GROUP BY 1, 2)"


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, unc = sets.with_parents(F.col("t_ignore")), sets.with_parents(F.col("unc"))
    variants = {"ones": (F.col("truth_h"), F.col("pred_h")), "zeros": (zero, F.col("pred_h")), "ignore": (F.array_except(zero, unc), F.array_except("pred_h", unc))}
    return scoring.policy_spread(scored(spark, sf_dir), variants, _LEVELS)


@query("policy_spread", sql(_SPREAD, "scored", more=_POLICY))
def policy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads(spark, sf_dir)


@query("policy_ranks", sql("SELECT *, rank_ones = rank_zeros AND rank_ones = rank_ignore AS stable FROM (SELECT level, " + ", ".join(f"string_agg(prompt_condition, ' > ' ORDER BY f1_{p} DESC, prompt_condition) AS rank_{p}" for p in _OF) + " FROM spreads GROUP BY level)", "scored", more=_POLICY | {"spreads": _SPREAD}))
def policy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.policy_ranks(spreads(spark, sf_dir), list(_OF))


@query("uncertain_share", sql(f"SELECT CAST(sum(len(unc)) AS BIGINT) AS n_uncertain, sum(len(unc)) * 1.0 / (count(*) * {len(tx.FINDINGS)}) AS share FROM truth WHERE src = 'report'", "truth"))
def uncertain_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.uncertain_share(labelled(spark, sf_dir))


# ---- Votes, arms, ladders and gates. ----

_KEPT = _lists([c for c in tx.FINDINGS if c not in tx.JUNK])
_SWEEP = lambda where: f"SELECT k, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (SELECT g.k, CASE WHEN v.votes >= g.k AND list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS tp, CASE WHEN v.votes >= g.k AND NOT list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS fp, CASE WHEN v.votes < g.k AND list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS fn FROM votes v JOIN truth t ON t.uid = v.uid AND t.src = 'impression', (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS k) g WHERE {where}) GROUP BY k"


@query("vote_best", sql(f"SELECT 'all' AS classes, k, precision, recall, f1 FROM best UNION ALL SELECT 'kept', s.k, s.precision, s.recall, s.f1 FROM ({_SWEEP(f'list_contains({_KEPT}, v.class)')}) s JOIN best USING (k)", "answers", "truth", more=_VOTES | {"best": f"SELECT * FROM ({_SWEEP('TRUE')}) ORDER BY f1 DESC, k LIMIT 1"}))
def vote_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best number of votes, with all classes and without those of least agreement."""
    truth = labelled(spark, sf_dir, "impression").select("uid", sets.truth_set(F.col("pos"), F.col("unc")).alias("truth"))
    return experiments.vote_best_of(vote_counts(spark, sf_dir), truth, "uid", 5, tx.JUNK)


_VALID = "len(errors) = 0"
_BPRF = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN sum(btp) * 1.0 / ({a} + {b}) ELSE 0.0 END"
_RUNGS = f"""SELECT prompt_condition, count(*) AS n, quantile_cont(prompt_tokens, 0.5) AS median_tokens, {_P} AS precision, {_R} AS recall, {_F1} AS f1, avg(CASE WHEN ta = pa THEN 1.0 ELSE 0.0 END) AS binary_accuracy, {_BPRF('sum(btp)', 'sum(bfp)')} AS binary_precision, {_BPRF('sum(btp)', 'sum(bfn)')} AS binary_recall,
  CASE WHEN 2 * sum(btp) + sum(bfp) + sum(bfn) > 0 THEN 2.0 * sum(btp) / (2 * sum(btp) + sum(bfp) + sum(bfn)) ELSE 0.0 END AS binary_f1, avg(len(pred_h)) AS findings_per_study, sum(fp) * 1.0 / count(*) AS fp_per_study, sum(fn) * 1.0 / count(*) AS fn_per_study, avg(CASE WHEN pa THEN 1.0 ELSE 0.0 END) AS abnormal, avg(CASE WHEN {_VALID} THEN 1.0 ELSE 0.0 END) AS schema_valid
  FROM (SELECT *, CASE WHEN ta AND pa THEN 1 ELSE 0 END AS btp, CASE WHEN pa AND NOT ta THEN 1 ELSE 0 END AS bfp, CASE WHEN ta AND NOT pa THEN 1 ELSE 0 END AS bfn FROM (SELECT *, {_ACUTE('truth_h')} AS ta, {_ACUTE('pred_h')} AS pa, {counts('truth_h', 'pred_h', tx.FINDINGS)} FROM scored)) GROUP BY 1"""


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.size(responses.schema_errors(F.col("json"))) == 0
    return experiments.rung_scores(scored(spark, sf_dir), "prompt_condition", F.col("truth_h"), F.col("pred_h"), valid=valid)


@query("rung_scores", sql(_RUNGS, "scored"))
def rung_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rungs(spark, sf_dir)


@query("information_span", sql("SELECT a.f1 - b.f1 AS span_f1, a.binary_accuracy - b.binary_accuracy AS span_binary_accuracy FROM rungs a, rungs b WHERE a.prompt_condition = 'direct' AND b.prompt_condition = 'ddx'", "scored", more={"rungs": _RUNGS}))
def information_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.span(rungs(spark, sf_dir), "prompt_condition", "direct", "ddx")


@query("arm_validity", sql(f"SELECT prompt_condition, count(*) AS n, avg(CASE WHEN {_VALID} THEN 1.0 ELSE 0.0 END) AS valid, CAST(sum(CASE WHEN api_error <> '' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM predictions GROUP BY 1", "predictions"))
def arm_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(spark, sf_dir).withColumn("valid", F.when(F.size("errors") == 0, 1.0).otherwise(0.0))
    return rows.groupBy("prompt_condition").agg(F.count(F.lit(1)).alias("n"), F.avg("valid").alias("valid"), F.sum(F.when(F.col("api_error") != "", 1).otherwise(0)).alias("errors"))


@query("samples_health", sql(f"SELECT count(*) AS n, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_valid, avg(v) AS mean_valid FROM (SELECT uid, sum(CASE WHEN {_VALID} AND uid % 3 <> 0 THEN 1 ELSE 0 END) AS v FROM predictions GROUP BY uid)", "predictions"))
def samples_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies, those without a valid sample, and valid samples a study; samples of every third study count as failed."""
    valid = (F.size("errors") == 0) & (F.col("uid") % 3 != 0)
    rows = checked(spark, sf_dir).groupBy("uid").agg(F.sum(F.when(valid, 1).otherwise(0)).alias("v"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("without_valid"), F.avg("v").alias("mean_valid"))


_GATE = lambda name, value, least: f"SELECT '{name}' AS gate, {value} AS value, coalesce({value} >= {least}, false) AS passed FROM g"
_ONE = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
_G = {
    "stage": f"SELECT uid, k, n_image_parts, prompt_tokens, CASE WHEN uid % 20 = 1 THEN primary_diagnosis ELSE 'Deferred ' END AS dx, CASE WHEN form = 1 THEN '{{\"x\": 1}}' WHEN form = 2 THEN '' ELSE 'none' END AS findings, {_VALID} AS valid FROM predictions",
    "g": "SELECT a.uid, a.n_image_parts AS sent, r.parts AS rendered, a.prompt_tokens AS tokens, c.prompt_tokens AS tokens_0, upper(trim(a.dx)) AS dx, a.valid AS va, b.valid AS vb, b.findings, CASE WHEN b.uid % 50 = 0 THEN 1 ELSE 0 END AS sent_b FROM stage a JOIN stage b ON b.uid = a.uid AND b.k = 1 JOIN stage c ON c.uid = a.uid AND c.k = 2 LEFT JOIN (SELECT conv_id, count(*) AS parts FROM conversations GROUP BY 1) r ON r.conv_id = a.uid WHERE a.k = 0",
}


@query("arm_gates", sql(" UNION ALL ".join((_GATE("parts", "avg(CASE WHEN rendered IS NOT NULL THEN CASE WHEN sent = rendered THEN 1.0 ELSE 0.0 END END)", 1.0), _GATE("tokens", _ONE("tokens > 0"), 1e-12), _GATE("deferred", _ONE("dx = 'DEFERRED'"), 0.9), _GATE("findings", _ONE("findings NOT IN ('', '{}', 'nan')"), 0.9), _GATE("text_only", _ONE("sent_b = 0"), 1.0), _GATE("valid_a", _ONE("va"), 0.9), _GATE("valid_b", _ONE("vb"), 0.9), _GATE("payload", _ONE("tokens > tokens_0"), 0.9))), "predictions", more=_G))
def arm_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a two-stage arm: the first two answers of each report as its stages, the third as the baseline, the turns of conversations as rendered parts."""
    rows = checked(spark, sf_dir).withColumn("valid", F.size("errors") == 0)
    form = (F.col("uid") + F.col("k")) % 5
    a = rows.filter("k = 0").select("uid", "n_image_parts", "prompt_tokens", F.when(F.col("uid") % 20 == 1, F.col("primary_diagnosis")).otherwise("Deferred ").alias("primary_diagnosis"), "valid")
    b = rows.filter("k = 1").select("uid", F.when(F.col("uid") % 50 == 0, 1).otherwise(0).alias("n_image_parts"), F.when(form == 1, '{"x": 1}').when(form == 2, "").otherwise("none").alias("stage_a_findings"), "valid")
    rendered = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("uid")).agg(F.count(F.lit(1)).alias("parts"))
    return experiments.arm_gates(a, b, rendered, rows.filter("k = 2").select("uid", "prompt_tokens"))


_ZONED = "CASE WHEN r.mesh LIKE 'Consolidation/lung/base%' OR r.mesh LIKE 'Opacity/lung/apex%' OR r.mesh LIKE 'Density/%' THEN true ELSE false END"
_DID = lambda n, g: f"CAST(sum(CASE WHEN z = {g} THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}, avg(x) FILTER (WHERE z = {g}) AS before_{n}, avg(y) FILTER (WHERE z = {g}) AS after_{n}, avg(y - x) FILTER (WHERE z = {g}) AS delta_{n}, quantile_cont(tk, 0.5) FILTER (WHERE z = {g}) AS tokens_{n}"


@query("did_by_group", sql(f"SELECT *, delta_in - delta_out AS did FROM (SELECT {_DID('in', 'true')}, {_DID('out', 'false')} FROM (SELECT {_ZONED} AS z, CASE WHEN ok_a THEN 1.0 ELSE 0.0 END AS x, CASE WHEN ok_b THEN 1.0 ELSE 0.0 END AS y, p.prompt_tokens AS tk FROM ab JOIN reports r ON r.uid = ab.uid JOIN predictions p ON p.uid = ab.uid AND p.k = 1))", "scored", more=_AB))
def did_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: F.max(F.when(F.col("k") == k, F.when(F.col("correct"), 1).otherwise(0)))
    rows = scored(spark, sf_dir).filter("k < 2").groupBy("uid").agg(one(0).alias("x"), one(1).alias("y"), F.max(F.when(F.col("k") == 1, F.col("prompt_tokens"))).alias("tk"))
    rows = rows.join(derived.reports(spark, sf_dir).select("uid", zones.tag_zone(F.col("mesh")).isNotNull().alias("z")), "uid")
    return experiments.difference_in_differences(rows, F.col("z"), F.col("x"), F.col("y"), F.col("tk"))


_EX = {"x": "SELECT s.pred_h, s.truth_h, t.t_ones AS e FROM scored s JOIN truth t ON t.uid = s.uid AND t.src = 'report' WHERE s.k = 0"}


@query("expert_scores", sql(" UNION ALL ".join(f"SELECT '{n}' AS level, '{r}' AS reference, count(*) AS n, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (SELECT {counts(t, 'pred_h', c)} FROM x)" for n, c in _LEVELS.items() for r, t in (("expert", "e"), ("report", "truth_h"))), "scored", more=_EX))
def expert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the first answers against an expert (here: the whole report) and against the reference (its impression)."""
    expert = labelled(spark, sf_dir).select("uid", sets.truth_set(F.col("pos"), F.col("unc"), "ones").alias("e"))
    return experiments.expert_scores(scored(spark, sf_dir).filter("k = 0").join(expert, "uid"), F.col("pred_h"), {"expert": F.col("e"), "report": F.col("truth_h")}, _LEVELS)


# ---- Audits of outputs. ----

_TOP = "SELECT {0}, CAST(place AS INTEGER) AS place, text, n FROM (SELECT {0}, coalesce(text, '') AS text, count(*) AS n, row_number() OVER (PARTITION BY {0} ORDER BY count(*) DESC, coalesce(text, '')) AS place FROM {1} GROUP BY 1, 2) WHERE place <= 5"


@query("top_outputs", _TOP.format("role", "conversations"))
def top_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.top_texts(table(spark, sf_dir, "conversations"), ("role",), "text")


@query("answer_patterns", sql(f"SELECT prompt_condition, count(*) AS n, count(DISTINCT {S('pred')}) AS patterns, sum(len(pred)) * 1.0 / (count(*) * {len(tx.FINDINGS)}) AS yes_rate FROM (SELECT prompt_condition, list_filter(pred, lambda c: list_contains({_lists(tx.FINDINGS)}, c)) AS pred FROM answers) GROUP BY 1", "answers"))
def answer_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.answer_patterns(responses.predicted(derived.predictions(spark, sf_dir)), ("prompt_condition",))


@query("constant_scores", "SELECT label, count(*) AS dims, avg(sd) AS sd, avg(sd) <= 1e-6 AS constant FROM (SELECT label, dim, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def constant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deviation of the features between the rows of a label: none means that a probe on them would mean nothing."""
    return experiments.spread_of_dimensions(table(spark, sf_dir, "embeddings"), ("label",), "embedding")


_JUDGES = {"judged_by": "SELECT l_orderkey AS uid, l_linenumber AS line, l_linestatus AS cond, max(CAST(floor(l_quantity) AS INTEGER) % 5 + 1) AS x, max(CAST(floor(l_extendedprice) AS INTEGER) % 5 + 1) AS y FROM lineitem GROUP BY 1, 2, 3"}


@query("judge_kappa", sql("""SELECT p.cond, n, same * 1.0 / n AS agreement, CASE WHEN e / (n * n) < 1 THEN (same * 1.0 / n - e / (n * n)) / (1 - e / (n * n)) ELSE 1.0 END AS kappa, far_apart FROM (SELECT cond, count(*) AS n, CAST(sum(CASE WHEN x = y THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN abs(x - y) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS far_apart FROM judged_by GROUP BY 1) p
  JOIN (SELECT a.cond, sum(a.c * b.c * 1.0::DOUBLE) AS e FROM (SELECT cond, x AS s, count(*) AS c FROM judged_by GROUP BY 1, 2) a JOIN (SELECT cond, y AS s, count(*) AS c FROM judged_by GROUP BY 1, 2) b ON a.cond = b.cond AND a.s = b.s GROUP BY 1) q ON p.cond = q.cond""", more=_JUDGES))
def judge_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two judges, joined over the lines that both scored."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("cond"), F.explode(F.array(F.struct(F.lit("j1").alias("judge_id"), (F.floor("l_quantity") % 5 + 1).alias("score")), F.struct(F.lit("j2").alias("judge_id"), (F.floor("l_extendedprice") % 5 + 1).alias("score")))).alias("j")).select("uid", "line", "cond", "j.*")
    return experiments.judge_agreement(rows, ["uid", "line", "cond"], ("j1", "j2"), ("cond",))


@query("judge_table", sql("SELECT p.uid, p.k, coalesce(j.n_claims, 0) AS n_claims, coalesce(j.supported, 0) AS supported, coalesce(j.contradicted, 0) AS contradicted FROM predictions p LEFT JOIN (SELECT * FROM judged WHERE uid % 7 <> 0) j ON j.uid = p.uid AND j.k = p.k", "predictions", "ranks", more=_JUDGED))
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with its groundedness; every seventh report has none."""
    columns = ["n_claims", "supported", "contradicted"]
    ground = judged(spark, sf_dir).filter("uid % 7 <> 0").select("uid", "k", *[F.col(c).cast("long").alias(c) for c in columns])
    return requests.judge_table(derived.predictions(spark, sf_dir).select("uid", "k"), ground, ["uid", "k"], columns).select("uid", key_k(), *columns)


# ---- Prompts, samples, manifests. ----

_LINE = lambda c: f"CASE WHEN list_contains(pos, {quoted(c)}) THEN {quoted(f'- {c}: PRESENT (evidence: ')} || e || ')' WHEN list_contains(unc, {quoted(c)}) THEN {quoted(f'- {c}: UNCERTAIN')} WHEN list_contains(neg, {quoted(c)}) THEN {quoted(f'- {c}: ABSENT')} ELSE {quoted(f'- {c}: not assessed')} END"
_LINES = " || chr(10) || ".join(_LINE(c) for c in tx.FINDINGS)


@query("stage_b_evidence", sql(f"SELECT uid, md5({_LINES}) AS prompt_hash, length({_LINES}) AS chars FROM (SELECT t.*, trim(r.findings) AS e FROM truth t JOIN reports r ON r.uid = t.uid WHERE t.src = 'report')", "truth"))
def stage_b_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stage's text with the evidence of present findings (here: the report's own findings)."""
    rows = labelled(spark, sf_dir).withColumn("e", F.map_from_arrays("pos", F.transform("pos", lambda c: F.col("findings"))))
    said = requests.evidence_text(F.col("pos"), F.col("unc"), F.col("neg"), F.col("e"))
    return rows.select("uid", F.md5(said).alias("prompt_hash"), F.length(said).cast("long").alias("chars"))


@query("disputed_sample", sql("SELECT uid, class FROM picked UNION ALL SELECT uid, NULL FROM (SELECT uid, row_number() OVER (ORDER BY md5('disputed more|' || uid), uid) AS place FROM over_all WHERE len(over_called) > 0 AND uid NOT IN (SELECT uid FROM picked)) WHERE place <= 70 - (SELECT count(*) FROM picked)", "scored", more=PICKS))
def disputed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen studies of each often disputed class, topped up to 70 with other disputed ones."""
    rows = scored(spark, sf_dir).filter("k = 0").select("uid", F.array_except("pred_h", "truth_h").alias("disputed"))
    return sampling.topped_up(rows, "disputed", tx.OFTEN_DISPUTED, 15, 70, seed="disputed")


@query("blinded_manifest", sql("""SELECT md5('blind|' || r.uid) AS study, r.indication, CASE WHEN f > 0 THEN substr(md5('blind|' || r.uid), 1, 12) || '_f.png' ELSE '' END AS frontal, CASE WHEN l > 0 THEN substr(md5('blind|' || r.uid), 1, 12) || '_l.png' ELSE '' END AS lateral
  FROM reports r JOIN (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS f, count(*) FILTER (WHERE turn % 2 <> 0) AS l FROM conversations GROUP BY 1) c ON c.conv_id = r.uid""", "reports"))
def blinded_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.blinded_manifest(studies.build_studies(derived.reports(spark, sf_dir), images(spark, sf_dir)), "blind")


_BAND = lambda t: f"(CASE {t} % 4 WHEN 0 THEN '' WHEN 1 THEN 'upper/right' WHEN 2 THEN 'mid/left' ELSE 'lower/right' END)"
_SAY = lambda z: f"CASE {z} WHEN '' THEN '' WHEN 'upper/right' THEN '^ Right upper zone (patient right), higher resolution.' WHEN 'mid/left' THEN '^ Left mid zone (patient left), higher resolution.' ELSE '^ Right lower zone (patient right), higher resolution.' END"


@query("manifest_captions", f"""SELECT conv_id AS uid, coalesce(string_agg('p' || turn, '|' ORDER BY turn) FILTER (WHERE turn % 3 <> 2), '') AS frontal, coalesce(string_agg({_SAY(_BAND('turn'))}, '|' ORDER BY turn) FILTER (WHERE turn % 3 <> 2), '') AS captions, coalesce(string_agg('p' || turn, '|' ORDER BY turn) FILTER (WHERE turn % 3 = 2), '') AS lateral FROM conversations GROUP BY 1""")
def manifest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontal views with the captions of their crops, and lateral views, of each study."""
    t = F.col("turn")
    zone = F.when(t % 4 == 0, "").when(t % 4 == 1, "upper/right").when(t % 4 == 2, "mid/left").otherwise("lower/right")
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uid"), t.alias("part_idx"), F.when(t % 3 == 2, "lateral").otherwise("frontal").alias("kind"), F.concat(F.lit("p"), t.cast("string")).alias("path"), zone.alias("zone"))
    return zones.load_manifest(parts).select("uid", *[F.array_join(c, "|").alias(c) for c in ("frontal", "captions", "lateral")])
