"""Queries on answers: parsing, predicted sets, scores, groundedness, calibration, votes, comparisons of arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import sets, text
from ..operators import experiments, labeling, responses, scoring
from . import derived
from .derived import _lists, quoted, sql, table
from .text_queries import S, labelled, query  # noqa: F401  one registry

CHILDREN = _lists(tx.CHILDREN)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.predicted(derived.predictions(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed, with what the contract finds wrong with them."""
    return responses.parse(derived.predictions(spark, sf_dir)).withColumn("errors", responses.schema_errors(F.col("json")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with predicted sets, the impression's labels, truth sets under both policies, and the report's stratum."""
    report = labeling.stratify(labelled(spark, sf_dir)).select("uid", "impression", "difficulty")
    truth = labeling.label_texts(report, "impression").select("uid", "difficulty", "pos", "unc", "neg", "no_finding")
    rows = answers(spark, sf_dir).join(truth, "uid")
    rows = rows.withColumns({"t_ignore": sets.truth_set(F.col("pos"), F.col("unc")), "t_ones": sets.truth_set(F.col("pos"), F.col("unc"), "ones")})
    return rows.withColumns({"correct": sets.is_correct(F.col("pred"), F.col("t_ignore")), "pred_h": sets.with_parents(F.col("pred")), "truth_h": sets.with_parents(F.col("t_ones"))})


def key_k():
    return F.col("k").cast("long").alias("k")
_F1 = "CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END"
_P = "CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) * 1.0 / (sum(tp) + sum(fp)) ELSE 0.0 END"
_R = "CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) * 1.0 / (sum(tp) + sum(fn)) ELSE 0.0 END"


def counts(truth: str, pred: str, classes) -> str:
    """SELECT items tp, fp and fn of two list columns."""
    c = _lists(classes)
    t, p = f"list_filter({truth}, lambda c: list_contains({c}, c))", f"list_filter({pred}, lambda c: list_contains({c}, c))"
    tp = f"len(list_intersect({t}, {p}))"
    return f"{tp} AS tp, len({p}) - {tp} AS fp, len({t}) - {tp} AS fn"


@query("parse_responses", sql("SELECT uid, k, NOT (form = 4 AND uid % 2 = 1) AS parsed, CASE WHEN (form = 4 AND uid % 2 = 1) OR (form = 0 AND uid % 13 = 6) THEN NULL ELSE primary_diagnosis END AS dx, CASE WHEN form = 4 AND uid % 2 = 1 THEN NULL ELSE confidence END AS confidence FROM predictions", "predictions"))
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    return rows.select("uid", key_k(), F.col("json").isNotNull().alias("parsed"), F.col("answer.primary_diagnosis").alias("dx"), F.col("answer.confidence").try_cast("double").cast("int").alias("confidence"))


@query("mend_truncated", sql("SELECT uid, k, mended, CASE WHEN mended AND NOT (form = 0 AND uid % 13 = 6) THEN primary_diagnosis END AS dx FROM (SELECT *, CASE WHEN form = 4 THEN uid % 2 = 0 ELSE uid % 7 <> 5 END AS mended FROM predictions)", "predictions"))
def mend_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut off before their last characters still give their diagnosis, however long they are; what holds no object, or has prose before a cut one, gives none."""
    longer = F.when(F.col("uid") % 97 == 0, F.replace("response", F.lit('{"primary'), F.lit('{"filler": "' + "x" * 30_000 + '", "primary'))).otherwise(F.col("response"))
    rows = responses.parse(derived.predictions(spark, sf_dir).withColumn("response", longer).withColumn("response", F.expr("concat(CASE WHEN uid % 7 = 5 THEN 'Sure: ' ELSE '' END, substring(response, 1, length(response) - 2))")))
    return rows.select("uid", key_k(), F.col("json").isNotNull().alias("mended"), F.col("answer.primary_diagnosis").alias("dx"))


@query("validate_responses", sql("SELECT uid, k, array_to_string(errors, ';') AS errors FROM predictions", "predictions"))
def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("uid", key_k(), F.array_join("errors", ";").alias("errors"))


_SYN = "CASE {0} WHEN 'possible' THEN 'uncertain' WHEN 'yes' THEN 'present' ELSE lower({0}) END"


@query("coerce_responses", sql(f"SELECT uid, k, CASE WHEN NOT (form = 4 AND uid % 2 = 1) THEN CAST(least(100, greatest(0, round_even(confidence * 1.5 - 20.5, 0))) AS INTEGER) END AS confidence, CASE WHEN form = 1 THEN {_SYN.format('s1')} END AS presence FROM predictions", "predictions"))
def coerce_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    given = F.col("answer").withField("confidence", (F.col("confidence") * 1.5 - 20.5).cast("string"))
    rows = rows.withColumn("coerced", F.when(F.col("answer").isNotNull(), responses.coerced(given)))
    first = F.get(F.map_values("coerced.findings"), F.lit(0))["presence"]
    return rows.select("uid", key_k(), F.col("coerced.confidence").cast("int").alias("confidence"), first.alias("presence"))


@query("predicted_sets", sql(f"SELECT uid, k, {S('pred')} AS classes FROM answers", "answers"))
def predicted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("uid", key_k(), sets.joined(F.col("pred")).alias("classes"))


@query("differential_sets", sql(f"SELECT uid, k, {S('coalesce(listed, pred)')} AS classes FROM answers", "answers"))
def differential_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted sets with the differential's likely candidates, whose probabilities may be quoted."""
    return responses.predicted(derived.predictions(spark, sf_dir), use_differential=True).select("uid", key_k(), sets.joined(F.col("pred")).alias("classes"))


@query("structured_sets", sql(f"SELECT uid, k, CASE WHEN form = 1 THEN {S('pred')} ELSE '' END AS classes FROM answers", "answers"))
def structured_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parse(derived.predictions(spark, sf_dir)).select("uid", key_k(), sets.joined(responses.structured_set(F.col("answer.findings"))).alias("classes"))


@query("fullresp_set", sql(f"SELECT a.uid, a.k, {S('''list_filter(list_distinct(list_concat(a.dx_classes, CASE WHEN a.form = 4 AND a.uid % 2 = 1 THEN [] ELSE n.classes END)), lambda c: c <> 'No Finding')''')} AS classes FROM answers a JOIN norm n ON n.text = a.said", "answers"))
def fullresp_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    return rows.select("uid", key_k(), sets.joined(scoring.full_response_set(F.col("answer"), F.col("primary_diagnosis"))).alias("classes"))


@query("truth_sets", sql(f"SELECT uid, {S('t_ignore')} AS t_ignore, {S('t_ones')} AS t_ones FROM truth WHERE src = 'impression'", "truth"))
def truth_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir, "impression")
    return rows.select("uid", sets.joined(sets.truth_set(F.col("pos"), F.col("unc"))).alias("t_ignore"), sets.joined(sets.truth_set(F.col("pos"), F.col("unc"), "ones")).alias("t_ones"))


@query("hierarchy_sets", sql(f"SELECT uid, {S(f'''CASE WHEN list_has_any(t_ones, {CHILDREN}) THEN list_distinct(list_append(t_ones, 'Lung Opacity')) ELSE t_ones END''')} AS classes FROM truth WHERE src = 'report'", "truth"))
def hierarchy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("uid", sets.joined(sets.with_parents(sets.truth_set(F.col("pos"), F.col("unc"), "ones"))).alias("classes"))


_GROUP = lambda c: "list_filter([" + ", ".join(f"CASE WHEN list_has_any({c}, {_lists(v)}) THEN {quoted(k)} END" for k, v in tx.GROUPS.items()) + "], lambda g: g IS NOT NULL)"
_ACUTE = lambda c: f"len(list_filter({c}, lambda x: x NOT IN ('Support Devices', 'No Finding'))) > 0"


@query("group_sets", sql(f"SELECT uid, {S(_GROUP('t_ones'))} AS groups, {_ACUTE('t_ones')} AS acute FROM truth WHERE src = 'report'", "truth"))
def group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sets.truth_set(F.col("pos"), F.col("unc"), "ones")
    return labelled(spark, sf_dir).select("uid", sets.joined(sets.to_groups(t)).alias("groups"), sets.any_acute(t).alias("acute"))


_CELL3 = {"cells3": "SELECT l_orderkey AS uid, l_linenumber AS class, max(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN -1 ELSE 0 END) AS a, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS c FROM lineitem GROUP BY 1, 2"}


def cells3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelers' states of the cells (order, line) of lineitem."""
    one = lambda c: F.when(c, 1).otherwise(0)
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("class")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)).alias("a"), F.max(one(F.col("l_linestatus") == "F")).alias("b"), F.max(one(F.col("l_quantity") > 25)).alias("c"))


@query("maj3_reference", sql("SELECT class, count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN a <> 0 THEN 1 ELSE 0 END) + b + c >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM cells3 GROUP BY class", more=_CELL3))
def maj3_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.when(F.col("a") != 0, 1).otherwise(0) + F.col("b") + F.col("c")
    return cells3(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(votes >= 2, 1).otherwise(0)).alias("positive"))


_LEVEL = """SELECT *, CASE WHEN pos + neg = 3 THEN CASE WHEN pos >= neg THEN 'PRESENT' ELSE 'ABSENT' END ELSE CASE WHEN pos > neg THEN 'PRESENT' WHEN neg > pos THEN 'ABSENT' ELSE 'UNCERTAIN' END END AS consensus,
  greatest(pos, neg) || '/3' AS agreement, CASE WHEN pos + neg = 3 THEN CASE WHEN greatest(pos, neg) = 3 THEN 'HIGH' ELSE 'MEDIUM' END WHEN greatest(pos, neg) = pos + neg AND greatest(pos, neg) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM (SELECT *, CASE WHEN a = 1 THEN 1 ELSE 0 END + b + c AS pos, CASE WHEN a = 0 THEN 1 ELSE 0 END + 2 - b - c AS neg FROM cells3)"""


@query("reference_confidence", sql("SELECT class, consensus, agreement, confidence, count(*) AS n FROM levels GROUP BY ALL", more=_CELL3 | {"levels": _LEVEL}))
def reference_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.with_confidence(cells3(spark, sf_dir), ["a", "b", "c"]).groupBy("class", "consensus", "agreement", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("top1_accuracy", sql("SELECT prompt_condition, count(*) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored GROUP BY 1", "scored"))
def top1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.col("correct"), 1).otherwise(0)
    return scored(spark, sf_dir).groupBy("prompt_condition").agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("n_correct"), F.avg(one).alias("accuracy"))


@query("accuracy_by_difficulty", sql("SELECT prompt_condition, difficulty, count(*) AS n, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored GROUP BY ROLLUP (prompt_condition, difficulty)", "scored"))
def accuracy_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).rollup("prompt_condition", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"))


@query("strict_top1", sql("SELECT prompt_condition, avg(CASE WHEN list_has_any(pred_h, truth_h) THEN 1.0 ELSE 0.0 END) AS top1_strict FROM scored GROUP BY 1", "scored"))
def strict_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("prompt_condition").agg(F.avg(F.when(F.arrays_overlap("pred_h", "truth_h"), 1.0).otherwise(0.0)).alias("top1_strict"))


_BY_CLASS = f"""SELECT prompt_condition, c.class, CAST(sum(CASE WHEN t AND p THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT t AND p THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM (SELECT prompt_condition, c.class, list_contains(truth_h, c.class) AS t, list_contains(pred_h, c.class) AS p FROM scored, (SELECT unnest({_lists(tx.FINDINGS)}) AS class) c) c GROUP BY 1, 2"""
_MACRO = f"""SELECT prompt_condition, {_P} AS micro_precision, {_R} AS micro_recall, {_F1} AS micro_f1,
  avg(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END) AS macro_precision, avg(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END) AS macro_recall, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS macro_f1,
  CAST(sum(tp + fp + fn) AS BIGINT) AS n_cells FROM by_class GROUP BY 1"""


@query("prf_micro_macro", sql(_MACRO, "scored", more={"by_class": _BY_CLASS}))
def prf_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("prompt_condition",)
    return scoring.micro_macro(scoring.cells(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), tx.FINDINGS, by), by)


@query("prf_by_difficulty", sql(f"SELECT prompt_condition, difficulty, count(*) AS n, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (SELECT prompt_condition, difficulty, {counts('truth_h', 'pred_h', tx.FINDINGS)} FROM scored) GROUP BY 1, 2", "scored"))
def prf_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.row_prf(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), tx.FINDINGS, ("prompt_condition", "difficulty"))


_CELLS_LI = {"cond": "SELECT l_orderkey AS uid, l_linenumber AS class, l_shipmode AS x FROM lineitem"}
_LI = """SELECT l_linestatus AS condition, l_linenumber AS class, l_orderkey AS uid, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS t, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1, 2, 3"""


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction of the cells (order, line) of lineitem, by line status."""
    one = lambda c: F.max(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("condition"), F.col("l_linenumber").alias("class"), F.col("l_orderkey").alias("uid")).agg(one(F.col("l_returnflag") == "R").alias("t"), one(F.col("l_quantity") > 25).alias("p"))


@query("prf_large_cells", f"SELECT condition, class, CAST(sum(t * p) AS BIGINT) AS tp, CAST(sum((1 - t) * p) AS BIGINT) AS fp, CAST(sum(t * (1 - p)) AS BIGINT) AS fn FROM ({_LI}) GROUP BY 1, 2")
def prf_large_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    return line_cells(spark, sf_dir).groupBy("condition", "class").agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"))


_MASK = {"ext": f"SELECT uid, unnest({_lists(tx.FINDINGS)}) AS class FROM reports", "mask": "SELECT e.uid, e.class, CASE WHEN a.rank IS NOT DISTINCT FROM b.rank THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM ext e LEFT JOIN ranks a ON a.uid = e.uid AND a.class = e.class AND a.src = 'report' LEFT JOIN ranks b ON b.uid = e.uid AND b.class = e.class AND b.src = 'impression'"}
_MASKED = f"SELECT s.prompt_condition, m.confidence, CAST(sum(CASE WHEN t AND p THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT t AND p THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM (SELECT s.uid, s.prompt_condition, e.class, list_contains(s.truth_h, e.class) AS t, list_contains(s.pred_h, e.class) AS p FROM scored s JOIN ext e ON e.uid = s.uid) s JOIN mask m ON m.uid = s.uid AND m.class = s.class GROUP BY 1, 2"


def confidence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, class and HIGH where report and impression have the same state, else MEDIUM."""
    both = labeling.label_texts(labelled(spark, sf_dir).select("uid", "impression", *[F.col(c).alias(f"r_{c}") for c in ("pos", "unc", "neg")]), "impression")
    state = lambda p, c: F.when(F.array_contains(f"{p}pos", c), 3).when(F.array_contains(f"{p}unc", c), 2).when(F.array_contains(f"{p}neg", c), 1).otherwise(0)
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.when(state("", c) == state("r_", c), "HIGH").otherwise("MEDIUM").alias("confidence")) for c in tx.FINDINGS])
    return both.select("uid", F.explode(each).alias("m")).select("uid", "m.class", "m.confidence")


@query("prf_masked", sql(f"SELECT prompt_condition, {_P} AS precision, {_R} AS recall, {_F1} AS f1, CAST(sum(tp + fp + fn) AS BIGINT) AS n_cells FROM masked WHERE confidence = 'HIGH' GROUP BY 1", "scored", more=_MASK | {"masked": _MASKED}))
def prf_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = confidence_mask(spark, sf_dir).filter("confidence = 'HIGH'").select("uid", "class")
    rows = scoring.masked_counts(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), mask, ("prompt_condition",))
    total = rows.groupBy("prompt_condition").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return total.select("prompt_condition", *sets.prf("tp", "fp", "fn"), (F.col("tp") + F.col("fp") + F.col("fn")).alias("n_cells"))


@query("f1_by_confidence", sql(f"SELECT prompt_condition, confidence, {_F1} AS f1, CAST(sum(tp + fp + fn) AS BIGINT) AS n_cells FROM masked GROUP BY 1, 2 HAVING sum(tp + fp + fn) > 0", "scored", more=_MASK | {"masked": _MASKED}))
def f1_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.masked_counts(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), confidence_mask(spark, sf_dir), ("prompt_condition",))
    total = rows.groupBy("prompt_condition", "confidence").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return total.select("prompt_condition", "confidence", sets.prf("tp", "fp", "fn")[2], (F.col("tp") + F.col("fp") + F.col("fn")).alias("n_cells"))


@query("accuracy_f1_summary", sql("SELECT a.prompt_condition, round(a.accuracy, 4) AS accuracy, round(m.micro_f1, 4) AS micro_f1, round(m.macro_f1, 4) AS macro_f1 FROM (SELECT prompt_condition, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored GROUP BY 1) a JOIN macro m USING (prompt_condition)", "scored", more={"by_class": _BY_CLASS, "macro": _MACRO}))
def accuracy_f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = top1_accuracy(spark, sf_dir), prf_micro_macro(spark, sf_dir)
    return a.join(m, "prompt_condition").select("prompt_condition", *[F.round(c, 4).alias(c) for c in ("accuracy", "micro_f1", "macro_f1")])


_H = lambda c: f"CASE WHEN list_has_any({c}, {CHILDREN}) THEN list_distinct(list_append({c}, 'Lung Opacity')) ELSE {c} END"
_POL = lambda name, t, p: f"SELECT prompt_condition, '{name}' AS policy, {_F1} AS f1 FROM (SELECT prompt_condition, {counts(t, p, tx.FINDINGS)} FROM pol) GROUP BY 1"


@query("uncertain_policies", sql(" UNION ALL ".join((_POL("ones", "truth_h", "pred_h"), _POL("zeros", "zero_h", "pred_h"), _POL("ignore", "list_filter(zero_h, lambda c: NOT list_contains(unc_h, c))", "list_filter(pred_h, lambda c: NOT list_contains(unc_h, c))"))), "scored", more={"pol": f"SELECT *, {_H('t_ignore')} AS zero_h, {_H('unc')} AS unc_h FROM scored"}))
def uncertain_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    zero, unc = sets.with_parents(F.col("t_ignore")), sets.with_parents(F.col("unc"))
    variants = {"ones": (F.col("truth_h"), F.col("pred_h")), "zeros": (zero, F.col("pred_h")), "ignore": (F.array_except(zero, unc), F.array_except("pred_h", unc))}
    each = F.array(*[F.struct(F.lit(k).alias("policy"), *sets.confusion(t, p, tx.FINDINGS)) for k, (t, p) in variants.items()])
    total = rows.select("prompt_condition", F.explode(each).alias("v")).groupBy("prompt_condition", "v.policy").agg(*[F.sum(f"v.{k}").alias(k) for k in ("tp", "fp", "fn")])
    return total.select("prompt_condition", "policy", sets.prf("tp", "fp", "fn")[2])


_LV = lambda name, body: f"SELECT prompt_condition, difficulty, '{name}' AS level, {body} FROM scored"
_CORE = lambda c: f"list_filter({_GROUP(c)}, lambda g: list_contains({_lists(tx.CORE_GROUPS)}, g))"
_LEVELS = " UNION ALL ".join((
    _LV("classes", counts("truth_h", "pred_h", tx.FINDINGS)), _LV("reliable", counts("truth_h", "pred_h", tx.RELIABLE)), _LV("groups", counts(_GROUP("truth_h"), _GROUP("pred_h"), tuple(tx.GROUPS))),
    _LV("core_groups", counts(_CORE("truth_h"), _CORE("pred_h"), tx.CORE_GROUPS)),
    _LV("any_acute", f"CASE WHEN {_ACUTE('truth_h')} AND {_ACUTE('pred_h')} THEN 1 ELSE 0 END AS tp, CASE WHEN NOT {_ACUTE('truth_h')} AND {_ACUTE('pred_h')} THEN 1 ELSE 0 END AS fp, CASE WHEN {_ACUTE('truth_h')} AND NOT {_ACUTE('pred_h')} THEN 1 ELSE 0 END AS fn"),
))


@query("granularity_ladder", sql(f"SELECT prompt_condition, level, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM levels GROUP BY 1, 2", "scored", more={"levels": _LEVELS}))
def granularity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ladder(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), ("prompt_condition",))


@query("h4_spread", sql(f"SELECT difficulty, max(f1) - min(f1) AS spread, arg_max(prompt_condition, struct_pack(f := f1, c := prompt_condition)) AS best FROM (SELECT difficulty, prompt_condition, {_F1} AS f1 FROM levels WHERE level = 'core_groups' GROUP BY 1, 2) GROUP BY 1", "scored", more={"levels": _LEVELS}))
def h4_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.ladder(scored(spark, sf_dir), F.col("truth_h"), F.col("pred_h"), ("difficulty", "prompt_condition")).filter("level = 'core_groups'")
    return rows.groupBy("difficulty").agg((F.max("f1") - F.min("f1")).alias("spread"), F.max_by("prompt_condition", F.struct("f1", "prompt_condition")).alias("best"))


# ---- Claims. ----

_BY_WORDS = lambda t: f"CASE WHEN regexp_matches({t}, {quoted(tx.NEGATION)}) THEN 'absent' WHEN regexp_matches({t}, {quoted(tx.HEDGE)}) THEN 'uncertain' ELSE 'present' END"
_CLAIMS = {
    "said_texts": """SELECT uid, k, dx2 AS t, s1 AS p FROM predictions WHERE form = 2 UNION ALL SELECT uid, k, dx3, s2 FROM predictions WHERE form = 2 UNION ALL SELECT uid, k, cited, NULL FROM predictions WHERE form = 2
      UNION ALL SELECT uid, k, n1, CASE WHEN lower(s1) IN ('present', 'absent', 'uncertain') THEN lower(s1) END FROM predictions WHERE form = 1 UNION ALL SELECT uid, k, n2, NULL FROM predictions WHERE form = 1 AND uid % 3 <> 0
      UNION ALL SELECT uid, k, said, NULL FROM predictions WHERE NOT (form = 4 AND uid % 2 = 1)""",
    "matched": " UNION ".join(f"SELECT uid, k, {quoted(c)} AS class, coalesce(p, {_BY_WORDS('t')}) AS presence FROM said_texts WHERE regexp_matches(t, {quoted(p)})" for c, p in tx.PATTERNS.items()),
}
_JUDGED = _CLAIMS | {
    "verdicts": """SELECT m.uid, m.k, m.class, m.presence, CASE WHEN r.rank IS NULL THEN 'unverifiable' WHEN r.rank = 2 THEN 'unsupported_plausible' WHEN (m.presence = 'present') = (r.rank = 3) THEN 'supported' ELSE 'contradicted' END AS verdict
      FROM matched m LEFT JOIN ranks r ON r.uid = m.uid AND r.class = m.class AND r.src = 'report'""",
    "judged": f"""SELECT p.uid, p.k, p.prompt_condition, p.said_dx, count(v.class) AS n_claims, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(*) FILTER (WHERE verdict = 'unverifiable') AS unverifiable,
        count(*) FILTER (WHERE verdict = 'unsupported_plausible') AS unsupported_plausible, any_value(CASE WHEN p.form = 4 AND p.uid % 2 = 1 THEN 0 ELSE len(regexp_extract_all(p.said || ' ' || CASE WHEN p.form = 2 THEN p.cited ELSE '' END, {quoted(tx.FABRICATION)})) END) AS fab_prose,
        any_value(CASE WHEN p.form = 4 AND p.uid % 2 = 1 THEN 0 ELSE len(regexp_extract_all(p.said || ' ' || CASE WHEN p.form = 2 THEN p.cited || ' ' || p.dx2 || ' ' || p.dx3 ELSE '' END, {quoted(tx.FABRICATION)})) END) AS fab, coalesce(list(v.class) FILTER (WHERE v.presence = 'present'), []) AS stated
      FROM predictions p LEFT JOIN verdicts v ON v.uid = p.uid AND v.k = p.k GROUP BY 1, 2, 3, 4""",
}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labelled(spark, sf_dir).select("uid", "pos", "unc", "neg")
    return scoring.judged_claims(responses.parse(derived.predictions(spark, sf_dir)).join(labels, "uid"))


@query("extract_claims", sql("SELECT uid, k, class, presence FROM matched", "predictions", more=_CLAIMS))
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    return rows.select("uid", key_k(), F.explode(responses.claims(F.col("answer"))).alias("c")).select("uid", "k", "c.class", "c.presence")


@query("groundedness", sql("""SELECT prompt_condition, avg(CASE WHEN supported + contradicted + unsupported_plausible > 0 THEN supported * 1.0 / (supported + contradicted + unsupported_plausible) END) AS support_rate,
  avg(CASE WHEN n_claims > 0 THEN contradicted * 1.0 / n_claims ELSE 0.0 END) AS contradiction_rate, avg(n_claims) AS mean_claims, avg(unverifiable) AS unverifiable, avg(fab) AS fabricated FROM judged GROUP BY 1""", "predictions", "ranks", more=_JUDGED))
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("prompt_condition").agg(F.avg("support_rate").alias("support_rate"), F.avg("contradiction_rate").alias("contradiction_rate"), F.avg("n_claims").alias("mean_claims"), F.avg("unverifiable").alias("unverifiable"), F.avg("n_fabricated").alias("fabricated"))


_OMIT = _JUDGED | {"omit": "SELECT j.*, t.pos, len(list_filter(t.pos, lambda c: NOT list_contains(j.stated, c) AND NOT list_contains(n.classes, c))) AS n_omitted FROM judged j JOIN truth t ON t.uid = j.uid AND t.src = 'report' JOIN norm n ON n.text = j.said_dx"}


def hallucinated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hallucinations(judged(spark, sf_dir))


@query("hallucination", sql("""SELECT prompt_condition, avg(CASE WHEN contradicted > 0 OR fab_prose > 0 THEN 1.0 ELSE 0.0 END) AS hallucination_rate, avg(contradicted) AS contradicted, avg(fab_prose) AS fabricated,
  avg(CASE WHEN len(pos) > 0 THEN n_omitted * 1.0 / len(pos) ELSE 0.0 END) AS omission_rate FROM omit GROUP BY 1""", "predictions", "truth", "norm", more=_OMIT))
def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hallucinated(spark, sf_dir).groupBy("prompt_condition").agg(F.avg(F.when(F.col("hallucinated"), 1.0).otherwise(0.0)).alias("hallucination_rate"), F.avg("contradicted").alias("contradicted"), F.avg("n_fabricated_prose").alias("fabricated"), F.avg("omission_rate").alias("omission_rate"))


@query("error_profile", sql("SELECT prompt_condition, CAST(sum(contradicted) AS BIGINT) AS contradicted, CAST(sum(fab_prose) AS BIGINT) AS fabricated, CAST(sum(n_omitted) AS BIGINT) AS omitted FROM omit GROUP BY 1", "predictions", "truth", "norm", more=_OMIT))
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hallucinated(spark, sf_dir).groupBy("prompt_condition").agg(F.sum("contradicted").alias("contradicted"), F.sum("n_fabricated_prose").alias("fabricated"), F.sum("n_omitted").alias("omitted"))


@query("error_taxonomy", sql("""SELECT o.prompt_condition, s.difficulty, CAST(sum(CASE WHEN len(list_filter(s.pred, lambda c: NOT list_contains(s.t_ignore, c))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_positive, CAST(sum(CASE WHEN o.n_omitted > 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_negative,
  CAST(sum(CASE WHEN NOT s.correct AND s.confidence >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS overconfident, CAST(sum(CASE WHEN s.correct AND s.confidence < 50 THEN 1 ELSE 0 END) AS BIGINT) AS underconfident, CAST(sum(CASE WHEN o.contradicted > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ungrounded
  FROM omit o JOIN scored s ON s.uid = o.uid AND s.k = o.k GROUP BY 1, 2""", "scored", "norm", more=_OMIT))
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hallucinated(spark, sf_dir).select("uid", "k", "n_omitted", "contradicted")
    rows = scored(spark, sf_dir).join(h, ["uid", "k"])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("prompt_condition", "difficulty").agg(n(F.size(F.array_except("pred", "t_ignore")) > 0).alias("false_positive"), n(F.col("n_omitted") > 0).alias("false_negative"), n(~F.col("correct") & (F.col("confidence") >= 50)).alias("overconfident"), n(F.col("correct") & (F.col("confidence") < 50)).alias("underconfident"), n(F.col("contradicted") > 0).alias("ungrounded"))


# ---- Calibration, on events: five conditions, a confidence in the props, a value for right or wrong. ----

EVENTS = "SELECT event_type AS prompt_condition, user_id AS uid, event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 101 AS confidence, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS correct, value FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("prompt_condition"), F.col("user_id").alias("uid"), "event_id", (F.get_json_object("props", "$.k").cast("int") % 101).alias("confidence"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("correct"), "value")


def _calibration(bin_sql: str, by: str) -> str:
    return f"""SELECT {by}, sum(n) AS n, sum(coalesce(gap, 0)) / sum(n) AS ece, coalesce(max(gap / n), 0.0) AS mce, sum(sb) / sum(n) AS brier, sum(over) / sum(n) AS overconfidence, sum(under) / sum(n) AS underconfidence, sum(sc) / sum(n) AS mean_conf, sum(sk) / sum(n) AS accuracy
  FROM (SELECT {by}, bin, CAST(count(*) AS BIGINT) AS n, CASE WHEN bin IS NOT NULL THEN abs(sum(c) - sum(ok)) END AS gap, sum((c - ok) * (c - ok)) AS sb, sum(CASE WHEN c >= 0.5 AND ok = 0 THEN 1 ELSE 0 END) AS over, sum(CASE WHEN c < 0.5 AND ok = 1 THEN 1 ELSE 0 END) AS under, sum(c) AS sc, sum(ok) AS sk
    FROM (SELECT {by}, {bin_sql} AS bin, confidence / 100.0::DOUBLE AS c, CAST(correct AS INTEGER) AS ok FROM ev) GROUP BY {by}, bin) GROUP BY {by}"""


@query("calibration", sql(_calibration("least(14, CAST(floor(confidence * 15 / 100.0) AS INTEGER))", "prompt_condition").replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"), more={"ev": EVENTS}))
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.calibration(events(spark, sf_dir), ("prompt_condition",))


@query("calibration_by_difficulty", sql(_calibration("least(9, CAST(floor(confidence * 10 / 100.0) AS INTEGER))", "prompt_condition, difficulty").replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"), "scored", more={"ev": "SELECT * FROM scored"}))
def calibration_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.calibration(scored(spark, sf_dir), ("prompt_condition", "difficulty"), bins=10)


@query("ece_right_closed", sql("SELECT prompt_condition, ece, mean_conf, mean_conf - accuracy AS gap FROM (" + _calibration("CASE WHEN confidence > 0 THEN CAST(ceil(confidence * 15 / 100.0) AS INTEGER) - 1 END", "prompt_condition") + ")", more={"ev": EVENTS}))
def ece_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.calibration(events(spark, sf_dir), ("prompt_condition",), right_closed=True)
    return rows.select("prompt_condition", "ece", "mean_conf", (F.col("mean_conf") - F.col("accuracy")).alias("gap"))


@query("reliability_bins", sql("""SELECT g.prompt_condition, g.bin / 10.0::DOUBLE AS lo, (g.bin + 1) / 10.0::DOUBLE AS hi, coalesce(b.n, 0) AS count, b.c AS mean_conf, b.a AS accuracy FROM (SELECT DISTINCT prompt_condition, unnest(generate_series(0, 9)) AS bin FROM ev) g
  LEFT JOIN (SELECT prompt_condition, least(9, CAST(floor(confidence / 10.0) AS INTEGER)) AS bin, count(*) AS n, avg(confidence) / 100 AS c, avg(correct) AS a FROM ev GROUP BY 1, 2) b ON b.prompt_condition = g.prompt_condition AND b.bin = g.bin""", more={"ev": EVENTS}))
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reliability(events(spark, sf_dir), ("prompt_condition",))


@query("cal_err", sql("SELECT prompt_condition, uid, avg(abs(confidence / 100.0::DOUBLE - correct)) AS cal_err FROM ev GROUP BY 1, 2", more={"ev": EVENTS}))
def cal_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("prompt_condition", "uid").agg(F.avg(F.abs(F.col("confidence") / 100 - F.col("correct"))).alias("cal_err"))


# ---- Votes: the five answers of a report as samples. ----

_VOTES = {"votes": f"SELECT uid, c.class, c.pos, CAST(sum(CASE WHEN list_contains(pred, c.class) THEN 1 ELSE 0 END) AS BIGINT) AS votes, count(*) AS n FROM answers, (SELECT unnest({_lists(tx.FINDINGS)}) AS class, unnest(generate_series(0, {len(tx.FINDINGS) - 1})) AS pos) c GROUP BY 1, 2, 3"}


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.votes(answers(spark, sf_dir), ("uid",))


@query("vote_aggregate", sql("SELECT uid, coalesce(string_agg(class, '|' ORDER BY class) FILTER (WHERE votes >= 2), '') AS present, coalesce(arg_min(class, pos) FILTER (WHERE votes >= 2), 'No acute cardiopulmonary finding') AS primary_diagnosis, CAST(coalesce(max(round_even(100.0 * votes / n, 0)) FILTER (WHERE votes >= 2), 90) AS INTEGER) AS confidence FROM votes GROUP BY uid", "answers", more=_VOTES))
def vote_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.vote_decision(vote_counts(spark, sf_dir), ("uid",), 2).select("uid", sets.joined(F.col("present")).alias("present"), "primary_diagnosis", "confidence")


@query("vote_sweep", sql(f"SELECT k, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (SELECT g.k, CASE WHEN v.votes >= g.k AND list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS tp, CASE WHEN v.votes >= g.k AND NOT list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS fp, CASE WHEN v.votes < g.k AND list_contains(t.t_ignore, v.class) THEN 1 ELSE 0 END AS fn FROM votes v JOIN truth t ON t.uid = v.uid AND t.src = 'impression', (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS k) g) GROUP BY k", "answers", "truth", more=_VOTES))
def vote_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = labelled(spark, sf_dir, "impression").select("uid", sets.truth_set(F.col("pos"), F.col("unc")).alias("truth"))
    return experiments.vote_sweep(vote_counts(spark, sf_dir), truth, "uid", 5)


@query("presence_counts", sql("SELECT name, presence, count(*) AS n FROM (SELECT n1 AS name, lower(s1) AS presence FROM predictions WHERE form = 1 UNION ALL SELECT n2, CASE WHEN uid % 3 <> 0 THEN lower(s2) END FROM predictions WHERE form = 1) GROUP BY 1, 2", "predictions"))
def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir)).select(F.explode_outer("answer.findings").alias("name", "v"))  # no filter on the parsed answer, which would parse it twice
    said = rows.groupBy("name", F.lower(F.coalesce("v.presence", "v.status")).alias("presence")).agg(F.count(F.lit(1)).alias("n"))
    return said.filter(F.col("name").isNotNull())


@query("verify_merge", sql(f"SELECT uid, k, {S('kept')} AS kept, len(pred) - len(kept) AS rejected FROM (SELECT uid, k, pred, list_filter(pred, lambda c: NOT list_contains(unc, c)) AS kept FROM scored)", "scored"))
def verify_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = experiments.merge_verdicts(F.col("pred"), F.col("unc"))
    return scored(spark, sf_dir).select("uid", key_k(), sets.joined(kept).alias("kept"), (F.size("pred") - F.size(kept)).cast("long").alias("rejected"))


@query("variant_table", sql(f"""SELECT prompt_condition, classes, count(*) AS n, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM (
  SELECT prompt_condition, 'all' AS classes, {counts('truth_h', 'pred_h', tx.FINDINGS)} FROM scored WHERE uid IN (SELECT uid FROM scored WHERE api_error = '' GROUP BY uid HAVING count(DISTINCT k) = 5)
  UNION ALL SELECT prompt_condition, 'reliable', {counts('truth_h', 'pred_h', tx.RELIABLE)} FROM scored WHERE uid IN (SELECT uid FROM scored WHERE api_error = '' GROUP BY uid HAVING count(DISTINCT k) = 5)) GROUP BY 1, 2""", "scored"))
def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = derived.predictions(spark, sf_dir).filter("api_error = ''")
    rows = scored(spark, sf_dir).join(experiments.common_uids(ok, "k", 5), "uid", "left_semi")
    each = [scoring.row_prf(rows, F.col("truth_h"), F.col("pred_h"), c, ("prompt_condition",)).withColumn("classes", F.lit(n)) for n, c in (("all", tx.FINDINGS), ("reliable", tx.RELIABLE))]
    return each[0].unionByName(each[1])


# ---- Arms: answers of two conditions of a report side by side. ----

_AB = {"ab": "SELECT a.uid, a.pred AS a, b.pred AS b, a.t_ignore AS t, a.correct AS ok_a, b.correct AS ok_b, a.difficulty FROM scored a JOIN scored b ON a.uid = b.uid AND a.k = 0 AND b.k = 1"}


def two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter("k < 2")
    return rows.groupBy("uid", "difficulty").agg(F.max(F.when(F.col("k") == 0, F.col("pred"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("pred"))).alias("b"), F.max("t_ignore").alias("t"))


@query("twostage_attribution", sql("""SELECT difficulty, count(*) AS n, avg(CASE WHEN ok_a THEN 1.0 ELSE 0.0 END) AS acc_a, avg(CASE WHEN ok_b THEN 1.0 ELSE 0.0 END) AS acc_b, avg(CASE WHEN list_sort(a) = list_sort(b) THEN 1.0 ELSE 0.0 END) AS fidelity,
  avg(CASE WHEN list_sort(a) <> list_sort(b) THEN CASE WHEN ok_b THEN 1.0 ELSE 0.0 END END) AS override_right, avg(CASE WHEN NOT ok_b THEN CASE WHEN ok_a THEN 0.0 ELSE 1.0 END END) AS errors_from_a, avg(len(a)) AS findings_per_study, avg(CASE WHEN len(a) > 0 THEN 1.0 ELSE 0.0 END) AS abnormal FROM ab GROUP BY difficulty""", "scored", more=_AB))
def twostage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.two_stage(two_arms(spark, sf_dir), F.col("a"), F.col("b"), F.col("t"), ("difficulty",))


_ARM = f"SELECT prompt_condition, count(*) AS n, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, avg(tp) AS tp_per_study, avg(fp) AS fp_per_study, avg(fn) AS fn_per_study, avg(prompt_tokens) AS mean_tokens, quantile_cont(prompt_tokens, 0.5) AS median_tokens, avg(n_image_parts) AS mean_parts FROM (SELECT *, {counts('t_ignore', 'pred', tx.FINDINGS)} FROM scored) GROUP BY 1"


@query("arm_scores", sql(_ARM, "scored"))
def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.arm_scores(scored(spark, sf_dir), ("prompt_condition",), F.col("t_ignore"), F.col("pred"))


@query("dose_response", sql("SELECT a.prompt_condition, a.median_tokens, a.accuracy, a.accuracy - b.accuracy AS gain, a.fp_per_study - b.fp_per_study AS more_fp FROM arms a, (SELECT * FROM arms WHERE prompt_condition = 'direct') b", "scored", more={"arms": _ARM}))
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = arm_scores(spark, sf_dir)
    base = arms.filter("prompt_condition = 'direct'").select(F.lit(1).alias("one"), F.col("accuracy").alias("a0"), F.col("fp_per_study").alias("f0"))
    return arms.withColumn("one", F.lit(1)).join(base, "one").select("prompt_condition", "median_tokens", "accuracy", (F.col("accuracy") - F.col("a0")).alias("gain"), (F.col("fp_per_study") - F.col("f0")).alias("more_fp"))


@query("effects_2x2", sql("""SELECT count(*) AS n, avg(((c1 - c0) + (c3 - c2)) / 2) AS visual, avg(((c2 - c0) + (c3 - c1)) / 2) AS reasoning, avg((c3 - c2) - (c1 - c0)) AS interaction FROM (
  SELECT uid, avg(CASE WHEN k = 0 THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS c0, avg(CASE WHEN k = 1 THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS c1, avg(CASE WHEN k = 2 THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS c2, avg(CASE WHEN k = 3 THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS c3 FROM scored GROUP BY uid)""", "scored"))
def effects_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.factorial_effects(scored(spark, sf_dir), "uid", "prompt_condition", F.when(F.col("correct"), 1.0).otherwise(0.0), derived.CONDITIONS[:4])


@query("did_effect", sql("SELECT avg(d) FILTER (WHERE z IS NOT NULL) AS localizable, avg(d) FILTER (WHERE z IS NULL) AS assigned, avg(d) FILTER (WHERE z IS NOT NULL) - avg(d) FILTER (WHERE z IS NULL) AS did FROM (SELECT CASE WHEN r.mesh LIKE 'Consolidation/lung/base%' OR r.mesh LIKE 'Opacity/lung/apex%' OR r.mesh LIKE 'Density/%' THEN 1 END AS z, CASE WHEN ok_b THEN 1.0 ELSE 0.0 END - CASE WHEN ok_a THEN 1.0 ELSE 0.0 END AS d FROM ab JOIN reports r ON r.uid = ab.uid)", "scored", more=_AB))
def did_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.zones import tag_zone

    one = lambda p: F.when(sets.is_correct(F.col(p), F.col("t")), 1.0).otherwise(0.0)
    rows = two_arms(spark, sf_dir).join(derived.reports(spark, sf_dir).select("uid", tag_zone(F.col("mesh")).alias("z")), "uid").withColumn("d", one("b") - one("a"))
    mean = lambda c: F.avg(F.when(c, F.col("d")))
    return rows.agg(mean(F.col("z").isNotNull()).alias("localizable"), mean(F.col("z").isNull()).alias("assigned")).withColumn("did", F.col("localizable") - F.col("assigned"))


_EXPERT = "SELECT s.pred_h, s.truth_h, t.t_ones AS e FROM scored s JOIN truth t ON t.uid = s.uid AND t.src = 'report'"


@query("expert_scoring", sql("SELECT class, count(*) AS disputed, CAST(sum(c) AS BIGINT) AS confirmed, CAST(sum(1 - c) AS BIGINT) AS refuted, avg(c) AS incompleteness FROM (SELECT class, CASE WHEN list_contains(e, class) THEN 1 ELSE 0 END AS c FROM (SELECT unnest(list_filter(pred_h, lambda c: NOT list_contains(truth_h, c))) AS class, e FROM x)) GROUP BY 1", "scored", more={"x": _EXPERT}))
def expert_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    expert = labelled(spark, sf_dir).select("uid", sets.truth_set(F.col("pos"), F.col("unc"), "ones").alias("e"))
    return experiments.expert_cells(scored(spark, sf_dir).join(expert, "uid"), F.col("pred_h"), F.col("truth_h"), F.col("e"))


@query("disputed_cells", sql("SELECT uid, k, unnest(list_filter(pred_h, lambda c: NOT list_contains(truth_h, c))) AS class FROM scored", "scored"))
def disputed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("uid", key_k(), F.explode(F.array_except("pred_h", "truth_h")).alias("class"))


@query("jaccard", sql("SELECT prompt_condition, avg(CASE WHEN len(pred_h) = 0 AND len(truth_h) = 0 THEN 1.0 ELSE len(list_intersect(pred_h, truth_h)) * 1.0 / len(list_distinct(list_concat(pred_h, truth_h))) END) AS jaccard FROM scored GROUP BY 1", "scored"))
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("prompt_condition").agg(F.avg(sets.jaccard(F.col("pred_h"), F.col("truth_h"))).alias("jaccard"))


@query("quality_gates", "SELECT * FROM (SELECT 'has_text' AS gate, avg(CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 1.0 ELSE 0.0 END) AS value, avg(CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AS passed FROM conversations UNION ALL SELECT 'from_user', avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END) >= 0.9 FROM conversations)")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return experiments.gates(table(spark, sf_dir, "conversations"), {"has_text": (one(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0), 0.9), "from_user": (one(F.col("role") == "user"), 0.9)})


@query("run_health", sql("SELECT prompt_condition, count(*) AS n, avg(CASE WHEN form = 4 AND uid % 2 = 1 THEN 0.0 ELSE 1.0 END) AS parsed, CAST(sum(CASE WHEN api_error <> '' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM predictions GROUP BY 1", "predictions"))
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    return rows.groupBy("prompt_condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("json").isNotNull(), 1.0).otherwise(0.0)).alias("parsed"), F.sum(F.when(F.col("api_error") != "", 1).otherwise(0)).alias("errors"))


@query("output_diversity", "SELECT role, count(*) AS n, count(DISTINCT coalesce(text, '')) AS \"distinct\", avg(length(coalesce(text, ''))) AS mean_chars, CAST(min(length(coalesce(text, ''))) AS INTEGER) AS min_chars, CAST(max(length(coalesce(text, ''))) AS INTEGER) AS max_chars FROM conversations GROUP BY 1")
def output_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.diversity(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ("role",), "text")


@query("ddx_topk_mrr", sql("""SELECT prompt_condition, count(*) AS n, avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS top2, avg(CASE WHEN hit IS NOT NULL THEN 1.0 / hit ELSE 0.0 END) AS mrr
  FROM (SELECT s.prompt_condition, CASE WHEN form = 0 THEN NULL WHEN list_has_any(a.classes, s.t_ignore) THEN 1 WHEN list_has_any(b.classes, s.t_ignore) THEN 2 END AS hit FROM scored s JOIN norm a ON a.text = s.dx2 JOIN norm b ON b.text = s.dx3 WHERE s.form = 3 OR (s.form = 0 AND s.uid % 2 = 1 AND (s.uid // 5) % 6 = 0)) GROUP BY 1""", "scored"))
def ddx_topk_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter(F.size("answer.differential") > 0)
    hits = F.transform("answer.differential", lambda d, i: F.when(F.arrays_overlap(text.answer_classes(d["diagnosis"]), F.col("t_ignore")), i + 1))
    rows = rows.withColumn("hit", F.array_min(hits))
    return rows.groupBy("prompt_condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("hit") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.when(F.col("hit") <= 2, 1.0).otherwise(0.0)).alias("top2"), F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))).alias("mrr"))


@query("judge_agreement", "SELECT l_linestatus AS cond, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement, CAST(sum(CASE WHEN abs(a - b) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS far_apart FROM (SELECT l_linestatus, CAST(floor(l_quantity) AS INTEGER) % 5 + 1 AS a, CAST(floor(l_extendedprice) AS INTEGER) % 5 + 1 AS b FROM lineitem) GROUP BY 1")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("cond"), (F.floor("l_quantity") % 5 + 1).alias("a"), (F.floor("l_extendedprice") % 5 + 1).alias("b"))
    return rows.groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("agreement"), F.sum(F.when(F.abs(F.col("a") - F.col("b")) > 1, 1).otherwise(0)).alias("far_apart"))


@query("group_policy", None)
def group_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups dropped by the greedy policy tuned on half of the reports, with f1 of the other half before and after."""
    rows = scored(spark, sf_dir).withColumn("dev", F.col("uid") % 2 == 0)
    counts_ = scoring.cells(rows, sets.to_groups(F.col("truth_h")), sets.to_groups(F.col("pred_h")), tuple(tx.GROUPS), ("dev",)).collect()  # ten rows
    dropped = experiments.drop_groups([(r["class"], r["tp"], r["fp"], r["fn"]) for r in counts_ if r["dev"]])
    f1 = lambda xs: 2.0 * sum(r["tp"] for r in xs) / max(1, sum(2 * r["tp"] + r["fp"] + r["fn"] for r in xs))
    test = [r for r in counts_ if not r["dev"]]
    return spark.createDataFrame([("|".join(sorted(dropped)), f1(test), f1([r for r in test if r["class"] not in dropped]))], "dropped string, f1_before double, f1_after double")


@query("class_weights", f"SELECT class, least(20.0, (count(*) - sum(t)) * 1.0 / greatest(1, sum(t))) AS weight FROM ({_LI}) GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.class_weights(line_cells(spark, sf_dir).withColumnRenamed("t", "y"))
