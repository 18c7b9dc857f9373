"""Scores of predicted sets: accuracy, precision and recall, granularity, groundedness, hallucination, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import sets
from ..functions.text import answer_classes, findings_of, literal
from .responses import claims, fabrications


def cells(df: DataFrame, truth: Column, pred: Column, classes, keep: tuple[str, ...], mask: Column | None = None) -> DataFrame:
    """tp, fp and fn by class, summed over rows before anything is shuffled; keep names the groups. mask: array of classes that don't count in a row."""
    hit = lambda arr, c: F.array_contains(arr, c)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    use = lambda c: F.lit(True) if mask is None else ~hit(mask, c)
    each = F.array(*[F.struct(F.lit(c).alias("class"), one(use(c) & hit(truth, c) & hit(pred, c)).alias("tp"), one(use(c) & ~hit(truth, c) & hit(pred, c)).alias("fp"), one(use(c) & hit(truth, c) & ~hit(pred, c)).alias("fn")) for c in classes])
    rows = df.select(*keep, F.explode(each).alias("c"))
    return rows.groupBy(*keep, "c.class").agg(*[F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn")])


def micro_macro(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Micro and macro precision, recall and f1 from counts by class."""
    each = counts.select(*by, "tp", "fp", "fn", *sets.prf("tp", "fp", "fn"))
    total = each.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")], *[F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")])
    return total.select(*by, *[c.alias(f"micro_{n}") for c, n in zip(sets.prf("tp", "fp", "fn"), ("precision", "recall", "f1"), strict=True)], "macro_precision", "macro_recall", "macro_f1", (F.col("tp") + F.col("fp") + F.col("fn")).alias("n_cells"))


def row_prf(df: DataFrame, truth: Column, pred: Column, classes, by: tuple[str, ...]) -> DataFrame:
    """n and micro precision, recall and f1 by group, from counts of whole rows."""
    rows = df.select(*by, *sets.confusion(truth, pred, classes))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return total.select(*by, "n", *sets.prf("tp", "fp", "fn"))


def ladder(df: DataFrame, truth: Column, pred: Column, by: tuple[str, ...]) -> DataFrame:
    """f1 by group and level: all classes, reliable ones, five groups, three groups, any acute finding."""
    levels = {
        "classes": sets.confusion(truth, pred, tx.FINDINGS),
        "reliable": sets.confusion(truth, pred, tx.RELIABLE),
        "groups": sets.confusion(sets.to_groups(truth), sets.to_groups(pred), tuple(tx.GROUPS)),
        "core_groups": sets.confusion(sets.to_groups(truth, tx.CORE_GROUPS), sets.to_groups(pred, tx.CORE_GROUPS), tx.CORE_GROUPS),
    }
    t, p = sets.any_acute(truth), sets.any_acute(pred)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    levels["any_acute"] = [one(t & p).alias("tp"), one(~t & p).alias("fp"), one(t & ~p).alias("fn")]
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *v) for k, v in levels.items()])).alias("l"))
    total = rows.groupBy(*by, "l.level").agg(*[F.sum(f"l.{k}").alias(k) for k in ("tp", "fp", "fn")])
    return total.select(*by, "level", *sets.prf("tp", "fp", "fn"))


def full_response_set(answer: Column, fallback: Column) -> Column:
    """Classes of diagnosis and explanation together."""
    dx = F.when(answer.isNull(), fallback).otherwise(answer["said_diagnosis"])
    return findings_of(F.array_union(answer_classes(dx), answer_classes(answer["explanation"])))


def judged_claims(df: DataFrame, answer: str = "answer", pos: str = "pos", unc: str = "unc", neg: str = "neg") -> DataFrame:
    """df with counts of claims by verdict against the report's labels, and rates. The labels ride in the row, so claims are never shuffled."""
    rows = df.withColumn("claims", F.coalesce(claims(F.col(answer)), F.array().cast("array<struct<class:string,presence:string>>")))
    in_ = lambda arr, c: F.array_contains(F.col(arr), c)
    verdict = lambda c: (
        F.when(in_(pos, c["class"]), F.when(c["presence"] == "present", "supported").otherwise("contradicted"))
        .when(in_(neg, c["class"]), F.when(c["presence"] == "present", "contradicted").otherwise("supported"))
        .when(in_(unc, c["class"]), "unsupported_plausible")
        .otherwise("unverifiable")
    )
    rows = rows.withColumn("verdicts", F.transform("claims", verdict)).withColumn("n_claims", F.size("claims"))
    names = ("supported", "contradicted", "unverifiable", "unsupported_plausible")
    said = lambda name: F.size(F.filter("verdicts", lambda x: x == name))
    rows = rows.withColumns({v: said(v) for v in names})
    verifiable = F.col("supported") + F.col("contradicted") + F.col("unsupported_plausible")
    return rows.withColumns({"support_rate": F.when(verifiable > 0, F.col("supported") / verifiable), "contradiction_rate": sets.ratio(F.col("contradicted"), F.col("n_claims")), "n_fabricated": F.coalesce(fabrications(F.col(answer), True), F.lit(0))})


def hallucinations(judged: DataFrame, answer: str = "answer", dx: str = "primary_diagnosis", pos: str = "pos") -> DataFrame:
    """judged with hallucinated (a contradicted claim or a fabrication), omitted classes and omission_rate."""
    fab = F.coalesce(fabrications(F.col(answer), False), F.lit(0))
    stated = F.array_union(answer_classes(F.when(F.col(answer).isNull(), F.col(dx)).otherwise(F.col(answer)["primary_diagnosis"])), F.transform(F.filter("claims", lambda c: c["presence"] == "present"), lambda c: c["class"]))
    omitted = F.array_except(F.col(pos), stated)
    return judged.withColumns({"n_fabricated_prose": fab, "hallucinated": (F.col("contradicted") > 0) | (fab > 0), "n_omitted": F.size(omitted), "n_ref_positive": F.size(pos), "omission_rate": sets.ratio(F.size(omitted), F.size(pos))})


def calibration(df: DataFrame, by: tuple[str, ...], bins: int = 15, right_closed: bool = False, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """ECE, MCE, Brier score, over- and under-confidence, mean confidence and accuracy by group.

    confidence is an integer from 0 to 100 and is binned by integer arithmetic; with right_closed a confidence of 0 is in no bin.
    """
    conf, ok = F.col(confidence), F.col(correct).cast("int")
    bin_of = F.when(conf > 0, F.ceil(conf * bins / F.lit(100.0)) - 1) if right_closed else F.least(F.lit(bins - 1), F.floor(conf * bins / F.lit(100.0)))
    c = conf / F.lit(100.0)
    rows = df.select(*by, bin_of.cast("int").alias("bin"), c.alias("c"), ok.alias("ok"))
    flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    per = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sc"), F.sum("ok").alias("sk"), F.sum((F.col("c") - F.col("ok")) ** 2).alias("sb"), flag((F.col("c") >= 0.5) & (F.col("ok") == 0)).alias("over"), flag((F.col("c") < 0.5) & (F.col("ok") == 1)).alias("under"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sc") - F.col("sk")))
    n = F.sum("n")
    return per.groupBy(*by).agg(n.alias("n"), (F.coalesce(F.sum(gap), F.lit(0.0)) / n).alias("ece"), F.coalesce(F.max(gap / F.col("n")), F.lit(0.0)).alias("mce"), (F.sum("sb") / n).alias("brier"), (F.sum("over") / n).alias("overconfidence"), (F.sum("under") / n).alias("underconfidence"), (F.sum("sc") / n).alias("mean_conf"), (F.sum("sk") / n).alias("accuracy"))


def reliability(df: DataFrame, by: tuple[str, ...], bins: int = 10, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """lo, hi, count, mean confidence and accuracy of every bin, empty ones too."""
    conf = F.col(confidence)
    per = df.select(*by, F.least(F.lit(bins - 1), F.floor(conf * bins / F.lit(100.0))).cast("int").alias("bin"), conf.alias("c"), F.col(correct).cast("int").alias("ok")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), (F.avg("c") / 100).alias("mean_conf"), F.avg("ok").alias("accuracy"))
    grid = per.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(per, [*by, "bin"], "left").select(*by, (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"), "mean_conf", "accuracy")


def masked_counts(df: DataFrame, truth: Column, pred: Column, mask: DataFrame, by: tuple[str, ...], classes=tx.FINDINGS, uid: str = "uid") -> DataFrame:
    """tp, fp and fn by group over those cells that are in mask (uid, class, and perhaps groups of its own)."""
    t, p = F.array_intersect(truth, literal(classes)), F.array_intersect(pred, literal(classes))
    rows = df.select(uid, *by, F.explode(F.array_union(t, p)).alias("class"), t.alias("t"), p.alias("p"))
    one = lambda c: F.when(c, 1).otherwise(0)
    in_t, in_p = F.array_contains("t", F.col("class")), F.array_contains("p", F.col("class"))
    return rows.select(uid, *by, "class", one(in_t & in_p).alias("tp"), one(~in_t & in_p).alias("fp"), one(in_t & ~in_p).alias("fn")).join(mask, [uid, "class"])


def policy_spread(df: DataFrame, variants: dict[str, tuple[Column, Column]], levels: dict[str, tuple], by: str = "prompt_condition") -> DataFrame:
    """level, condition, f1 under each policy (f1_<policy>) and their spread. variants: truth and prediction by policy; levels: classes by name."""
    each = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(k).alias("policy"), *sets.confusion(t, p, classes)) for n, classes in levels.items() for k, (t, p) in variants.items()])
    total = df.select(by, F.explode(each).alias("v")).groupBy(by, "v.level", "v.policy").agg(*[F.sum(f"v.{k}").alias(k) for k in ("tp", "fp", "fn")])
    f1 = total.select(by, "level", "policy", sets.prf("tp", "fp", "fn")[2])
    wide = f1.groupBy("level", by).agg(*[F.max(F.when(F.col("policy") == k, F.col("f1"))).alias(f"f1_{k}") for k in variants])
    columns = [F.col(f"f1_{k}") for k in variants]
    return wide.withColumn("spread", F.greatest(*columns) - F.least(*columns))


def policy_ranks(spread: DataFrame, policies, by: str = "prompt_condition") -> DataFrame:
    """level, the conditions in falling order of f1 under each policy, and stable: whether the orders are the same. spread: a row for each level and condition."""
    ranked = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(f"f1_{k}")).alias("f"), F.col(by).alias("c")))), lambda x: x["c"]), " > ")
    rows = spread.groupBy("level").agg(*[ranked(k).alias(f"rank_{k}") for k in policies])
    first, *others = [F.col(f"rank_{k}") for k in policies]
    same = F.lit(True)
    for o in others:
        same = same & (first == o)
    return rows.withColumn("stable", same)


def uncertain_share(df: DataFrame, unc: str = "unc", classes=tx.FINDINGS) -> DataFrame:
    """n_uncertain cells and their share of all."""
    n = F.sum(F.size(F.array_intersect(unc, literal(classes))))
    return df.agg(n.alias("n_uncertain"), (n / (F.count(F.lit(1)) * len(classes))).alias("share"))
