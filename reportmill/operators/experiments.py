"""Votes, verification passes, two-stage and arm comparisons, expert scoring and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import sets
from ..functions.text import literal


def votes(samples: DataFrame, by: tuple[str, ...], present: str = "pred", classes=tx.FINDINGS) -> DataFrame:
    """Groups, class, votes and n: how many of a group's n samples have each class."""
    rows = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.array_contains(present, c), 1).otherwise(0)).alias(f"__{i}") for i, c in enumerate(classes)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("class"), F.col(f"__{i}").alias("votes")) for i, c in enumerate(classes)]))
    return rows.select(*by, "n", each.alias("v")).select(*by, "n", "v.pos", "v.class", "v.votes")


def vote_decision(counted: DataFrame, by: tuple[str, ...], k: int, default_confidence: int = 90) -> DataFrame:
    """Groups, present classes with at least k votes, the first of them as diagnosis, and the largest confidence (share of votes, half to even)."""
    conf = F.bround(100 * F.col("votes") / F.col("n")).cast("int")
    held = F.when(F.col("votes") >= k, F.struct("pos", "class"))
    rows = counted.groupBy(*by).agg(F.array_sort(F.collect_list(held)).alias("p"), F.max(F.when(F.col("votes") >= k, conf)).alias("c"))  # a class at most once
    names = F.transform("p", lambda x: x["class"])
    return rows.select(*by, names.alias("present"), F.coalesce(F.get(names, F.lit(0)), F.lit("No acute cardiopulmonary finding")).alias("primary_diagnosis"), F.coalesce("c", F.lit(default_confidence)).alias("confidence"))


def vote_sweep(counted: DataFrame, truth: DataFrame, on: str, most: int, truth_col: str = "truth", classes=tx.FINDINGS) -> DataFrame:
    """k and micro precision, recall and f1 if a class needs k votes."""
    rows = counted.join(truth.select(on, truth_col), on).filter(F.col("class").isin(*classes))
    hit = F.array_contains(truth_col, F.col("class"))
    # Counted by votes first; the sweep then works on most + 1 rows.
    per = rows.groupBy("votes").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("t"), F.sum(F.when(hit, 0).otherwise(1)).alias("f"))
    swept = per.select("votes", "t", "f", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    called = F.col("votes") >= F.col("k")
    total = swept.groupBy("k").agg(F.sum(F.when(called, F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(called, F.col("f")).otherwise(0)).alias("fp"), F.sum(F.when(called, 0).otherwise(F.col("t"))).alias("fn"))
    return total.select("k", *sets.prf("tp", "fp", "fn"))


def merge_verdicts(present: Column, rejected: Column) -> Column:
    """Kept classes of a verification pass."""
    return F.array_except(present, rejected)


def two_stage(rows: DataFrame, a: Column, b: Column, truth: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracies of both stages, fidelity, success of overrides, and the share of the second stage's errors that the first had made."""
    ok_a, ok_b, same = sets.is_correct(a, truth), sets.is_correct(b, truth), F.array_sort(a) == F.array_sort(b)
    r = rows.select(*by, ok_a.alias("ok_a"), ok_b.alias("ok_b"), same.alias("same"), F.size(a).alias("na"))
    mean = lambda c, where=None: F.avg(F.when(c, 1.0).otherwise(0.0) if where is None else F.when(where, F.when(c, 1.0).otherwise(0.0)))
    aggs = [F.count(F.lit(1)).alias("n"), mean(F.col("ok_a")).alias("acc_a"), mean(F.col("ok_b")).alias("acc_b"), mean(F.col("same")).alias("fidelity"), mean(F.col("ok_b"), ~F.col("same")).alias("override_right"), mean(~F.col("ok_a"), ~F.col("ok_b")).alias("errors_from_a"), F.avg("na").alias("findings_per_study"), mean(F.col("na") > 0).alias("abnormal")]
    return r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)


def vote_best(swept: DataFrame) -> DataFrame:
    """k, precision, recall and f1 of the best number of votes; of equals the smallest. swept: a row for each k."""
    best = swept.agg(F.max(F.struct("f1", (-F.col("k")).alias("u"), "precision", "recall")).alias("m"))
    return best.select((-F.col("m.u")).alias("k"), "m.precision", "m.recall", "m.f1")


def vote_best_of(counted: DataFrame, truth: DataFrame, on: str, most: int, junk, classes=tx.FINDINGS) -> DataFrame:
    """The best number of votes, and its scores with all classes ('all') and without the junk ones ('kept')."""
    best = vote_best(vote_sweep(counted, truth, on, most, classes=classes))
    kept = vote_sweep(counted, truth, on, most, classes=[c for c in classes if c not in junk]).join(best.select("k"), "k")
    return best.select(F.lit("all").alias("classes"), "*").unionByName(kept.select(F.lit("kept").alias("classes"), "*"))


def rung_scores(rows: DataFrame, by: str, truth: Column, pred: Column, tokens: str = "prompt_tokens", valid: Column | None = None, classes=tx.FINDINGS) -> DataFrame:
    """Of each arm or rung: n, median tokens, precision, recall and f1, accuracy, precision, recall and f1 of any acute finding, findings and false positives a study, share called abnormal, and share of valid answers."""
    t, p = sets.any_acute(truth), sets.any_acute(pred)
    one = lambda c: F.when(c, 1).otherwise(0)
    r = rows.select(by, *sets.confusion(truth, pred, classes), F.col(tokens).alias("tk"), F.size(pred).alias("found"), one(t & p).alias("btp"), one(~t & p).alias("bfp"), one(t & ~p).alias("bfn"), one(t == p).alias("same"), (F.lit(None).cast("double") if valid is None else F.when(valid, 1.0).otherwise(0.0)).alias("valid"))
    total = r.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("tk", F.lit(0.5)).alias("median_tokens"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "btp", "bfp", "bfn")], F.avg("same").alias("binary_accuracy"), F.avg("found").alias("findings_per_study"), F.avg("valid").alias("schema_valid"))
    n = F.col("n")
    return total.select(by, "n", "median_tokens", *sets.prf("tp", "fp", "fn"), "binary_accuracy", *[c.alias(f"binary_{k}") for c, k in zip(sets.prf("btp", "bfp", "bfn"), ("precision", "recall", "f1"), strict=True)], "findings_per_study", (F.col("fp") / n).alias("fp_per_study"), (F.col("fn") / n).alias("fn_per_study"), ((F.col("btp") + F.col("bfp")) / n).alias("abnormal"), "schema_valid")


def span(rungs: DataFrame, by: str, base: str, blank: str) -> DataFrame:
    """What the base rung has over the blank one: differences of f1 and of binary accuracy. rungs: a row for each rung."""
    at = lambda name, c: F.max(F.when(F.col(by) == name, F.col(c)))
    return rungs.agg(*[(at(base, c) - at(blank, c)).alias(f"span_{c}") for c in ("f1", "binary_accuracy")])


def difference_in_differences(rows: DataFrame, group: Column, before: Column, after: Column, tokens: Column) -> DataFrame:
    """n, means before and after, their difference and median tokens within (group true) and without, and did: the one difference less the other."""
    r = rows.select(group.alias("g"), before.cast("double").alias("x"), after.cast("double").alias("y"), tokens.alias("tk"))
    of = lambda c, g: F.avg(F.when(F.col("g") == g, c))
    d = F.col("y") - F.col("x")
    named = {}
    for name, g in (("in", True), ("out", False)):
        named |= {f"n_{name}": F.sum(F.when(F.col("g") == g, 1).otherwise(0)), f"before_{name}": of(F.col("x"), g), f"after_{name}": of(F.col("y"), g), f"delta_{name}": of(d, g), f"tokens_{name}": F.percentile(F.when(F.col("g") == g, F.col("tk")), F.lit(0.5))}
    return r.agg(*[c.alias(k) for k, c in named.items()]).withColumn("did", F.col("delta_in") - F.col("delta_out"))


def expert_scores(rows: DataFrame, pred: Column, references: dict[str, Column], levels: dict[str, tuple]) -> DataFrame:
    """level, reference, n, precision, recall and f1 of predictions against each reference (the expert, the report)."""
    each = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(k).alias("reference"), *sets.confusion(t, pred, classes)) for n, classes in levels.items() for k, t in references.items()])
    total = rows.select(F.explode(each).alias("v")).select("v.*").groupBy("level", "reference").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return total.select("level", "reference", "n", *sets.prf("tp", "fp", "fn"))


def arm_gates(a: DataFrame, b: DataFrame, rendered: DataFrame, base: DataFrame, uid: str = "uid") -> DataFrame:
    """gate, value and passed of a two-stage arm's checks over the studies that both stages have.

    a: uid, n_image_parts, prompt_tokens, primary_diagnosis, valid; b: uid, n_image_parts, stage_a_findings, valid; rendered:
    uid, parts; base: uid, prompt_tokens of the baseline arm. Studies that weren't rendered don't count in parts.
    """
    rows = a.select(uid, F.col("n_image_parts").alias("sent"), F.col("prompt_tokens").alias("tokens"), F.upper(F.trim("primary_diagnosis")).alias("dx"), F.col("valid").alias("valid_a"))
    rows = rows.join(b.select(uid, F.col("n_image_parts").alias("sent_b"), F.trim("stage_a_findings").alias("findings"), F.col("valid").alias("valid_b")), uid)
    rows = rows.join(rendered.select(uid, F.col("parts").alias("rendered")), uid, "left").join(base.select(uid, F.col("prompt_tokens").alias("tokens_0")), uid, "left")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    checks = {
        "parts": (F.when(F.col("rendered").isNotNull(), one(F.coalesce(F.col("sent") == F.col("rendered"), F.lit(False)))), 1.0),
        "tokens": (one(F.col("tokens") > 0), 1e-12),
        "deferred": (one(F.col("dx") == "DEFERRED"), 0.9),
        "findings": (one(F.coalesce(~F.col("findings").isin("", "{}", "nan"), F.lit(False))), 0.9),
        "text_only": (one(F.coalesce("sent_b", F.lit(0)) == 0), 1.0),
        "valid_a": (one(F.col("valid_a")), 0.9),
        "valid_b": (one(F.col("valid_b")), 0.9),
        "payload": (one(F.col("tokens") > F.col("tokens_0")), 0.9),
    }
    return gates(rows, checks)


def arm_scores(rows: DataFrame, by: tuple[str, ...], truth: Column, pred: Column, tokens: str = "prompt_tokens", parts: str = "n_image_parts", classes=tx.FINDINGS) -> DataFrame:
    """Of each arm: accuracy, counts per study, token use and parts."""
    r = rows.select(*by, sets.is_correct(pred, truth).alias("ok"), *sets.confusion(truth, pred, classes), F.col(tokens).alias("tk"), F.col(parts).alias("pt"))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("accuracy"), *[F.avg(k).alias(f"{k}_per_study") for k in ("tp", "fp", "fn")], F.avg("tk").alias("mean_tokens"), F.percentile("tk", F.lit(0.5)).alias("median_tokens"), F.avg("pt").alias("mean_parts"))


def factorial_effects(rows: DataFrame, uid: str, arm: str, value: Column, cells: tuple[str, str, str, str]) -> DataFrame:
    """n, visual and reasoning main effects and interaction over uids that have all four arms (neither, visual, reasoning, both)."""
    wide = rows.filter(F.col(arm).isin(*cells)).groupBy(uid).agg(*[F.avg(F.when(F.col(arm) == c, value)).alias(f"c{i}") for i, c in enumerate(cells)])
    full = wide.filter(" and ".join(f"c{i} is not null" for i in range(4)))
    c = [F.col(f"c{i}") for i in range(4)]
    return full.agg(F.count(F.lit(1)).alias("n"), F.avg(((c[1] - c[0]) + (c[3] - c[2])) / 2).alias("visual"), F.avg(((c[2] - c[0]) + (c[3] - c[1])) / 2).alias("reasoning"), F.avg((c[3] - c[2]) - (c[1] - c[0])).alias("interaction"))


def expert_cells(rows: DataFrame, called: Column, truth: Column, expert: Column) -> DataFrame:
    """By class: calls against the reference that an expert confirms, and those the expert denies."""
    disputed = rows.select(F.explode(F.array_except(called, truth)).alias("class"), expert.alias("e"))
    held = F.array_contains("e", F.col("class"))
    return disputed.groupBy("class").agg(F.count(F.lit(1)).alias("disputed"), F.sum(F.when(held, 1).otherwise(0)).alias("confirmed"), F.sum(F.when(held, 0).otherwise(1)).alias("refuted")).withColumn("incompleteness", F.col("confirmed") / F.col("disputed"))


def gates(rows: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """gate, value (mean of the check's column) and passed (at least its bound), from one pass over rows."""
    total = rows.agg(*[F.avg(c).alias(n) for n, (c, _) in checks.items()])
    each = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.coalesce(F.col(n) >= b, F.lit(False)).alias("passed")) for n, (_, b) in checks.items()])
    return total.select(F.explode(each).alias("g")).select("g.*")


def common_uids(rows: DataFrame, arm: str, arms: int, uid: str = "uid") -> DataFrame:
    """Uids that every arm has, by one aggregation."""
    return rows.groupBy(uid).agg(F.countDistinct(arm).alias("c")).filter(F.col("c") == arms).select(uid)


def diversity(rows: DataFrame, by: tuple[str, ...], text: str) -> DataFrame:
    """n, distinct texts, and mean, least and largest length."""
    size = F.length(F.coalesce(text, F.lit("")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64(text)).alias("distinct"), F.avg(size).alias("mean_chars"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars"))


def top_texts(rows: DataFrame, by: tuple[str, ...], text: str, most: int = 5) -> DataFrame:
    """groups, place, text and n of the most frequent texts of each group; equally frequent ones in order of the text.

    Texts are counted first; of each of 64 salts of a group only the first `most` go on.
    """
    counts = rows.groupBy(*by, F.coalesce(text, F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n")).withColumn("__salt", F.pmod(F.xxhash64("text"), F.lit(64)))
    place = lambda *on: F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("n"), "text"))
    some = counts.withColumn("place", place(*by, "__salt")).filter(F.col("place") <= most)
    return some.withColumn("place", place(*by)).filter(F.col("place") <= most).select(*by, "place", "text", "n")


def answer_patterns(rows: DataFrame, by: tuple[str, ...], pred: str = "pred", classes=tx.FINDINGS) -> DataFrame:
    """groups, n, distinct patterns of yes and no over the classes, and the share of cells with yes."""
    held = F.array_intersect(pred, literal(classes))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.array_sort(held)).alias("patterns"), (F.sum(F.size(held)) / (F.count(F.lit(1)) * len(classes))).alias("yes_rate"))


def spread_of_dimensions(rows: DataFrame, by: tuple[str, ...], vec: str = "vec", least: float = 1e-6) -> DataFrame:
    """groups, dims, sd (mean over the dimensions of the deviation between rows) and constant: whether it is no more than least."""
    each = rows.select(*by, F.posexplode(vec).alias("dim", "v")).groupBy(*by, "dim").agg(F.stddev_pop(F.col("v").cast("double")).alias("sd"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("dims"), F.avg("sd").alias("sd"), (F.avg("sd") <= least).alias("constant"))


def judge_agreement(scores: DataFrame, keys: list[str], judges: tuple[str, str], by: tuple[str, ...], judge: str = "judge_id", score: str = "score") -> DataFrame:
    """groups, n, agreement, kappa and far_apart (more than 1 apart) of two judges over the rows that both scored; the judges are brought together by one grouping on the keys."""
    both = scores.filter(F.col(judge).isin(*judges)).groupBy(*keys).agg(*[F.max(F.when(F.col(judge) == j, F.col(score))).alias(c) for j, c in zip(judges, "xy", strict=True)]).filter("x is not null and y is not null")
    pairs = both.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c"))  # at most a row for each pair of scores
    one = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    total = pairs.groupBy(*by).agg(F.sum("c").alias("n"), one(F.col("x") == F.col("y")).alias("same"), one(F.abs(F.col("x") - F.col("y")) > 1).alias("far_apart"))
    margins = pairs.select(*by, "c", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("x").alias("s")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("y").alias("s")))).alias("m")).groupBy(*by, "m.s").agg(F.sum(F.col("c") * F.col("m.a")).alias("nx"), F.sum(F.col("c") * F.col("m.b")).alias("ny"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance, list(by)).select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"), "far_apart")


def class_weights(labels: DataFrame, cap: float = 20.0) -> DataFrame:
    """By class: negatives over positives, at most cap."""
    n1 = F.sum(F.when(F.col("y") == 1, 1).otherwise(0))
    return labels.groupBy("class").agg(F.least(F.lit(cap), (F.count(F.lit(1)) - n1) / F.greatest(F.lit(1), n1)).alias("weight"))


def drop_groups(counts: list[tuple[str, int, int, int]]) -> list[str]:
    """Greedily drops the group whose loss raises micro f1 most, while any does. Works on the few rows of a table of groups."""
    f1 = lambda xs: 2 * sum(x[1] for x in xs) / max(1, sum(2 * x[1] + x[2] + x[3] for x in xs))
    kept, dropped = sorted(counts), []
    while len(kept) > 1:
        best = max(kept, key=lambda x: (f1([y for y in kept if y != x]), x[0]))
        if f1([y for y in kept if y != best]) <= f1(kept) + 1e-12:
            break
        kept.remove(best)
        dropped.append(best[0])
    return dropped
