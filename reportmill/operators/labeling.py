"""Report labels, difficulty and agreement of labelers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.text import class_ranks, classes_with, literal, scrubbed_share, sentences


def label_texts(df: DataFrame, text: str, patterns: dict[str, str] | None = None, negation: str = tx.NEGATION, hedge: str = tx.HEDGE, denied: str = tx.DENIED_AFTER, plain: str = tx.NORMAL) -> DataFrame:
    """df with pos, unc and neg (classes by state), no_finding (1, 0 or null) and hedged, from the text column, by a lexicon of classes and cues (patterns; plain: of texts without a finding).

    All of a text's sentences are looked at within its row, so nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("__s", sentences(t)).withColumn("__r", class_ranks(F.col("__s"), patterns, negation, hedge, denied))
    rows = rows.withColumns({"pos": classes_with(F.col("__r"), 3), "unc": classes_with(F.col("__r"), 2), "neg": classes_with(F.col("__r"), 1), "hedged": t.rlike(hedge)})
    normal = (F.size("pos") == 0) & (F.size("unc") == 0) & t.rlike(plain)
    return rows.withColumn("no_finding", F.when(normal, 1).when(F.size("pos") > 0, 0)).drop("__s", "__r")


def long_labels(labelled: DataFrame, labeler: str) -> DataFrame:
    """uid, labeler, class and state (1, 0, -1) of the classes mentioned."""
    state = lambda c, v: F.transform(F.col(c), lambda x: F.struct(x.alias("class"), F.lit(v).cast("tinyint").alias("state")))
    return labelled.select("uid", F.explode(F.concat(state("pos", 1), state("neg", 0), state("unc", -1))).alias("l")).select("uid", F.lit(labeler).alias("labeler"), "l.class", "l.state")


def wide_labels(labels: DataFrame, classes=tx.FINDINGS, prefix: str = "lbl_") -> DataFrame:
    """A column for each class; null where it isn't mentioned."""
    return labels.groupBy("uid").pivot("class", list(classes)).agg(F.max("state")).select("uid", *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in classes])


def prevalence(labelled: DataFrame, classes=tx.FINDINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares of positive, uncertain, negative and unmentioned reports for each class."""
    state = lambda c: F.when(F.array_contains("pos", c), 1).when(F.array_contains("unc", c), -1).when(F.array_contains("neg", c), 0)
    cells = labelled.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), state(c).alias("state")) for c in classes])).alias("c")).select(*by, "c.class", "c.state")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return cells.groupBy(*by, "class").agg(share(F.col("state") == 1).alias("positive"), share(F.col("state") == -1).alias("uncertain"), share(F.col("state") == 0).alias("negative"), share(F.col("state").isNull()).alias("unmentioned"))


def difficulty(positive: Column, uncertain: Column, hedged: Column, no_finding: Column, problems: Column, mesh: Column, density: Column, rare=tx.RARE) -> Column:
    """Stratum of a study, from its report's labels and its tags."""
    tags = F.lower(F.concat_ws(" ", F.coalesce(problems, F.lit("")), F.coalesce(mesh, F.lit(""))))
    tags_normal = tags.contains("normal") & ~tags.contains("no indexing")
    labels_normal = (F.coalesce(no_finding, F.lit(0)) == 1) | ((F.size(positive) == 0) & (F.size(uncertain) == 0))
    n = F.size(positive)
    return (
        F.when(hedged | (F.size(uncertain) > 0) | (tags_normal != labels_normal) | (density > 0.15), "ambiguous")
        .when(F.arrays_overlap(positive, literal(rare)), "rare")
        .when(labels_normal, "easy_normal")
        .when(n >= 3, "hard_multi")
        .when(n == 1, "easy_abnormal")
        .otherwise("intermediate")
    )


def stratify(labelled: DataFrame, text: str = "report_text") -> DataFrame:
    rows = labelled.withColumn("density", scrubbed_share(F.col(text)))
    return rows.withColumn("difficulty", difficulty(F.col("pos"), F.col("unc"), F.col("hedged"), F.col("no_finding"), F.col("problems"), F.col("mesh"), F.col("density")))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa, share of agreement and n for each class over the cells that both labelers have."""
    cells = labels.filter(F.col("labeler").isin(a, b)).groupBy("uid", "class").agg(F.max(F.when(F.col("labeler") == a, F.col("state"))).alias("x"), F.max(F.when(F.col("labeler") == b, F.col("state"))).alias("y"))
    # Pre-aggregated to the counts of pairs of states, at most 9 for each class.
    pairs = cells.filter("x is not null and y is not null").groupBy("class", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    total = pairs.groupBy("class").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    margins = pairs.select("class", "c", F.explode(F.array(F.struct(F.lit("x").alias("w"), F.col("x").alias("s")), F.struct(F.lit("y").alias("w"), F.col("y").alias("s")))).alias("m")).groupBy("class", "m.s").agg(F.sum(F.when(F.col("m.w") == "x", F.col("c")).otherwise(0)).alias("nx"), F.sum(F.when(F.col("m.w") == "y", F.col("c")).otherwise(0)).alias("ny"))
    chance = margins.groupBy("class").agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance, "class").select("class", "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def reference_confidence(labels: DataFrame, labelers: list[str], uids: DataFrame, classes=tx.FINDINGS) -> DataFrame:
    """uid, class, each labeler's state, consensus, agreement and confidence (HIGH, MEDIUM, LOW) of every cell; a class not mentioned counts as absent."""
    n = len(labelers)
    seen = labels.filter(F.col("labeler").isin(labelers)).groupBy("uid", "class").agg(*[F.max(F.when(F.col("labeler") == x, F.col("state"))).alias(x) for x in labelers])
    cells = uids.select("uid", F.explode(literal(classes)).alias("class")).join(seen, ["uid", "class"], "left")
    return with_confidence(cells, labelers).drop("pos_votes", "committed") if n else cells


def with_confidence(cells: DataFrame, labelers: list[str]) -> DataFrame:
    n = len(labelers)
    named = lambda c: F.when(F.col(c) == 1, "PRESENT").when(F.col(c) == -1, "UNCERTAIN").otherwise("ABSENT")
    rows = cells.withColumns({x: named(x) for x in labelers})
    votes = lambda v: sum((F.when(F.col(x) == v, 1).otherwise(0) for x in labelers), F.lit(0))
    pos, neg = votes("PRESENT"), votes("ABSENT")
    committed, agree = pos + neg, F.greatest(pos, neg)
    consensus = F.when(committed == n, F.when(pos >= neg, "PRESENT").otherwise("ABSENT")).otherwise(F.when(pos > neg, "PRESENT").when(neg > pos, "ABSENT").otherwise("UNCERTAIN"))
    level = F.when(committed == n, F.when(agree == n, "HIGH").when(agree >= (n + 1) // 2, "MEDIUM").otherwise("LOW")).otherwise(F.when((agree == committed) & (agree >= 2), "MEDIUM").otherwise("LOW"))
    return rows.withColumns({"consensus": consensus, "agreement": F.concat(agree.cast("string"), F.lit(f"/{n}")), "confidence": level})


def positive_agreement(rows: DataFrame, a: str, b: str, classes=tx.FINDINGS) -> DataFrame:
    """class, n, agreement and kappa of two labelers' positive sets (array columns) over all cells; counted in one pass, nothing is shuffled but a row of counts."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(classes) for x in (one(F.array_contains(a, c) & F.array_contains(b, c)).alias(f"both{i}"), one(F.array_contains(a, c)).alias(f"a{i}"), one(F.array_contains(b, c)).alias(f"b{i}"))])
    each = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{k}{i}").alias(k) for k in ("both", "a", "b")]) for i, c in enumerate(classes)])).alias("c")).select("n", "c.*")
    n = F.col("n").cast("double")
    po = (n - F.col("a") - F.col("b") + 2 * F.col("both")) / n
    pe = (F.col("a") * F.col("b") + (n - F.col("a")) * (n - F.col("b"))) / (n * n)
    return each.select("class", "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def agreement_summary(rows: DataFrame, a: str, b: str, classes=tx.FINDINGS) -> DataFrame:
    """mean_kappa over the classes, exact (share of equal positive sets), and micro precision, recall and f1 of a against b. Two passes, two rows joined."""
    from ..functions.sets import confusion, prf

    kappa = positive_agreement(rows, a, b, classes).agg(F.avg("kappa").alias("mean_kappa"))
    total = rows.select(F.when(F.array_sort(a) == F.array_sort(b), 1.0).otherwise(0.0).alias("same"), *confusion(F.col(b), F.col(a), classes)).agg(F.avg("same").alias("exact"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return kappa.crossJoin(total.select("exact", *prf("tp", "fp", "fn")))  # a row each


#: Levels of confidence from the least.
LEVELS = ("LOW", "MEDIUM", "HIGH")


def level_rows(level: Column) -> Column:
    """Array of (level, cumulative) that a cell of this confidence counts in: its own, and every level not above it."""
    exact = F.array(F.struct(level.alias("level"), F.lit(False).alias("cumulative")))
    upto = F.filter(F.array(*[F.lit(x) for x in LEVELS]), lambda x: F.array_position(F.array(*[F.lit(v) for v in LEVELS]), x) <= F.array_position(F.array(*[F.lit(v) for v in LEVELS]), level))
    return F.concat(exact, F.transform(upto, lambda x: F.struct(x.alias("level"), F.lit(True).alias("cumulative"))))
