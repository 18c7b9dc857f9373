"""Sampling, zones, paired statistics, resampling and thresholds."""

import math
import random
import statistics
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.operators import pairstats, ranks, readout, resampling, sampling, sums, zones
from reportmill.sources import studies


def test_draws(spark):
    rows = spark.createDataFrame([(i, "a" if i < 700 else "b" if i < 990 else None) for i in range(1000)], "doc_id long, g string")
    parts = {r.doc_id: (r.g, r.split) for r in sampling.split(rows, "g", 50, 0.18, "s", "d").collect()}
    n = lambda g, s: sum(x == (g, s) for x in parts.values())
    assert len(parts) == 1000 and n("a", "test") == 50 and n("b", "test") == 50 and n(None, "test") == 10
    assert n("a", "dev") == int(0.18 * 650) and n("b", "dev") == int(0.18 * 240)
    again = {r.doc_id: (r.g, r.split) for r in sampling.split(rows.repartition(13), "g", 50, 0.18, "s", "d").collect()}
    assert again == parts
    train = sampling.balanced(rows, F.col("doc_id") % 10 == 0, 2.0, 3, "t").groupBy(F.col("doc_id") % 10 == 0).count().collect()
    assert sorted(r["count"] for r in train) == [200, 300]


def test_zones(spark):
    tags = ["Consolidation/lung/base/left;Opacity/lung/apex/right", "Opacity/lung/apex/right/irregular", "Density/cardiophrenic angle/left", "Cardiomegaly/borderline", "Opacity/lung/bilateral", "", None]
    rows = spark.createDataFrame(list(enumerate(tags)), "uid long, mesh string").select("uid", zones.tag_zone(F.col("mesh")).alias("zone"))
    assert [r.zone for r in rows.orderBy("uid").collect()] == ["lower/left", "upper/right", "mid/left", None, None, None, None]
    given = {r.uid: (r.zone, r.source) for r in zones.assign(rows, "s").collect()}
    assert len(given) == 7 and given[0] == ("lower/left", "localizable") and given[3][1] == "assigned" and given[3][0] in zones.ALL
    wrong = zones.assign_wrong(rows, "s").collect()
    assert sorted(r.uid for r in wrong) == [0, 1, 2] and all(r.own != r.zone for r in wrong)
    box = {r.zone: r for r in zones.boxes(spark.createDataFrame([(300, 300)], "w int, h int"), "w", "h").collect()}
    assert box["upper/right"].x0 == 0 and box["upper/left"].x1 == 300 and box["upper/right"].x1 < box["upper/left"].x1
    assert box["upper/right"].y0 < box["mid/right"].y0 < box["lower/right"].y0 < box["mid/right"].y1


def test_studies_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('uid,MeSH,Problems,image,indication,comparison,findings,impression\n1,m,p,i,ind,,"two\nlines, ""quoted""",imp\n2,,,,,,,\n3,,,,,,x,\n')
    (tmp_path / "p.csv").write_text("uid,filename,projection\n1,b.png,Frontal\n1,a.png,Frontal\n1,c.png,Lateral\n2,d.png,Frontal\n")
    (row,) = studies.load_studies(spark, str(tmp_path / "r.csv"), str(tmp_path / "p.csv")).collect()
    assert row.uid == 1 and row.report_text == 'two\nlines, "quoted" imp' and row.frontal_paths == ["a.png", "b.png"] and row.n_images == 3
    (tmp_path / "e.csv").write_text("uid,label_Edema,label_Fracture\n1,Present, absent\n2,,uncertain\n")
    got = sorted((r.uid, r["class"], r.presence) for r in studies.read_expert_labels(spark, str(tmp_path / "e.csv")).collect())
    assert got == [(1, "Edema", "present"), (1, "Fracture", "absent"), (2, "Fracture", "uncertain")]
    studies.write_table(spark.createDataFrame(got, "uid long, c string, p string"), str(tmp_path / "out"), by="c")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bin").write_bytes(b"abc")
    assert studies.read_parts(spark, str(tmp_path / "img")).first().sha256.startswith("ba7816bf")


def paired_rows(n=60, seed=1):
    pick = random.Random(seed)
    return [(u, c, int(pick.random() < p), round(pick.gauss(p, 1), 2)) for u in range(n) for c, p in (("a", 0.3), ("b", 0.6), ("c", 0.6)) if not (c == "c" and u % 7 == 0)]


def test_mcnemar(spark):
    rows = paired_rows()
    df = spark.createDataFrame(rows, "uid long, prompt_condition string, ok int, v double")
    full = [u for u in range(60) if u % 7]
    value = {(u, c): o for u, c, o, _ in rows}
    for r in pairstats.mcnemar(df, ["a", "b", "c"], "ok").collect():
        n01 = sum(value[u, r.a] == 0 and value[u, r.b] == 1 for u in full)
        n10 = sum(value[u, r.a] == 1 and value[u, r.b] == 0 for u in full)
        assert (r.n, r.n01, r.n10) == (len(full), n01, n10) and 0 < r.p_value <= r.p_fdr <= 1
    assert pairstats.binomial_p(1, 5) == pytest.approx(0.375) and pairstats.chi_square_p(3.841459) == pytest.approx(0.05, abs=1e-5)


def test_mcnemar_without_discordant_pairs_and_best(spark):
    same = spark.createDataFrame([(u, c, u % 2) for u in range(40) for c in "ab"], "uid long, prompt_condition string, ok int")
    for least in (0, 25):
        (r,) = pairstats.mcnemar(same, ["a", "b"], "ok", exact_below=least).collect()
        assert (r.n01, r.n10, r.statistic, r.p_value, r.p_fdr) == (0, 0, 0.0, 1.0, 1.0)
    rows = [(u, c, int(u < k)) for u in range(40) for c, k in (("a", 10), ("b", 30), ("c", 30))]
    got = {r.condition: r for r in pairstats.mcnemar_best(spark.createDataFrame(rows, "uid long, prompt_condition string, ok int"), ["a", "b", "c"], "b", "ok").collect()}
    assert (got["a"].wins, got["a"].losses, got["a"].significant) == (20, 0, True) and got["a"].p_value == pytest.approx(math.erfc(math.sqrt(19**2 / 20 / 2)))
    assert (got["c"].wins, got["c"].losses, got["c"].p_value) == (0, 0, 1.0)


def test_wilcoxon_and_delta(spark, monkeypatch):
    rows = paired_rows()
    df = spark.createDataFrame(rows, "uid long, prompt_condition string, ok int, v double")
    value = {(u, c): v for u, c, _, v in rows}
    for few in (200_000, 0):  # one window, and running sums by ranges
        monkeypatch.setattr(ranks, "FEW_VALUES", few)
        got = {(r.a, r.b): r for r in pairstats.wilcoxon(df, ["a", "b", "c"], "v").collect()}
        told = {(r.a, r.b): r for r in pairstats.signed_ranks(df, ["a", "b", "c"], "v").collect()}
        for a, b in combinations("abc", 2):
            both = [(value[u, a], value[u, b]) for u in range(60) if (u, a) in value and (u, b) in value]
            d = [x - y for x, y in both if x != y]
            rank = lambda m: sum(abs(x) < m for x in d) + (sum(abs(x) == m for x in d) + 1) / 2
            assert told[a, b].w_plus == pytest.approx(sum(rank(abs(x)) for x in d if x > 0)) and (told[a, b].pairs, told[a, b].n) == (len(both), len(d))
            assert told[a, b].w_plus + told[a, b].w_minus == pytest.approx(len(d) * (len(d) + 1) / 2)
            delta = sum((x > y) - (x < y) for x, _ in both for _, y in both) / len(both) ** 2
            assert got[a, b].delta == pytest.approx(delta) and 0 < got[a, b].p_value <= 1
            assert got[a, b].median_a == pytest.approx(statistics.median(x for x, _ in both))
    assert pairstats.wilcoxon_p(6, 6, 21, 0, 0) == pytest.approx(2 / 64)
    # A zero among the pairs: normal, not exact.
    assert pairstats.wilcoxon_p(7, 6, 21, 0, 0) == pytest.approx(math.erfc(10.5 / math.sqrt(6 * 7 * 13 / 24) / math.sqrt(2)))
    assert pairstats.wilcoxon_p(4, 4, 10, 0, 0) == 1.0 and pairstats.wilcoxon_p(10, 4, 10, 0, 0) < 1.0


def test_wilcoxon_has_a_row_for_pairs_without_a_difference(spark):
    rows = [(u, c, float(u + (c == "c" and u < 4))) for u in range(10) for c in "abc"] + [(100 + u, c, float(u)) for u in range(3) for c in "d"]
    got = {(r.a, r.b): r for r in pairstats.wilcoxon(spark.createDataFrame(rows, "uid long, prompt_condition string, v double"), list("abcd"), "v").collect()}
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert (got["a", "b"].pairs, got["a", "b"].statistic, got["a", "b"].p_value, got["a", "b"].delta) == (10, None, 1.0, 0.0)
    assert got["a", "c"].p_value == pytest.approx(math.erfc(5 / math.sqrt(4 * 5 * 9 / 24 - 60 / 48) / math.sqrt(2))) and got["a", "c"].p_fdr > got["a", "c"].p_value


def test_paired_dissociation(spark):
    rows = [(u, c, u % 7 + (c == "b") * (1 + u % 3), u % 5 + (c == "c") * (1 + u % 2)) for u in range(40) for c in "abc"]
    got = {r.prompt_condition: r for r in pairstats.paired_dissociation(spark.createDataFrame(rows, "uid long, prompt_condition string, coherent int, faithful int"), "a", list("abc"), ["coherent"], ["faithful"]).collect()}
    assert got["b"].persuasive_up and not got["b"].faithful_up and got["b"].dissociation and got["b"].p_faithful is None
    assert got["c"].faithful_up and not got["c"].dissociation and got["b"].d_coherent == pytest.approx(sum(1 + u % 3 for u in range(40)) / 40)


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03]
    got = [r.p_fdr for r in pairstats.fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double"), [], "p").orderBy("i").collect()]
    order = sorted(range(6), key=lambda i: p[i])
    want, least = [0.0] * 6, 1.0
    for k in range(5, -1, -1):
        least = min(least, p[order[k]] * 6 / (k + 1))
        want[order[k]] = least
    assert got == pytest.approx(want)


def test_bootstrap_is_the_same_with_any_partitioning(spark):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(400)], "uid long, x double, y double")
    stat = (F.col("x") - F.col("y")) / F.col("n")
    a, b = (resampling.interval(resampling.replicate_sums(r, "uid", ["x", "y"], 400, seed=3), stat).first() for r in (rows.coalesce(1), rows.repartition(7)))
    assert tuple(a) == pytest.approx(tuple(b)) and a.point == pytest.approx(sum(i % 5 - i % 3 for i in range(400)) / 400)
    assert a.ci_low < a.point < a.ci_high and abs((a.ci_high - a.ci_low) / 3.92 - 1.62 / 20) < 0.02


def test_random_intercept(spark):
    pick = random.Random(2)
    rows = []
    for u in range(400):
        level = pick.gauss(0, 1)
        rows += [(u, 2.0 + 0.5 * x + level + pick.gauss(0, 0.5), 1, x) for x in (0, 0, 1, 1)[: pick.randint(2, 4)]]
    fit = {t: (e, s) for t, e, s in resampling.random_intercept(spark.createDataFrame(rows, "uid long, y double, one int, x int"), ["one", "x"], "y")}
    assert fit["x"][0] == pytest.approx(0.5, abs=0.1) and fit["one"][0] == pytest.approx(2.0, abs=0.2)
    assert fit["residual variance"][0] == pytest.approx(0.25, abs=0.05) and fit["intercept variance"][0] == pytest.approx(1.0, abs=0.2)


def score_rows(spark, n=300):
    pick = random.Random(6)
    rows = [(i, c, round(pick.random() + (0.3 if y else 0), 2), y) for i in range(n) for c in (0, 1) for y in [int(pick.random() < 0.3)]]
    return rows, spark.createDataFrame(rows, "uid long, class int, score double, y int")


def test_auroc_and_thresholds(spark):
    rows, df = score_rows(spark)
    for r in readout.auroc(df, ["class"]).collect():
        pos, neg = ([s for _, c, s, y in rows if c == r["class"] and y == v] for v in (1, 0))
        assert r.auroc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    for r in readout.f1_threshold(df, ["class"]).collect():
        own = [(s, y) for _, c, s, y in rows if c == r["class"]]
        f1 = lambda t: 2 * sum(y for s, y in own if s >= t) / (sum(s >= t for s, _ in own) + sum(y for _, y in own))
        assert r.f1 == pytest.approx(max(f1(s) for s, _ in own)) == pytest.approx(f1(r.threshold))
    calls = df.filter("uid < 40")
    for c in (0, 1):
        got = sorted(r.uid for r in readout.matched_calls(df, calls, ["class"]).filter(F.col("class") == c).collect())
        own = sorted(((-s, u) for u, k, s, _ in rows if k == c))[:40]
        assert got == sorted(u for _, u in own)


def test_prior_shift():
    pick = random.Random(1)
    p = []
    for _ in range(20_000):
        y = pick.random() < 0.1
        s = pick.gauss(1.5 if y else 0, 1)
        odds = math.exp(1.5 * s - 1.125)  # exact under a prior of one half
        p.append(round(odds / (1 + odds), 4))
    bins = [(x, p.count(x)) for x in set(p)]
    assert readout.em_prior(bins, 0.5) == pytest.approx(0.1, abs=0.02)


def test_feature_tables(spark):
    rows = spark.createDataFrame([(1, "b", [3.0]), (1, "a", [1.0, 2.0]), (2, "a", [9.0, 9.0])], "uid long, site string, vec array<double>")
    (row,) = studies.load_features(rows, ["a", "b"]).collect()
    assert row.uid == 1 and row.vec == [1.0, 2.0, 3.0]
    pooled = readout.pool_tokens(spark.createDataFrame([(1, [1.0, 4.0]), (1, [3.0, 0.0])], "uid long, vec array<double>"), ["uid"]).first()
    assert pooled.vec == [2.0, 2.0, 3.0, 4.0]
    codes = spark.createDataFrame([(1, 0, 3), (2, 1, 2)], "uid long, Edema int, Fracture int")
    got = sorted((r.uid, r["class"], r.state) for r in studies.external_labels(codes, "x").collect() if r.state is not None)
    assert got == [(1, "Fracture", -1), (2, "Edema", 1), (2, "Fracture", 0)]


def test_running_sums_by_ranges(spark, monkeypatch):
    pick = random.Random(3)
    rows = [(g, pick.randrange(500) / 7, pick.randrange(1, 4)) for g in "abc" for _ in range(400)]
    bins = spark.createDataFrame(rows, "g string, s double, n int").groupBy("g", "s").agg(F.sum("n").alias("n"))
    plain = {(r.g, r.s): (r.upto_n, r.all_n) for r in ranks.running(bins, ["g"], ["n"]).collect()}
    monkeypatch.setattr(ranks, "FEW_VALUES", 0)
    assert {(r.g, r.s): (r.upto_n, r.all_n) for r in ranks.running(bins, ["g"], ["n"]).collect()} == plain
    for (g, s), (upto, total) in plain.items():
        assert upto == sum(n for h, t, n in rows if h == g and t >= s) and total == sum(n for h, _, n in rows if h == g)
    whole = ranks.running(bins.groupBy("s").agg(F.sum("n").alias("n")), [], ["n"]).collect()
    assert max(r.upto_n for r in whole) == sum(n for _, _, n in rows) == whole[0].all_n


def area(pos, neg, wp, wn):
    net = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in zip(pos, wp) for y, b in zip(neg, wn))
    return net / sum(wp) / sum(wn) if sum(wp) and sum(wn) else None


def test_auroc_replicates_as_by_hand(spark):
    pick = random.Random(5)
    rows = [(u, c, int(pick.random() < 0.3), pick.randrange(20) / 10, pick.randrange(20) / 10) for u in range(60) for c in ("x", "y")]
    got = {r.replicate: r for r in resampling.auroc_replicates(spark.createDataFrame(rows, "uid long, class string, y int, a double, b double").repartition(3), "uid", ["a", "b"], 20, least=5).collect()}
    keys = {r.uid: r.k for r in spark.range(60).withColumnRenamed("id", "uid").select("uid", F.xxhash64("uid").alias("k")).collect()}
    w = resampling.poisson_weights(np.array([keys[u] for u in range(60)]), 20, 0)
    for r in range(20):
        part = lambda c, s, y: ([x[s] for x in rows if x[1] in c and x[2] == y], [w[x[0], r] for x in rows if x[1] in c and x[2] == y])
        of = lambda c, s: area(part(c, s, 1)[0], part(c, s, 0)[0], part(c, s, 1)[1], part(c, s, 0)[1])
        assert got[r].pooled_a == pytest.approx(of("xy", 3)) and got[r].pooled_b == pytest.approx(of("xy", 4))
        counted = [c for c in "xy" if sum(part(c, 3, 1)[1]) >= 5]
        assert got[r].macro_a == pytest.approx(sum(of(c, 3) for c in counted) / len(counted))


def probe_rows(spark, n=400):
    pick = random.Random(9)
    rows = []
    for u in range(n):
        label = u % 3
        rows.append((u, label, "train" if u % 10 < 6 else "dev" if u % 10 < 8 else "test", [pick.gauss(label == 1, 1), pick.gauss(2 * (label == 2), 1), pick.gauss(0, 3)]))
    return spark.createDataFrame(rows, "uid long, label int, split string, vec array<double>")


def test_probe_fits_all_classes_at_once(spark):
    df = probe_rows(spark)
    got = readout.probe(df, [0, 1, 2, 7], c_grid=(0.01, 1.0))
    quality = {r["class"]: r.auroc for r in readout.auroc(got.filter("split = 'test'").withColumnRenamed("p", "score"), ["class"]).collect()}
    assert sorted(quality) == [0, 1, 2] and quality[2] > 0.8 and got.filter("class = 7 and p != 0.5").count() == 0
    # The optimum: the gradient of the balanced, penalised loss vanishes, for a class by itself.
    train = df.filter("split = 'train'").select("vec", F.when(F.col("label") == 2, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("hot"))
    x = np.array([[*r.vec, 1.0] for r in train.collect()])
    y = np.array([len(r.hot) for r in train.collect()])
    w = readout.fit_logistic(train, 1, (0.5,))[0, 0]
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    slope = ((1 / (1 + np.exp(-x @ w)) - y) * weight) @ x + np.r_[w[:-1], 0] / 0.5
    assert np.abs(slope / len(y)).max() < 1e-4


def test_shuffled_null(spark):
    got = {r["class"]: r for r in readout.shuffled_null(probe_rows(spark), [0, 1, 2], shuffles=12).collect()}
    assert got[2].auroc > got[2].null_hi and got[2].perm_p == pytest.approx(1 / 13) and all(0.3 < r.null_mean < 0.7 and r.null_lo <= r.null_mean <= r.null_hi for r in got.values())


# ---- Cutoffs, quantiles, false discovery rates ----


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "uid long, class string, score double, y int")


def test_cutoffs_that_call_nothing(spark):
    """A class without positives, one without mass, one of a single cell, beside a usual one."""
    pick = random.Random(3)
    rows = [(u, "usual", round(pick.random(), 2), int(u % 4 == 0)) for u in range(40)] + [(u, "none", round(pick.random(), 2), 0) for u in range(40)] + [(u, "massless", 0.0, 0) for u in range(5)] + [(1, "single", 0.4, 1)]
    df = cells_of(spark, rows)
    of = lambda found: {r["class"]: r for r in found.collect()}
    scores = lambda c: [r[2] for r in rows if r[1] == c]
    f1 = of(readout.f1_threshold(df, ["class"]))
    assert f1["none"].threshold == max(scores("none")) + 1 and f1["massless"].threshold == 1.0 and f1["single"].threshold == 0.4
    prevalence = of(readout.prevalence_threshold(df, df, ["class"]))
    assert prevalence["none"].k == 0 and prevalence["none"].threshold == max(scores("none")) + 1
    assert prevalence["usual"].k == 10 and prevalence["usual"].threshold == sorted(scores("usual"))[-10]
    expected = of(readout.expected_f1_threshold(df, ["class"]))
    assert (expected["massless"].k, expected["massless"].threshold, expected["massless"].expected_f1) == (0, 1.1, 0.0)
    quantile = of(readout.quantile_threshold(df, ["class"]))
    assert quantile["none"].threshold == quantile["massless"].threshold == 0.5 and quantile["single"].threshold == 0.4
    for name, cut in (("f1", f1), ("prevalence", prevalence)):
        called = readout.apply_threshold(df, spark.createDataFrame([(c, r.threshold) for c, r in cut.items()], "class string, threshold double"), ["class"])
        assert called.filter("class in ('none', 'massless') and called = 1").count() == 0, name


@pytest.mark.parametrize("few", [200_000, 0])
def test_quantiles_as_numpy(spark, monkeypatch, few):
    """Also with groups cut into ranges: no cutoff is rounded, and one that lies on a score is that score."""
    monkeypatch.setattr(ranks, "FEW_VALUES", few)
    monkeypatch.setattr(ranks, "RANGES", 8)
    pick = random.Random(8)
    groups = {"many": [pick.random() for _ in range(700)], "tied": [pick.choice([0.1, 0.2, 1 / 3]) for _ in range(300)], "two": [0.1, 0.7], "one": [0.3]}
    bins = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, s double").groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.i): r for r in ranks.quantiles(bins, ["g"], 200).collect()}
    assert len(got) == 4 * 201
    for g, v in groups.items():
        for i in range(201):
            r, want = got[g, i], np.quantile(v, i / 200)
            assert r.t == pytest.approx(want, abs=1e-12)
            assert r.upto_n == sum(x >= r.t for x in v) and r.all_n == len(v)
            if i * (len(v) - 1) % 200 == 0:
                assert r.t == sorted(v)[i * (len(v) - 1) // 200]


@pytest.mark.parametrize("few", [200_000, 0])
def test_fdr_by_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_VALUES", few)
    monkeypatch.setattr(ranks, "RANGES", 8)
    pick = random.Random(4)
    rows = [(f, pick.choice([1.0, pick.random() ** 3, round(pick.random(), 1)])) for f in ("a", "a", "b", None) for _ in range(150)] + [("a", None), ("c", 0.2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, p double")
    got = {r.i: r.p_fdr for r in pairstats.fdr(df, ["f"], "p").collect()}
    assert len(got) == len(rows)
    for f in {f for f, _ in rows}:
        own = sorted((p, i) for i, (g, p) in enumerate(rows) if g == f and p is not None)
        least = 1.0
        for at in range(len(own), 0, -1):
            least = min(least, own[at - 1][0] * len(own) / at)
            assert got[own[at - 1][1]] == pytest.approx(least, abs=1e-12)
    assert got[rows.index(("a", None))] is None


def test_auroc_replicates_with_many_scores_and_a_filled_range(spark):
    """Replicate 0 is the AUROC, however many scores there are; a score of a third of all cells is dealt over several tasks."""
    pick = random.Random(6)
    rows = [(u, "xy"[u % 2], int(pick.random() < 0.2), 0.25 if pick.random() < 0.35 else pick.gauss(0, 1), pick.random()) for u in range(10_000)]
    df = spark.createDataFrame(rows, "uid long, class string, y int, a double, b double").repartition(6)
    got = {r.replicate: r for r in resampling.auroc_replicates(df, "uid", ["a", "b"], 3, ranges=16, salts=4).collect()}
    assert sorted(got) == [0, 1, 2]
    for s in "ab":
        cells = df.select("class", F.col(s).alias("score"), "y")
        assert got[0][f"pooled_{s}"] == pytest.approx(readout.auroc(cells, []).first().auroc, abs=1e-12)
        assert got[0][f"macro_{s}"] == pytest.approx(np.mean([r.auroc for r in readout.auroc(cells, ["class"]).collect()]), abs=1e-12)
    other = {r.replicate: r for r in resampling.auroc_replicates(df.repartition(3), "uid", ["a", "b"], 3, ranges=5, salts=2).collect()}
    assert all(other[r][c] == pytest.approx(got[r][c], abs=1e-12) for r in got for c in ("pooled_a", "macro_a", "pooled_b", "macro_b"))


@pytest.mark.parametrize("digit", [12, 3])
def test_smallest_numbers(spark, digit):
    keys = spark.range(500).select(F.xxhash64("id").alias("k")).repartition(3).persist()
    wanted = np.array([0, 1, 250, 500, 37, 2])
    upto = readout.smallest(keys, wanted, digit)
    x = readout.drawn_numbers(np.array([r.k for r in keys.collect()]), len(wanted))
    assert [(x[:, t] <= upto[t]).sum() for t in range(1, len(wanted))] == wanted[1:].tolist()


def test_platt_is_the_likeliest_line(spark):
    pick = random.Random(2)
    rows = [(u, c, round(pick.gauss(0, 1), 2), 0) for u in range(300) for c in ("p", "q")]
    rows = [(u, c, s, int(pick.random() < 1 / (1 + np.exp(-(2 * s - 1 if c == "p" else 0.3 - s))))) for u, c, s, _ in rows]
    df = cells_of(spark, rows)
    got = readout.platt(df, df).collect()
    for c in "pq":
        own = [r for r in got if r["class"] == c]
        assert abs(sum(r.p - r.y for r in own)) < 1e-3 and abs(sum((r.p - r.y) * r.score for r in own)) < 1e-3
    assert readout.platt(df.filter("class = 'p'"), df).select("class").distinct().count() == 1


def test_posteriors_of_sites_and_decisions(spark):
    """EM finds a shifted rate; classes without mass, or of one label on dev, call nothing."""
    pick = random.Random(12)

    def cells(n, rate, first):
        out = []
        for u in range(first, first + n):
            y = int(pick.random() < rate)
            for site in ("s", "t"):
                odds = np.exp(pick.gauss(2.2 if y else -2.2, 2.1))
                out.append((u, site, "x", float(0.5 * odds / (0.5 * odds + 0.5)), y))
                out.append((u, site, "empty", 0.0, 0))
        return spark.createDataFrame(out, "uid long, site string, class string, p double, y int")

    train, dev, test = cells(400, 0.5, 0), cells(300, 0.15, 1000), cells(400, 0.15, 2000)
    posts = readout.site_posteriors(test, train, dev, ["site", "class"])
    means = {r["class"]: r for r in posts.groupBy("class").agg(F.avg("raw").alias("raw"), F.avg("em").alias("em"), F.avg("dev").alias("dev")).collect()}
    assert abs(means["x"].em - 0.15) < 0.05 and abs(means["x"].dev - 0.15) < 0.06 and means["x"].raw > 0.2
    both = readout.site_mean(posts.withColumn("score", F.col("em")), ["uid", "class"], "score")
    called = {r["class"]: r.n for r in readout.decide(both, ["class"]).groupBy("class").agg(F.sum("called").alias("n")).collect()}
    assert called["empty"] == 0 and 20 < called["x"] < 150
    told = dev.groupBy("uid", "class").agg(F.avg("p").alias("score"), F.max("y").alias("y"))
    held = {r["class"]: r.n for r in readout.decide(both, ["class"], told).groupBy("class").agg(F.sum("called").alias("n")).collect()}
    assert held["empty"] == 0 and held["x"] > 0


# ---- Stored tables and image files ----


def test_labels_are_replaced_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    rows = lambda name, n: spark.createDataFrame([(u, name, "Edema", n) for u in range(3)], "uid long, labeler string, class string, state int")
    studies.put_labels(rows("old", 1).unionByName(rows("other", 2)), path)
    for _ in range(2):  # a retry changes nothing
        studies.put_labels(rows("old", 5), path)
    assert sorted((r.labeler, r.state) for r in spark.read.parquet(path).collect()) == [("old", 5)] * 3 + [("other", 2)] * 3


def test_runs_are_resumed(spark, tmp_path):
    """A run that broke off and is done again leaves no row twice, and what is done isn't asked for again."""
    path = f"file://{tmp_path}/done"
    tasks = spark.createDataFrame([(u, c) for u in range(4) for c in ("a", "b")], "uid long, arm string")
    answers = lambda df, text: df.withColumn("answer", F.lit(text))
    studies.put_done(answers(tasks.filter("uid < 2"), "first"), path, "0001")
    with pytest.raises(Exception, match="broken off"):
        studies.put_done(answers(tasks.filter("uid = 2"), "lost").withColumn("answer", F.raise_error(F.lit("broken off")).cast("string")), path, "0002")
    done = studies.read_done(spark, path, ["uid", "arm"])
    rest = studies.still_to_do(tasks, done, ["uid", "arm"])
    assert sorted((r.uid, r.arm) for r in rest.collect()) == [(u, c) for u in (2, 3) for c in ("a", "b")]
    for _ in range(2):
        studies.put_done(answers(tasks.filter("uid >= 2"), "second"), path, "0002")
    studies.put_done(answers(tasks.filter("uid = 0 and arm = 'a'"), "mended"), path, "0003")
    got = {(r.uid, r.arm): r.answer for r in studies.read_done(spark, path, ["uid", "arm"]).collect()}
    assert got == {(u, c): "mended" if (u, c) == (0, "a") else "first" if u < 2 else "second" for u in range(4) for c in ("a", "b")}


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\x00\x00\x00rest"


def jpeg(width, height, kind=0xC0):
    part = lambda k, body: bytes([0xFF, k]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03"
    return b"\xff\xd8" + part(0xE0, b"JFIF\x00") + b"\xff" + part(0xE1, b"\xff\xc0" * 300) + part(0xC4, b"table") + part(kind, frame) + part(0xDA, b"scan") + b"data"


def test_sides_from_files(spark, tmp_path):
    files = {"a.png": png(640, 480), "b.png": png(640, 480), "c.jpg": jpeg(1024, 2048), "d.jpg": jpeg(30, 20, 0xC2), "e.txt": b"no image", "f.png": b"\x89PNG", "g.jpg": b"\xff\xd8\xff\xe0\x00", "h.jpg": b"\xff"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in studies.read_parts(spark, f"file://{tmp_path}").collect()}
    assert {n: (r.width, r.height) for n, r in got.items()} == {"a.png": (640, 480), "b.png": (640, 480), "c.jpg": (1024, 2048), "d.jpg": (30, 20), **{n: (None, None) for n in ("e.txt", "f.png", "g.jpg", "h.jpg")}}
    parts = studies.read_parts(spark, f"file://{tmp_path}").withColumns({"variant": F.lit("v"), "kind": F.lit("k"), "uid": F.col("path")})
    r = studies.audit_parts(parts.filter("width is not null")).first()
    assert (r.parts, r.duplicates, r.min_side, r.median_side, r.max_side) == (4, 1, 30, 640.0, 2048)


def test_means_and_ties_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 29.27, 122.79, 2.11, 26.11, 56.25, 0.3, 1e-3, 1e9 + 0.7, -7.03]
    rows = [(u, c, v * (1 + (c == "b"))) for u in range(50) for c in "ab" for v in values[u % 10 :] + values[: u % 10]]
    df = spark.createDataFrame(rows, "uid long, prompt_condition string, v double")
    for parts in (1, 7):
        (got,) = pairstats.signed_ranks(df.repartition(parts), ["a", "b"], "v").collect()
        assert (got.n, got.ties, got.w_minus) == (50, 50.0**3 - 50, 50 * 25.5)
        assert pairstats.paired(df.withColumn("at", -F.col("v")).repartition(parts), ["a", "b"], "v", order="at").select("c0", "c1").distinct().count() == 1
    odd = [1e300, -1e300, 5e-324, 2.0**31, 1e-30, float("inf")]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double").groupBy("i").agg(sums.steady_mean(F.col("v")).alias("m")).orderBy("i")
    assert [r.m for r in got.collect()] == odd
    one = spark.createDataFrame([(0, None), (1, 2.5), (1, None), (1, float("nan"))], "i int, v double").groupBy("i").agg(sums.steady_mean(F.col("v")).alias("m")).orderBy("i").collect()
    assert one[0].m is None and math.isnan(one[1].m)


def test_paired_dissociation_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(u, c, float(u % 7 + (c == "b")), u % 5, 0.5 * (u % 3)) for u in range(40) for c in "abc"]
    df = spark.createDataFrame(rows, "uid long, prompt_condition string, v double, w int, x double")
    got = {r.prompt_condition: r for r in pairstats.paired_dissociation(df.mapInArrow(told, df.schema), "a", list("abc"), ["v", "w"], ["x"]).collect()}
    assert seen.value == len(rows)
    (v,) = pairstats.signed_ranks(df, ["a", "b"], "v").collect()
    assert got["b"].p_v == pytest.approx(pairstats.wilcoxon_p(40, v.n, v.w_plus, v.w_minus, v.ties)) and got["b"].d_v == 1.0 and got["b"].p_w is None
