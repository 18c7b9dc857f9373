"""Labels, normalising, difficulty and agreement on hand-written cases."""

import re

import pytest
from pyspark.sql import functions as F

from reportmill import taxonomy as tx
from reportmill.functions import sets, text
from reportmill.operators import labeling
from reportmill.plans.derived import SENTENCES


def labels_of(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, t string")
    out = {}
    for r in labeling.label_texts(rows, "t").collect():
        out[r.uid] = {**dict.fromkeys(r.pos, 1), **dict.fromkeys(r.unc, -1), **dict.fromkeys(r.neg, 0), "No Finding": r.no_finding, "hedged": r.hedged}
    return [out[i] for i in range(len(texts))]


def test_labels(spark):
    a, b, c, d, e, f, g, h, i = labels_of(spark, ["There is a large pleural effusion. No pneumothorax.", "Findings may represent pneumonia.", "cannot exclude consolidation", "Normal chest. Lungs are clear. No acute disease.", "Borderline cardiomegaly.", "cardiomegaly without edema", "pleural effusion is not present", "cardiomegaly, effusion resolved", None])
    assert a["Pleural Effusion"] == 1 and a["Pneumothorax"] == 0
    assert b["Pneumonia"] == -1 and c["hedged"]
    assert d["No Finding"] == 1 and "Support Devices" not in e
    assert f["Cardiomegaly"] == 1 and f["Edema"] == 0
    assert g["Pleural Effusion"] == 0
    assert h["Cardiomegaly"] == 0 and h["Pleural Effusion"] == 0
    assert i == {"No Finding": None, "hedged": False}


def by_hand(report):
    """The labelling rules with Python's patterns."""
    neg, unc, post = re.compile(tx.NEGATION), re.compile(tx.HEDGE), re.compile(tx.DENIED_AFTER, re.I)
    out = {}
    for s in re.split(r"(?<=[.;])\s+", re.sub(r"\s+", " ", report).strip()):
        for c, p in tx.PATTERNS.items():
            m = re.search(p, s)
            if m:
                at = m.start()
                hedged = any(x.start() < at for x in unc.finditer(s)) or unc.search(s[at:])
                denied = any(x.start() < at for x in neg.finditer(s)) or post.match(s[at:])
                out[c] = max(out.get(c, 0), 2 if hedged else 1 if denied else 3)
    return out


def test_labels_as_by_hand(spark):
    texts = [f"{a} {b}" for i, a in enumerate(SENTENCES) for b in SENTENCES[i % 3 :: 3]]
    state = {3: 1, 2: -1, 1: 0}
    for t, got in zip(texts, labels_of(spark, texts)):
        assert {k: v for k, v in got.items() if k in tx.FINDINGS} == {c: state[r] for c, r in by_hand(t).items()}, t


def answer(spark, *texts, **how):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(text.answer_classes(F.col("t"), **how)).collect()]


def test_answers(spark):
    a, b, c, d, e = answer(spark, "enlarged cardiac silhouette", "no acute cardiopulmonary finding", "No evidence of pneumonia", None, "Pneumonia, no effusion and cardiomegaly")
    assert a == ["Cardiomegaly"] and b == ["No Finding"] and c == [] and d == []
    assert e == ["Cardiomegaly", "Pneumonia"]
    assert answer(spark, "No evidence of pneumonia", negation=False) == [["Pneumonia"]]


def test_sets(spark):
    row = spark.range(1).select(sets.with_parents(text.literal(["Edema"])).alias("p"), sets.to_groups(text.literal(["Edema", "Fracture"])).alias("g"), sets.any_acute(text.literal(["Support Devices", "No Finding"])).alias("a"), sets.truth_set(text.literal([]), text.literal(["Edema"])).alias("z"), sets.truth_set(text.literal([]), text.literal(["Edema"]), "ones").alias("o"), sets.jaccard(text.literal([]), text.literal([])).alias("j")).first()
    assert set(row.p) == {"Edema", "Lung Opacity"} and row.g == ["Airspace/Opacity", "Fracture"] and not row.a
    assert row.z == ["No Finding"] and row.o == ["Edema"] and row.j == 1.0


def confidence(spark, states):
    names = [f"l{i}" for i in range(len(states[0]))]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(states)], "i int, " + ", ".join(f"{n} int" for n in names))
    return [(r.confidence, r.consensus, r.agreement) for r in labeling.with_confidence(rows, names).orderBy("i").collect()]


def test_reference_confidence(spark):
    assert confidence(spark, [(1, 1, 1), (1, 1, 0), (1, 0, -1), (-1, -1, -1), (None, None, 0), (1, 1, -1)]) == [("HIGH", "PRESENT", "3/3"), ("MEDIUM", "PRESENT", "2/3"), ("LOW", "UNCERTAIN", "1/3"), ("LOW", "UNCERTAIN", "0/3"), ("HIGH", "ABSENT", "3/3"), ("MEDIUM", "PRESENT", "2/3")]
    assert confidence(spark, [(1, 1), (1, 0), (1, -1)]) == [("HIGH", "PRESENT", "2/2"), ("MEDIUM", "PRESENT", "1/2"), ("LOW", "PRESENT", "1/2")]


def test_agreement(spark):
    rows = [(u, w, "c", int(s)) for w, states in (("a", "1100110"), ("b", "1000111")) for u, s in enumerate(states)]
    r = labeling.agreement(spark.createDataFrame(rows, "uid long, labeler string, class string, state int"), "a", "b").first()
    assert r.n == 7 and r.agreement == pytest.approx(5 / 7) and r.kappa == pytest.approx((5 / 7 - 25 / 49) / (1 - 25 / 49), abs=0.05)


def test_wide_labels(spark):
    long = labeling.long_labels(labeling.label_texts(spark.createDataFrame([(1, "Large effusion. No edema.")], "uid long, t string"), "t"), "rules")
    row = labeling.wide_labels(long).first().asDict()
    assert row["lbl_Pleural Effusion"] == 1 and row["lbl_Edema"] == 0 and row["lbl_Fracture"] is None
