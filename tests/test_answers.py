"""Parsing, predicted sets, claims, scores and calibration on hand-written cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reportmill.operators import experiments, responses, scoring


def parsed(spark, *raw):
    rows = spark.createDataFrame([(i, r, "Pneumonia") for i, r in enumerate(raw)], "i int, response string, primary_diagnosis string")
    return responses.predicted(rows).orderBy("i")


def test_parsing_and_mending(spark):
    cut = '{"primary_diagnosis": "Edema", "confidence": 70, "extracted_evidence": [{"finding": "x", "presence": "pres'
    rows = parsed(spark, '```json\n{"primary_diagnosis": "Edema"}\n```', 'Sure: {"primary_diagnosis": "Edema"} done', cut, "nothing", None, "[1, 2]", '{"a": ').collect()
    assert [r.json is not None for r in rows] == [True, True, True, False, False, False, False]
    assert all(r.answer.primary_diagnosis == "Edema" for r in rows[:3])
    assert rows[3].pred == ["Pneumonia"] and rows[4].pred == ["Pneumonia"]


def test_mend_keeps_whole_members():
    whole = {"a": "x, \"y\" {", "b": [1, {"c": 2}], "d": {"e": "f"}}
    text = json.dumps(whole)
    for cut in range(2, len(text) + 1):
        got = responses.mend(text[:cut])
        assert got is None or isinstance(json.loads(got), dict)
    assert json.loads(responses.mend(text[:-1])) == whole


def predicted(spark, **answer):
    return parsed(spark, json.dumps(answer)).first().pred


def test_structured_sets(spark):
    for findings, want in (({"Edema": {"status": "PRESENT"}}, ["Edema"]), ({"Edema": {"status": "ABSENT"}}, []), ({"Edema": {"status": "UNCERTAIN"}}, []), ({"Edema": {"presence": "present"}}, ["Edema"]), ({"Effusion": {"presence": " Present "}}, ["Pleural Effusion"]), ({"Lungs": {"presence": "present"}}, ["Lungs"]), ({"Edema": {"status": ""}}, [])):
        assert predicted(spark, primary_diagnosis="Pneumonia", findings=findings) == want, findings
    assert predicted(spark, primary_diagnosis="Pneumonia", findings={}) == ["Pneumonia"]
    assert predicted(spark, primary_diagnosis="Pneumonia", findings="garbage") == ["Pneumonia"]


def test_evidence_and_differential(spark):
    evidence = [{"finding": "edema", "presence": "Yes"}, {"finding": "fracture", "presence": "absent"}]
    assert sorted(predicted(spark, primary_diagnosis="Pneumonia", extracted_evidence=evidence)) == ["Edema", "Pneumonia"]
    listed = [{"diagnosis": "edema", "probability": 60}, {"diagnosis": "fracture", "probability": 40}]
    assert predicted(spark, primary_diagnosis="Pneumonia", differential=listed) == ["Pneumonia"]
    row = parsed(spark, json.dumps({"primary_diagnosis": "Pneumonia", "differential": listed})).select(responses.predicted_set(F.col("answer"), F.lit(""), use_differential=True)).first()[0]
    assert sorted(row) == ["Edema", "Pneumonia"]


def errors(spark, obj):
    return spark.createDataFrame([(obj if isinstance(obj, str) else json.dumps(obj),)], "r string").select(responses.schema_errors(F.col("r"))).first()[0]


def test_schema(spark):
    good = {"primary_diagnosis": "x", "confidence": 80, "explanation": "y"}
    assert errors(spark, good) == []
    assert errors(spark, good | {"confidence": 130}) == ["confidence: maximum"]
    assert errors(spark, good | {"confidence": 85.0}) == []
    assert errors(spark, {"confidence": "a"}) == ["confidence: type", "explanation: required", "primary_diagnosis: required"]
    assert errors(spark, "no") == ["no object"] and errors(spark, [1]) == ["$: type"]
    conf = spark.createDataFrame([("130",), ("-4",), ("2.5",), ("3.5",), ("x",)], "c string").select(responses.coerced_confidence(F.col("c"))).collect()
    assert [r[0] for r in conf] == [100, 0, 2, 4, 50]


def test_claims_and_verdicts(spark):
    raw = json.dumps({"primary_diagnosis": "Edema", "explanation": "No pneumothorax, 4 mm nodule compared to prior.", "extracted_evidence": [{"finding": "effusion", "presence": "present"}]})
    rows = parsed(spark, raw).withColumns({"pos": F.array(F.lit("Pleural Effusion"), F.lit("Fracture")), "unc": F.array().cast("array<string>"), "neg": F.array(F.lit("Lung Lesion"))})
    r = scoring.hallucinations(scoring.judged_claims(rows)).first()
    assert {(c["class"], c["presence"]) for c in r.claims} == {("Pleural Effusion", "present"), ("Pneumothorax", "absent"), ("Lung Lesion", "absent")}
    assert (r.supported, r.contradicted, r.unverifiable) == (2, 0, 1) and r.support_rate == 1.0
    assert r.n_fabricated == 2 and r.hallucinated and r.n_omitted == 1 and r.omission_rate == 0.5


def test_calibration(spark):
    rows = spark.createDataFrame([("p", 100, 1), ("p", 100, 1), ("p", 0, 0), ("p", 0, 0), *[("o", 90, 0)] * 4], "g string, confidence int, correct int")
    got = {r.g: r for r in scoring.calibration(rows, ("g",), bins=10).collect()}
    assert got["p"].ece == 0 and got["p"].brier == 0
    assert got["o"].overconfidence == 1.0 and got["o"].ece > 0.5
    assert {r.g: r.ece for r in scoring.calibration(rows, ("g",), right_closed=True).collect()}["p"] == 0
    bins = scoring.reliability(rows, ("g",)).collect()
    assert len(bins) == 20 and sum(r["count"] for r in bins) == 8


def test_votes(spark):
    rows = spark.createDataFrame([(1, ["Edema"]), (1, ["Edema", "Fracture"]), (1, []), (2, [])], "uid long, pred array<string>")
    counted = experiments.votes(rows, ("uid",))
    got = {r.uid: (r.present, r.primary_diagnosis, r.confidence) for r in experiments.vote_decision(counted, ("uid",), 2).collect()}
    assert got == {1: (["Edema"], "Edema", 67), 2: ([], "No acute cardiopulmonary finding", 90)}


def test_greedy_group_policy():
    assert experiments.drop_groups([("a", 90, 5, 5), ("b", 1, 80, 5)]) == ["b"]
    assert experiments.drop_groups([("a", 9, 1, 1), ("b", 9, 1, 1)]) == []


def test_common_uids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "uid long, arm string")
    assert [r.uid for r in experiments.common_uids(rows, "arm", 2).collect()] == [1]


def test_effects(spark):
    rows = spark.createDataFrame([(1, "n", 0.0), (1, "v", 1.0), (1, "r", 0.0), (1, "b", 1.0), (2, "n", 0.0)], "uid long, arm string, ok double")
    r = experiments.factorial_effects(rows, "uid", "arm", F.col("ok"), ("n", "v", "r", "b")).first()
    assert (r.n, r.visual, r.reasoning, r.interaction) == (1, 1.0, 0.0, 0.0) and r.n == pytest.approx(1)


def test_mend_has_no_limit_of_length_or_places():
    whole = {"primary_diagnosis": "Edema", "findings": [{"n": i, "x": "y" * 50} for i in range(2000)]}
    text = json.dumps(whole)
    got = json.loads(responses.mend(text[:-40]))
    assert len(text) > 100_000 and got["primary_diagnosis"] == "Edema" and got["findings"][:1999] == whole["findings"][:1999]
    # Cut inside a long malformed tail: the last place that parses is far before it.
    bad = '{"primary_diagnosis": "Edema", "findings": {"a" "b"' + ', "c"' * 500
    assert json.loads(responses.mend(bad)) == {"primary_diagnosis": "Edema", "findings": {}}
    assert json.loads(responses.mend('```json\n{"a": [1, {"b": "c"}, 2')) == {"a": [1, {"b": "c"}]}


def test_odd_entries_lose_nothing_else(spark):
    mixed = {"Edema": {"presence": "present"}, "Pneumonia": "present", "Fracture": 3, "Atelectasis": None}
    assert predicted(spark, primary_diagnosis="", findings=mixed) == ["Edema"]
    odd = ["word", 4, None, [1], {"finding": "Edema", "presence": "yes"}]
    assert predicted(spark, primary_diagnosis="", extracted_evidence=odd) == ["Edema"]
    assert predicted(spark, primary_diagnosis="Fracture", extracted_evidence=["word"]) == ["Fracture"]
    for probability, want in (("60", ["Pneumonia"]), (" 60.5 ", ["Pneumonia"]), (60, ["Pneumonia"]), ("40", []), ("about 60", []), ("nan", []), (None, []), ([60], [])):
        raw = json.dumps({"primary_diagnosis": "", "differential": ["x", {"diagnosis": "pneumonia", "probability": probability}]})
        got = parsed(spark, raw).select(responses.predicted_set(F.col("answer"), F.lit(""), use_differential=True)).first()[0]
        assert got == want, probability
    claims = parsed(spark, json.dumps({"explanation": "", "extracted_evidence": odd, "findings": mixed})).select(responses.claims(F.col("answer"))).first()[0]
    # Findings that are plain words, numbers or null claim nothing.
    assert {(c["class"], c["presence"]) for c in claims} == {("Edema", "yes"), ("Edema", "present")}


def test_clauses_and_their_negations(spark):
    from reportmill.functions import text

    cases = {"Pneumonia, no effusion": ["Pneumonia"], "no pneumonia but effusion": ["Pleural Effusion"], "effusion not edema": ["Pleural Effusion"], "ground,glass": [], "ground glass": ["Lung Opacity"], "no pneumonia": [], "Normal": ["No Finding"], "": [], "cardiomegaly without edema": ["Cardiomegaly"], "without edema and fracture": ["Fracture"]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(text.answer_classes(F.col("t"))).collect()] == list(cases.values())
    assert rows.filter("t = 'no pneumonia'").select(text.answer_classes(F.col("t"), negation=False)).first()[0] == ["Pneumonia"]
    assert spark.range(1).select(text.answer_classes(F.lit(None).cast("string"))).first()[0] == []


# ---- The whole contract, against a plain validator ----


def broken(schema, v, path=""):
    """What a schema finds wrong with a value, rule by rule as the draft states them."""
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}
    at, below, out = path or "$", f"{path}." if path else "", []
    told = schema.get("type", [])
    if told and not any(kinds[k] for k in ([told] if isinstance(told, str) else told)):
        out.append(f"{at}: type")
    if "enum" in schema and not any(type(v) is type(x) and v == x for x in schema["enum"]):
        out.append(f"{at}: enum")
    if number:
        out += [f"{at}: {name}" for name, bad in (("minimum", v < schema.get("minimum", v)), ("maximum", v > schema.get("maximum", v))) if bad]
    if isinstance(v, dict):
        known = schema.get("properties", {})
        out += [f"{below}{k}: required" for k in schema.get("required", []) if k not in v]
        for k, x in v.items():
            more = schema.get("additionalProperties", True)
            if k in known:
                out += broken(known[k], x, f"{below}{k}")
            elif more is False:
                out.append(f"{at}: additionalProperties")
            elif more is not True:
                out += broken(more, x, f"{below}*")
    if isinstance(v, list):
        out += [e for x in v for e in broken(schema.get("items", {}), x, f"{path}[]")]
        out += [f"{at}: {name}" for name, bad in (("minItems", len(v) < schema.get("minItems", 0)), ("maxItems", len(v) > schema.get("maxItems", len(v)))) if bad]
    return out


def test_contract_as_a_plain_validator(spark):
    from reportmill import taxonomy as tx

    pick = random.Random(7)
    odd = [None, True, False, 0, 5, -1, 101, 85.0, 85.5, 1e2, 1e300, "", "x", "present", "absent", "PRESENT", [], {}, [1], {"a": 1}]
    some = lambda: pick.choice(odd)

    def part(names):
        return pick.choice([some(), {n: some() for n in names if pick.random() < 0.8}, {n: pick.choice(["present", "x", 7]) for n in names}])

    answers = []
    for _ in range(260):
        a = {k: some() for k in ("primary_diagnosis", "confidence", "explanation", "reasoning", "uncertainty_statement", "abstained", "other") if pick.random() < 0.5}
        a |= {"primary_diagnosis": "x", "confidence": 70, "explanation": "y"} if pick.random() < 0.6 else {}
        for k, names in (("extracted_evidence", ("finding", "location", "presence", "confidence")), ("differential", ("diagnosis", "probability", "rationale"))):
            if pick.random() < 0.6:
                a[k] = pick.choice([some(), [part(names) for _ in range(pick.randint(0, 4))]])
        if pick.random() < 0.6:
            a["findings"] = pick.choice([some(), {f"f{i}": part(("presence", "status", "confidence")) for i in range(pick.randint(0, 3))}])
        if pick.random() < 0.4:
            a["cited_findings"] = pick.choice([some(), [some(), "x"]])
        answers.append(a)
    good = {"primary_diagnosis": "x", "confidence": 70, "explanation": "y"}
    answers += [[1, 2], "text", 7, None, {}, good, good | {"confidence": 85.0}, good | {"findings": {}}, good | {"findings": {"f": {"presence": "absent", "status": 7}}}, good | {"differential": [{"diagnosis": "d", "probability": 0}]}]
    answers += [good | {"extracted_evidence": [{"finding": "f", "presence": "present", "confidence": 100.0}]}, good | {"cited_findings": [], "abstained": False}]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "i int, r string")
    got = {r.i: r.e for r in rows.select("i", responses.schema_errors(F.col("r")).alias("e")).collect()}
    for i, a in enumerate(answers):
        assert got[i] == sorted(broken(tx.RESPONSE_SCHEMA, a)), a
    assert sum(not e for e in got.values()) > 5 and len({e for x in got.values() for e in x}) > 20


def test_other_rules_of_schemas(spark):
    from reportmill.operators.schema import compiled

    schema = {"type": ["object", "null"], "properties": {"a": {"type": "array", "items": {"enum": [1, "x", None, True]}, "minItems": 1, "maxItems": 2}, "b": {"type": "number", "minimum": 0}}, "additionalProperties": False}
    values = [None, {}, {"a": []}, {"a": [1, "x", None]}, {"a": [2, False]}, {"b": -1}, {"b": 0.5, "c": 1, "d": 2}, "no"]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, r string")
    got = {r.i: r.e for r in rows.select("i", compiled(schema)(F.parse_json("r")).alias("e")).collect()}
    assert [got[i] for i in range(len(values))] == [sorted(broken(schema, v)) for v in values]
    with pytest.raises(ValueError, match="not supported"):
        compiled({"oneOf": []})(F.parse_json(F.lit("1")))


def test_prose_and_broken_objects_keep_the_fallback(spark):
    rows = parsed(spark, "I think {maybe} it is bad", 'Sure: {"primary_diagnosis": "Edema", "x": [1', "{maybe", '```json\n{"primary_diagnosis": "Edema", "x": [1', '{"primary_diagnosis": ').collect()
    assert [r.json is not None for r in rows] == [False, False, False, True, False]
    assert [r.pred for r in rows] == [["Pneumonia"], ["Pneumonia"], ["Pneumonia"], ["Edema"], ["Pneumonia"]]


def test_null_presences_and_repeated_names(spark):
    assert predicted(spark, primary_diagnosis="", findings={"Edema": {"presence": None, "status": "present"}, "Fracture": {"status": "present"}}) == ["Fracture"]
    twice = '{"primary_diagnosis": "", "findings": {"Edema": {"presence": "present"}, "Edema": {"presence": "absent"}, "Fracture": {"presence": "absent", "presence": "present"}}}'
    row = parsed(spark, twice).withColumn("e", responses.schema_errors(F.col("json"))).first()
    assert row.pred == ["Fracture"] and row.e == ["confidence: required", "explanation: required"]
    nan = parsed(spark, '{"primary_diagnosis": "Edema", "confidence": NaN}').first()
    assert nan.pred == ["Edema"] and nan.answer.confidence is None


def test_a_diagnosis_that_is_no_text(spark):
    for dx in (["Pneumonia"], {"a": "Pneumonia"}, 5, None, True):
        row = parsed(spark, json.dumps({"primary_diagnosis": dx, "explanation": "edema"})).first()
        assert row.pred == [] and row.answer.primary_diagnosis is None
    # The whole response's set reads what is written, whatever its kind.
    rows = parsed(spark, json.dumps({"primary_diagnosis": ["Pneumonia"], "explanation": "edema"}), "nothing")
    assert [sorted(r[0]) for r in rows.select(scoring.full_response_set(F.col("answer"), F.col("primary_diagnosis"))).collect()] == [["Edema", "Pneumonia"], ["Pneumonia"]]


def test_presence_counts_take_every_entry(spark, sf_dir):
    """Each answer of the second form names two findings; no name or presence is left out."""
    from reportmill.plans import QUERIES

    got = QUERIES["presence_counts"](spark, sf_dir).collect()
    forms = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(size(filter(sequence(0, 4), k -> (doc_id + k) % 5 = 1))) AS n").first().n
    assert sum(r.n for r in got) == 2 * forms
    assert {r.presence for r in got} == {"present", "absent", "uncertain", "yes", "possible", None} and all(r.name for r in got)
