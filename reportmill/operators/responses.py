"""Parsing of model answers: JSON, schema, repairs, predicted class sets and claims."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import taxonomy as tx
from .schema import compiled
from ..functions.text import answer_classes, answers_classes, findings_of, let, literal, matching

#: An answer as read first: entries of its lists and tables as text, so that one odd entry doesn't lose the others.
RESPONSE = "struct<primary_diagnosis:variant,confidence:string,explanation:string,reasoning:string,findings:map<string,string>,extracted_evidence:array<string>,differential:array<string>,cited_findings:array<string>>"
FINDING = "struct<presence:string,status:string,confidence:string>"
EVIDENCE = "struct<finding:string,location:string,presence:string,confidence:string>"
CANDIDATE = "struct<diagnosis:string,probability:string,rationale:string>"
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def bare_json(raw: Column) -> Column:
    """The JSON object in an answer as text: without code fences, from the first { to the last }; null if nothing parses."""
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), r"^```(json)?", "")), r"```$", ""))
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    parses = lambda c: F.try_parse_json(c).isNotNull() & c.startswith("{")
    return F.when(parses(s), s).when((inner != "") & parses(inner), inner)


def _closable(text: str, start: int, stop: int) -> tuple[int, list[str]]:
    """The last place up to stop at which the object begun at start can be closed, and the brackets open at the end of the pass.

    The pass follows JSON's grammar and ends at stop, at the object's end or at the first error, beyond which nothing parses.
    """
    open_now: list[str] = []
    last, at, want = start, start, "value"
    while True:
        at = _SPACE.match(text, at).end()
        if at >= stop:
            break
        c = text[at]
        if c in "{[" and want in ("value", "item"):
            open_now.append("}" if c == "{" else "]")
            want = "first key" if c == "{" else "item"
            at += 1
            last = at
        elif open_now and c == open_now[-1] and want in ("comma", "item" if c == "]" else "first key"):
            open_now.pop()
            at += 1
            last, want = at, "comma"
            if not open_now:
                break
        elif c == "," and want == "comma":
            last, want = at, "key" if open_now[-1] == "}" else "value"
            at += 1
        elif c == ":" and want == "colon":
            at, want = at + 1, "value"
        elif c == '"' and want != "comma" and want != "colon":
            try:
                end = json.decoder.scanstring(text, at + 1)[1]
            except ValueError:
                break
            at = end
            if want in ("key", "first key"):
                want = "colon"
            else:
                last, want = end, "comma"
        elif want in ("value", "item") and (m := _SCALAR.match(text, at)):
            at, want = m.end(), "comma"  # it may go on, so that only what follows closes it
        else:
            break
    return last, open_now


_FENCED = re.compile(r"\s*(?:```(?:json)?)?\s*")


def mend(text: str) -> str | None:
    """A truncated JSON object that begins the answer (after a code fence), closed after its last whole member. Two passes, whatever the length.

    Null for prose before the object, and where no member is whole. Of members with one name the last stays.
    """
    start = _FENCED.match(text).end()
    if not text.startswith("{", start):
        return None
    end, _ = _closable(text, start, len(text))
    told = text[start:end] + "".join(reversed(_closable(text, start, end)[1]))
    return _last_of_each_name(told) if told.strip("{} \t\n\r") else None


def _last_of_each_name(text: str) -> str:
    """A JSON text whose objects have each name once, and null for what is no number; nested too deeply for Python, it stays as it is."""
    try:
        return json.dumps(json.loads(text, parse_constant=lambda _: None), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def _whole(text: str) -> str | None:
    """The object of an answer that is whole JSON, though with repeated names or numbers that are none."""
    inner = re.search(r"(?s)\{.*\}", text)
    try:
        return json.dumps(json.loads(inner.group(), parse_constant=lambda _: None), ensure_ascii=False) if inner else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _mended(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else _whole(x) or mend(x))


def read_answer(obj: Column) -> Column:
    """The struct of an answer (a JSON text), null for null.

    A field of another kind than it should have is null; said_diagnosis is the diagnosis as written, whatever its kind. Entries of findings,
    evidence and differential are read one by one: one that is no object is null in its place, the others stay. A finding's
    state is its presence, where it has one ('none' for null), else its status. A probability may be a quoted number; what is no number is null.
    """
    entry = lambda x, kind: F.when(x.startswith("{"), F.from_json(x, kind))
    raw = F.from_json(obj, RESPONSE)

    def fields(a: Column) -> Column:
        told = lambda x: let(entry(x, FINDING), lambda f: F.when(f.isNotNull(), f.withField("state", F.coalesce(f["presence"], F.when(F.array_contains(F.json_object_keys(x), "presence"), "none"), f["status"]))))
        dx = a["primary_diagnosis"]
        candidate = lambda d: F.when(d.isNotNull(), F.struct(d["diagnosis"].alias("diagnosis"), F.nanvl(d["probability"].try_cast("double"), F.lit(None)).alias("probability"), d["rationale"].alias("rationale")))
        return F.when(
            a.isNotNull(),
            F.struct(
                F.when(F.schema_of_variant(dx) == "STRING", F.try_variant_get(dx, "$", "string")).alias("primary_diagnosis"),
                *[a[k].alias(k) for k in ("confidence", "explanation", "reasoning")],
                F.transform_values(a["findings"], lambda k, v: told(v)).alias("findings"),
                F.transform(a["extracted_evidence"], lambda e: entry(e, EVIDENCE)).alias("extracted_evidence"),
                F.transform(a["differential"], lambda d: candidate(entry(d, CANDIDATE))).alias("differential"),
                a["cited_findings"].alias("cited_findings"),
                F.when(~F.is_variant_null(dx), F.coalesce(F.try_variant_get(dx, "$", "string"), F.to_json(dx))).alias("said_diagnosis"),
            ),
        )

    return let(F.when(obj.isNotNull(), raw), fields)


def parse(df: DataFrame, raw: str = "response") -> DataFrame:
    """df with `json` (text of the object, null if the answer can't be parsed) and `answer` (its struct)."""
    found = bare_json(F.col(raw))
    broken = F.col(raw).isNotNull() & F.col("json").isNull() & F.col(raw).contains("{")
    rows = df.withColumn("json", found)
    rows = rows.withColumn("json", F.when(broken, _mended(F.when(broken, F.col(raw)))).otherwise(F.col("json")))
    return rows.withColumn("answer", read_answer(F.col("json")))


#: The errors of an answer by the study's contract.
_contract = compiled(tx.RESPONSE_SCHEMA)


def schema_errors(obj: Column, errors: Callable[[Column], Column] = _contract) -> Column:
    """What is wrong with an answer (a JSON text, as parse() gives it) as sorted `path: rule`; empty if it is valid, 'no object' where there is none."""
    return let(F.try_parse_json(obj), lambda v: F.coalesce(errors(v), F.array(F.lit("no object"))))


def coerced_confidence(text: Column) -> Column:
    """0-100, rounded half to even; 50 where there is no number."""
    number = text.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(number))).cast("int")).otherwise(50)


def coerced_presence(text: Column) -> Column:
    low = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for kv in tx.PRESENCE_SYNONYMS.items() for x in kv])
    return F.coalesce(F.element_at(names, low), low)


def coerced(answer: Column) -> Column:
    """An answer with confidence and presences put right; findings that are no objects stay null."""
    findings = F.transform_values(answer["findings"], lambda k, v: F.when(v.isNotNull(), F.struct(coerced_presence(v["presence"]).alias("presence"), coerced_presence(v["status"]).alias("status"), v["confidence"].alias("confidence"), coerced_presence(v["state"]).alias("state"))))
    return answer.withField("confidence", F.when(answer["confidence"].isNotNull(), coerced_confidence(answer["confidence"]))).withField("findings", findings)


def _named_classes(key: Column) -> Column:
    """Classes that a finding's name stands for: by the checklist, else as a diagnosis, else itself."""
    checklist = F.create_map(*[x for k, v in tx.CHECKLIST.items() for x in (F.lit(k), literal(v))])
    by_words = let(answer_classes(key), lambda hits: F.when(F.size(hits) > 0, hits).otherwise(F.array(F.trim(key))))
    return F.coalesce(F.element_at(checklist, F.trim(key)), by_words)


def structured_set(findings: Column, with_uncertain: bool = False) -> Column:
    """Classes of the findings table only; nothing where there is none. Entries that are no objects count for nothing."""
    state = lambda v: F.lower(F.trim(F.coalesce(v["state"], F.lit(""))))
    wanted = literal(["present", "uncertain"] if with_uncertain else ["present"])
    held = F.map_keys(F.map_filter(findings, lambda k, v: v.isNotNull() & F.array_contains(wanted, state(v))))
    return F.coalesce(findings_of(F.array_distinct(F.flatten(F.transform(held, lambda k: _named_classes(k))))), literal([]))


def predicted_set(answer: Column, fallback: Column, use_differential: bool = False, least: float = 50) -> Column:
    """Predicted classes from the richest part of an answer; from the fallback diagnosis where it couldn't be parsed.

    Of a findings table only itself counts; evidence and differential count beside the diagnosis. Each text is normalised once.
    """
    dx = F.array(answer["primary_diagnosis"])
    seen = F.filter(answer["extracted_evidence"], lambda e: F.array_contains(literal(tx.EVIDENCE_PRESENT), F.lower(F.coalesce(e["presence"], F.lit("")))))
    likely = F.filter(answer["differential"], lambda e: F.coalesce(e["probability"], F.lit(0.0)) >= least)
    texts = F.when(answer.isNull(), F.array(fallback)).when(F.size(answer["extracted_evidence"]) > 0, F.concat(dx, F.transform(seen, lambda e: e["finding"])))
    if use_differential:
        texts = texts.when(F.size(answer["differential"]) > 0, F.concat(dx, F.transform(likely, lambda e: e["diagnosis"])))
    by_words = findings_of(answers_classes(texts.otherwise(dx)))
    return F.when(F.size(answer["findings"]) > 0, structured_set(answer["findings"])).otherwise(by_words)


def predicted(df: DataFrame, raw: str = "response", fallback: str = "primary_diagnosis", **how) -> DataFrame:
    """df parsed once, with `pred`, the predicted classes."""
    return parse(df, raw).withColumn("pred", predicted_set(F.col("answer"), F.col(fallback), **how))


def claims(answer: Column) -> Column:
    """Distinct (class, presence) claims of an answer; presence as stated, else from the words: denied, else hedged, else present. Findings that are no objects claim nothing."""
    by_words = lambda t: F.when(t.rlike(tx.NEGATION), "absent").when(t.rlike(tx.HEDGE), "uncertain").otherwise("present")
    text = lambda t, p: F.struct(F.coalesce(t, F.lit("")).alias("t"), p.alias("p"))
    none = F.array().cast("array<struct<t:string,p:string>>")
    evidence = F.transform(answer["extracted_evidence"], lambda e: text(e["finding"], F.when(e["presence"] != "", e["presence"])))
    cited = F.transform(answer["cited_findings"], lambda c: text(c, F.lit(None).cast("string")))
    named = F.transform(F.map_entries(F.map_filter(answer["findings"], lambda k, v: v.isNotNull())), lambda e: text(e["key"], F.when(F.lower(e["value"]["presence"]).isin("present", "absent", "uncertain"), F.lower(e["value"]["presence"]))))
    said = F.array(text(answer["explanation"], F.lit(None).cast("string")))
    texts = F.concat(F.coalesce(evidence, none), F.coalesce(cited, none), F.coalesce(named, none), said)
    each = F.transform(texts, lambda x: F.transform(matching(x["t"]), lambda c: F.struct(c.alias("class"), F.coalesce(x["p"], by_words(x["t"])).alias("presence"))))
    return F.array_distinct(F.flatten(each))


def fabrications(answer: Column, with_evidence: bool) -> Column:
    """How many measurements and mentions of priors an answer's prose has."""
    parts = [F.coalesce(answer["explanation"], F.lit("")), F.coalesce(F.array_join(answer["cited_findings"], " "), F.lit(""))]
    if with_evidence:
        parts.append(F.coalesce(F.array_join(F.transform(answer["extracted_evidence"], lambda e: F.coalesce(e["finding"], F.lit(""))), " "), F.lit("")))
    return F.regexp_count(F.concat_ws(" ", *parts), F.lit(tx.FABRICATION))


def slot_set(text: Column, classes=tx.FINDINGS) -> Column:
    """Classes answered with yes in lines as 'Class: yes'."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.lower(F.trim(s)))

    def yes(name: str) -> Column:
        return F.exists(lines, lambda s: s.rlike(f"^{re.escape(name.lower())}\\s*:\\s*yes"))

    return F.array_compact(F.array(*[F.when(yes(c), F.lit(c)) for c in classes]))


def render_slots(classes_held: Column, classes=tx.FINDINGS, between: str = "\n") -> Column:
    """A set as fixed lines of yes and no."""
    return F.concat_ws(between, *[F.concat(F.lit(f"{c}: "), F.when(F.array_contains(classes_held, c), "yes").otherwise("no")) for c in classes])


def sample_presence(obj: Column, classes=tx.FINDINGS) -> Column:
    """Array of (class, presence) of one sampled answer (a JSON text): from the findings, given as objects with a presence ('none' for null) or as plain words; where there are none, from the diagnosis."""
    v = F.try_parse_json(obj)
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    named = F.try_variant_get(v, "$.findings", "map<string,variant>")

    def said(x: Column) -> Column:
        stated = F.coalesce(F.try_variant_get(x, "$.presence", "string"), F.when(F.is_variant_null(F.try_variant_get(x, "$.presence", "variant")), "none"))
        return F.lower(F.coalesce(stated, text(x)))

    pair = lambda c, p: F.struct(c.alias("class"), p.alias("presence"))
    held = let(named, lambda m: F.filter(F.transform(literal(classes), lambda c: pair(c, let(F.try_element_at(m, c), said))), lambda x: x["presence"].isNotNull()))
    dx = answer_classes(text(F.try_variant_get(v, "$.primary_diagnosis", "variant")))
    by_dx = let(dx, lambda hits: F.transform(literal(classes), lambda c: pair(c, F.when(F.array_contains(hits, c), "present").otherwise("absent"))))
    return let(held, lambda h: F.when(F.size(h) > 0, h).otherwise(by_dx))
