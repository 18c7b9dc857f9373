"""Study tables derived from the given tables, as DataFrames and as SQL.

The given documents hold no radiology words, so each row gets its texts from fixed lists by arithmetic on its id: one
report for each document, five answers for each report. Rows and work grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import text

SENTENCES = (
    "There is a large pleural effusion.", "No pneumothorax.", "Findings may represent pneumonia.", "The heart is normal in size.", "Lungs are clear.",
    "Borderline cardiomegaly.", "Cardiomegaly without edema.", "Pleural effusion is not present.", "Patchy opacity in the right base; possible atelectasis.", "Stable granuloma, 4 mm nodule.",
    "Left chest tube in place.", "No acute cardiopulmonary abnormality.", "Old rib fracture.", "Normal chest.", "Consolidation compared to prior study.",
    "Pneumothorax has resolved.", "Mild vascular congestion versus edema.", "XXXX XXXX sternotomy wires.", "Pleural thickening is seen; no effusion.", "The mediastinum is unremarkable.",
)
DIAGNOSES = (
    "Cardiomegaly", "No acute cardiopulmonary finding", "Pleural effusion with atelectasis", "No evidence of pneumonia", "Pneumonia", "Congestive heart failure",
    "Normal chest", "Right lower lobe consolidation, no pneumothorax", "Fracture of the rib and pneumothorax", "indeterminate", "", "Granuloma but no effusion",
)
NAMES = ("Pneumonia", "Effusion", "Airspace opacity", "Cardiomegaly", "Edema", "Lungs", "Devices", "Fracture")
STATUSES = ("present", "absent", "uncertain", "PRESENT", "yes", "possible")
CONDITIONS = ("direct", "cot", "ddx", "evidence_first", "uncertainty_first")
PROBLEMS = ("normal", "Cardiomegaly", "No Indexing", "Pleural Effusion;Opacity", "")
MESH = ("normal", "Consolidation/lung/base/left;Opacity/lung/apex/right", "Opacity/lung/apex/right/irregular", "Density/cardiophrenic angle/left", "Cardiomegaly/borderline", "Opacity/lung/bilateral")
ODDITIES = (', "differential": [{"probability": "high"}]', ', "abstained": "no"', ', "extracted_evidence": [{"finding": "spot", "presence": "absent", "confidence": 900}]', ', "findings": "garbage"', ', "cited_findings": "effusion"')
INDICATIONS = ("chest pain", "", "cough and fever")
FORMS = 5


def pick(values, at: Column) -> Column:
    return F.element_at(F.expr(f"array({', '.join(text.quoted(v) for v in values)})"), (at % len(values)).cast("int") + 1)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def picked(values, at: str) -> str:
    return f"list_extract([{', '.join(quoted(v) for v in values)}], CAST(({at}) % {len(values)} AS INTEGER) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid of every document, dealt by uid: only ids are moved, and what is grouped or joined by uid later needs no further shuffle."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"))
    return ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, findings, impression, indication, problems and mesh: a report for each document."""
    u = F.col("uid")
    return study_ids(spark, sf_dir).select(
        "uid",
        F.concat_ws(" ", pick(SENTENCES, u), pick(SENTENCES, u * 7 + 3)).alias("findings"),
        F.when(u % 11 == 0, "").otherwise(pick(SENTENCES, u * 3 + 5)).alias("impression"),
        pick(INDICATIONS, u).alias("indication"),
        pick(PROBLEMS, u).alias("problems"),
        pick(MESH, u).alias("mesh"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, k, prompt_condition, primary_diagnosis, confidence, response, api_error and prompt_tokens: five answers for each report."""
    u, k = F.col("uid"), F.col("k")
    rows = study_ids(spark, sf_dir).select("uid", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    rows = rows.withColumns({"form": (u + k) % FORMS, "dx": pick(DIAGNOSES, u * 5 + k * 3), "dx2": pick(DIAGNOSES, u * 3 + k + 1), "dx3": pick(DIAGNOSES, u + k * 5 + 4), "s1": pick(STATUSES, u + k), "s2": pick(STATUSES, u * 5 + k + 2), "n1": pick(NAMES, u * 3 + k), "n2": pick(NAMES, u * 3 + k + 3), "said": pick(SENTENCES, u * 3 + k * 7), "confidence": ((u * 37 + k * 11) % 101).cast("int")})
    # Answers as models give them: plain words, null presences and repeated names among the findings, odd items of evidence, quoted
    # probabilities, fields of a wrong kind, a diagnosis that is a list, prose with a brace.
    odd = (F.col("form") == 0) & (u % 2 == 1)
    oddity = F.floor(u / 5).cast("int") % 6
    quote = F.when(u % 2 == 0, '"').otherwise("")
    extra = (
        F.when(F.col("form") == 1, F.concat(F.lit(', "findings": {"'), F.when(u % 11 == 4, F.concat("n1", F.lit('": {"presence": "present"}, "'))).otherwise(""), "n1", F.lit('": {"presence": "'), "s1", F.lit('"}, "'), "n2", F.when(u % 3 == 0, F.concat(F.lit('": "'), "s2", F.lit('"}'))).otherwise(F.concat(F.when(u % 3 == 1, F.lit('": {"presence": null, "status": "')).otherwise(F.lit('": {"status": "')), "s2", F.lit('"}}')))))
        .when(F.col("form") == 2, F.concat(F.lit(', "extracted_evidence": ['), F.when(u % 4 == 1, '"word", 7, null, ').otherwise(""), F.lit('{"finding": "'), "dx2", F.lit('", "presence": "'), "s1", F.lit('"}, {"finding": "'), "dx3", F.lit('", "presence": "'), "s2", F.lit('"}], "cited_findings": ["'), pick(SENTENCES, u + k), F.lit('"]')))
        .when(F.col("form") == 3, F.concat(F.lit(', "differential": [{"diagnosis": "'), "dx2", F.lit('", "probability": '), quote, ((u * 13 + k) % 101).cast("string"), quote, F.lit('}, {"diagnosis": "'), "dx3", F.lit('", "probability": '), ((u * 17 + k * 3) % 101).cast("string"), F.lit("}]")))
        .when(odd & (oddity < 5), pick(ODDITIES, oddity))
        .otherwise("")
    )
    dx = F.when((F.col("form") == 0) & (u % 13 == 6), F.concat(F.lit('["'), "dx", F.lit('"]'))).otherwise(F.concat(F.lit('"'), "dx", F.lit('"')))
    body = F.concat(F.lit('{"primary_diagnosis": '), dx, F.lit(', "confidence": '), F.col("confidence").cast("string"), F.when(odd & (oddity == 5), ".0").otherwise(""), F.lit(', "explanation": "'), "said", F.lit('"'), extra, F.lit("}"))
    raw = F.when((F.col("form") == 4) & (u % 2 == 1), F.when(u % 4 == 1, "I think {maybe} it is bad").otherwise("no answer")).when(F.col("form") == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("uid", "k", pick(CONDITIONS, k).alias("prompt_condition"), F.col("dx").alias("primary_diagnosis"), "confidence", raw.alias("response"), F.when(u % 29 == 3, "timeout").otherwise("").alias("api_error"), ((u * 31 + k * 101) % 900 + 100).cast("int").alias("prompt_tokens"), ((u + k) % 3 + 1).cast("int").alias("n_image_parts"))


def sentence_classes(patterns: dict[str, str]) -> str:
    """Where each class is first mentioned in a sentence."""
    each = []
    for c, p in patterns.items():
        inner = p.removeprefix("(?i)")
        each.append(f"SELECT uid, src, s, {quoted(c)} AS class, length(regexp_extract(s, {quoted('(?is)^(.*?)' + inner)}, 1)) + 1 AS begins FROM sents WHERE regexp_matches(s, {quoted(p)})")
    return "\nUNION ALL ".join(each)


def sentence_ranks(negation: str, hedge: str, denied: str) -> str:
    """The highest rank of each class over a text's sentences."""
    return f"""SELECT uid, src, class, max(CASE
        WHEN {_before(hedge)} OR regexp_matches(substr(s, begins), {quoted(hedge)}) THEN 2
        WHEN {_before(negation)} OR regexp_matches(substr(s, begins), {quoted('(?i)^(?:' + denied + ')')}) THEN 1 ELSE 3 END) AS rank
      FROM mentions GROUP BY uid, src, class"""


def _before(cue: str) -> str:
    return f"(regexp_matches(s, {quoted(cue)}) AND length(regexp_extract(s, {quoted('(?is)^(.*?)' + cue.removeprefix('(?i)'))}, 1)) + 1 < begins)"


def _norm() -> str:
    """Classes of every answer text (a list), by clauses."""
    texts = dict.fromkeys([*DIAGNOSES, *NAMES, *SENTENCES])
    each = []
    for c, p in tx.PATTERNS.items():
        start = lambda q: f"CASE WHEN regexp_matches(clause, {quoted(q)}) THEN length(regexp_extract(clause, {quoted('(?is)^(.*?)' + q.removeprefix('(?i)'))}, 1)) ELSE 999999 END"
        each.append(f"SELECT text, {quoted(c)} AS class FROM clauses WHERE regexp_matches(clause, {quoted(p)}) AND {start(p)} <= {start(tx.NEGATION)}")
    values = ", ".join(f"({quoted(t)})" for t in texts)
    cut = quoted(f"(?i){tx.CLAUSE_END}")
    return f"""SELECT t.text, CASE WHEN count(h.class) > 0 THEN list(DISTINCT h.class) FILTER (WHERE h.class IS NOT NULL)
      WHEN regexp_matches(t.text, {quoted('(?i)' + tx.NORMAL_ANSWER)}) THEN ['No Finding'] ELSE [] END AS classes
    FROM (VALUES {values}) t(text) LEFT JOIN (
      WITH clauses AS (SELECT text, unnest(string_split(regexp_replace(lower(text), {cut}, chr(10), 'g'), chr(10))) AS clause FROM (VALUES {values}) v(text))
      {" UNION ".join(each)}
    ) h ON h.text = t.text GROUP BY t.text"""


def _case(names: dict[str, tuple]) -> str:
    return " ".join(f"WHEN {quoted(k)} THEN [{', '.join(quoted(c) for c in v)}]" for k, v in names.items())


def _lists(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


_CHILDREN = _lists(tx.CHILDREN)


def _bad(s: str) -> str:
    return f"{s} NOT IN ('present', 'absent', 'uncertain')"


#: What the contract finds wrong with an answer, rule by rule.
_ERRORS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {quoted(code)} END" for when, code in [
    ("form = 4 AND uid % 2 = 1", "no object"),
    ("form = 0 AND uid % 13 = 6", "primary_diagnosis: type"),
    *[(f"form = 0 AND uid % 2 = 1 AND (uid // 5) % 6 = {i}", code) for i, code in [(0, "differential[].diagnosis: required"), (0, "differential[].probability: type"), (1, "abstained: type"), (2, "extracted_evidence[].confidence: maximum"), (3, "findings: type"), (4, "cited_findings: type")]],
    (f"form = 1 AND {_bad('s1')}", "findings.*.presence: enum"), ("form = 1 AND uid % 3 = 0", "findings.*: type"), ("form = 1 AND uid % 3 = 1", "findings.*.presence: enum"),
    *[("form = 2 AND uid % 4 = 1", "extracted_evidence[]: type")] * 3, *[(f"form = 2 AND {_bad(s)}", "extracted_evidence[].presence: enum") for s in ("s1", "s2")],
    ("form = 3 AND uid % 2 = 0", "differential[].probability: type"),
]) + "], lambda e: e IS NOT NULL))"

#: Name and SQL of the derived tables, each after those that it needs.
CTES = {
    "reports": f"""SELECT doc_id AS uid, {picked(SENTENCES, 'doc_id')} || ' ' || {picked(SENTENCES, 'doc_id * 7 + 3')} AS findings,
      CASE WHEN doc_id % 11 = 0 THEN '' ELSE {picked(SENTENCES, 'doc_id * 3 + 5')} END AS impression,
      {picked(INDICATIONS, 'doc_id')} AS indication, {picked(PROBLEMS, 'doc_id')} AS problems, {picked(MESH, 'doc_id')} AS mesh FROM documents""",
    "texts": "SELECT uid, 'report' AS src, trim(findings || ' ' || impression) AS text FROM reports UNION ALL SELECT uid, 'impression', impression FROM reports UNION ALL SELECT uid, 'findings', findings FROM reports",
    "sents": r"SELECT uid, src, trim(s) AS s FROM (SELECT uid, src, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM texts) WHERE trim(s) <> ''",
    "mentions": sentence_classes(tx.PATTERNS),
    "ranks": sentence_ranks(tx.NEGATION, tx.HEDGE, tx.DENIED_AFTER),
    "labels_wide": f"""SELECT t.uid, t.src, coalesce(list(r.class) FILTER (WHERE rank = 3), []) AS pos, coalesce(list(r.class) FILTER (WHERE rank = 2), []) AS unc, coalesce(list(r.class) FILTER (WHERE rank = 1), []) AS neg,
        regexp_matches(any_value(t.text), {quoted(tx.NORMAL)}) AS normal, regexp_matches(any_value(t.text), {quoted(tx.HEDGE)}) AS hedged
      FROM texts t LEFT JOIN ranks r ON r.uid = t.uid AND r.src = t.src GROUP BY t.uid, t.src""",
    "truth": f"""SELECT *, CASE WHEN len(pos) > 0 THEN pos ELSE ['No Finding'] END AS t_ignore, CASE WHEN len(pos) + len(unc) > 0 THEN list_concat(pos, unc) ELSE ['No Finding'] END AS t_ones,
        CASE WHEN len(pos) = 0 AND len(unc) = 0 AND normal THEN 1 WHEN len(pos) > 0 THEN 0 END AS no_finding FROM labels_wide""",
    "predictions": f"""SELECT uid, k, list_extract({_lists(CONDITIONS)}, CAST(k AS INTEGER) + 1) AS prompt_condition, dx AS primary_diagnosis, confidence, form, dx2, dx3, s1, s2, n1, n2, said, cited, p1, p2, CASE WHEN form = 0 AND uid % 13 = 6 THEN '' ELSE dx END AS said_dx,
        {_ERRORS} AS errors,
        CASE WHEN uid % 29 = 3 THEN 'timeout' ELSE '' END AS api_error, CAST((uid * 31 + k * 101) % 900 + 100 AS INTEGER) AS prompt_tokens, CAST((uid + k) % 3 + 1 AS INTEGER) AS n_image_parts
      FROM (SELECT doc_id AS uid, k, (doc_id + k) % {FORMS} AS form, {picked(DIAGNOSES, 'doc_id * 5 + k * 3')} AS dx, {picked(DIAGNOSES, 'doc_id * 3 + k + 1')} AS dx2, {picked(DIAGNOSES, 'doc_id + k * 5 + 4')} AS dx3,
        {picked(STATUSES, 'doc_id + k')} AS s1, {picked(STATUSES, 'doc_id * 5 + k + 2')} AS s2, {picked(NAMES, 'doc_id * 3 + k')} AS n1, {picked(NAMES, 'doc_id * 3 + k + 3')} AS n2,
        {picked(SENTENCES, 'doc_id * 3 + k * 7')} AS said, {picked(SENTENCES, 'doc_id + k')} AS cited, (doc_id * 13 + k) % 101 AS p1, (doc_id * 17 + k * 3) % 101 AS p2, CAST((doc_id * 37 + k * 11) % 101 AS INTEGER) AS confidence
        FROM documents, (SELECT unnest(generate_series(0, 4)) AS k))""",
    "norm": _norm(),
    "answers": f"""SELECT p.*, p.form <> 4 AS parsed, n.classes AS dx_classes, d.classes AS said_classes,
        list_filter(CASE
          WHEN form = 1 THEN list_distinct(list_concat(CASE WHEN lower(s1) = 'present' THEN f1.names ELSE [] END, CASE WHEN lower(s2) = 'present' AND uid % 3 = 2 THEN f2.names ELSE [] END))
          WHEN form = 2 THEN list_distinct(list_concat(d.classes, CASE WHEN lower(s1) IN ('present', 'yes') THEN d2.classes ELSE [] END, CASE WHEN lower(s2) IN ('present', 'yes') THEN d3.classes ELSE [] END))
          ELSE d.classes END, lambda c: c <> 'No Finding') AS pred,
        CASE WHEN form = 3 THEN list_filter(list_distinct(list_concat(d.classes, CASE WHEN p1 >= 50 THEN d2.classes ELSE [] END, CASE WHEN p2 >= 50 THEN d3.classes ELSE [] END)), lambda c: c <> 'No Finding') END AS listed
      FROM predictions p JOIN norm n ON n.text = p.primary_diagnosis JOIN norm d ON d.text = p.said_dx JOIN norm d2 ON d2.text = p.dx2 JOIN norm d3 ON d3.text = p.dx3
      JOIN named f1 ON f1.name = p.n1 JOIN named f2 ON f2.name = p.n2""",
    "scored": f"""SELECT a.*, t.pos, t.unc, t.neg, t.t_ignore, t.t_ones, CASE WHEN list_contains(t.t_ignore, 'No Finding') THEN len(a.pred) = 0 ELSE list_has_any(a.pred, t.t_ignore) END AS correct,
        CASE WHEN list_has_any(a.pred, {_CHILDREN}) THEN list_distinct(list_append(a.pred, 'Lung Opacity')) ELSE a.pred END AS pred_h,
        CASE WHEN list_has_any(t.t_ones, {_CHILDREN}) THEN list_distinct(list_append(t.t_ones, 'Lung Opacity')) ELSE t.t_ones END AS truth_h, s.difficulty
      FROM answers a JOIN truth t ON t.uid = a.uid AND t.src = 'impression' JOIN strata s ON s.uid = a.uid""",
}
_NAMED = f"""SELECT name, CASE name {_case({k: tx.CHECKLIST[k] for k in NAMES if k in tx.CHECKLIST})} ELSE CASE WHEN len(n.classes) > 0 THEN n.classes ELSE [name] END END AS names
      FROM (SELECT unnest({_lists(NAMES)}) AS name) JOIN norm n ON n.text = name"""
_STRATA = f"""SELECT r.uid, t.hedged, len(t.pos) AS n_positive, len(t.unc) AS n_uncertain, dens.density,
        CASE WHEN t.hedged OR len(t.unc) > 0 OR ((contains(lower(r.problems || ' ' || r.mesh), 'normal') AND NOT contains(lower(r.problems || ' ' || r.mesh), 'no indexing')) <> (coalesce(t.no_finding, 0) = 1 OR (len(t.pos) = 0 AND len(t.unc) = 0))) OR dens.density > 0.15 THEN 'ambiguous'
          WHEN list_has_any(t.pos, {_lists(tx.RARE)}) THEN 'rare'
          WHEN coalesce(t.no_finding, 0) = 1 OR (len(t.pos) = 0 AND len(t.unc) = 0) THEN 'easy_normal'
          WHEN len(t.pos) >= 3 THEN 'hard_multi' WHEN len(t.pos) = 1 THEN 'easy_abnormal' ELSE 'intermediate' END AS difficulty
      FROM reports r JOIN truth t ON t.uid = r.uid AND t.src = 'report' JOIN densities dens ON dens.uid = r.uid"""
_DENSITIES = r"SELECT uid, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(x, 'XXXX'))) / len(w) ELSE 0.0 END AS density FROM (SELECT uid, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM texts WHERE src = 'report')"
_ORDER = ["reports", "texts", "sents", "mentions", "ranks", "labels_wide", "truth", "densities", "strata", "predictions", "norm", "named", "answers", "scored"]
CTES |= {"named": _NAMED, "strata": _STRATA, "densities": _DENSITIES}
_NEEDS = {
    "texts": ["reports"], "sents": ["texts"], "mentions": ["sents"], "ranks": ["mentions"], "labels_wide": ["ranks", "texts"], "truth": ["labels_wide"], "densities": ["texts"],
    "strata": ["reports", "truth", "densities"], "named": ["norm"], "answers": ["predictions", "named"], "scored": ["answers", "truth", "strata"],
}


def sql(body: str, *needs: str, more: dict[str, str] | None = None) -> str:
    """body after a WITH clause of the derived tables that it needs (and of `more`)."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        wanted.add(name)

    for name in needs:
        add(name)
    parts = [(n, CTES[n]) for n in _ORDER if n in wanted] + list((more or {}).items())
    return ("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" if parts else "") + body
