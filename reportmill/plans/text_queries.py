"""Queries on reports: studies, labels, strata, samples, zones, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import sets, text
from ..operators import labeling, requests, sampling, zones
from ..sources import studies
from . import derived
from .derived import quoted, sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str, source: str = "report") -> DataFrame:
    rows = derived.reports(spark, sf_dir).withColumn("report_text", text.report_text("findings", "impression"))
    return labeling.label_texts(rows, "report_text" if source == "report" else "impression")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("uid"), F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("filename"), F.when(F.col("turn") % 2 == 0, "Frontal").otherwise("Lateral").alias("projection"))


S = lambda c: f"array_to_string(list_sort({c}), '|')"


@query("build_studies", sql("""SELECT r.uid, trim(r.findings || ' ' || r.impression) AS report_text, i.n_images, i.frontal, i.lateral, i.frontal <> '' AS has_frontal
  FROM reports r JOIN (SELECT conv_id AS uid, CAST(count(*) AS INTEGER) AS n_images,
      coalesce(string_agg(conv_id || '_' || turn, '|' ORDER BY conv_id || '_' || turn) FILTER (WHERE turn % 2 = 0), '') AS frontal,
      coalesce(string_agg(conv_id || '_' || turn, '|' ORDER BY conv_id || '_' || turn) FILTER (WHERE turn % 2 <> 0), '') AS lateral
    FROM conversations GROUP BY 1) i ON i.uid = r.uid""", "reports"))
def build_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = studies.build_studies(derived.reports(spark, sf_dir), images(spark, sf_dir))
    return rows.select("uid", "report_text", "n_images", F.array_join("frontal_paths", "|").alias("frontal"), F.array_join("lateral_paths", "|").alias("lateral"), "has_frontal")


@query("scrub_density", sql("SELECT uid, density FROM densities", "densities"))
def scrub_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reports(spark, sf_dir).select("uid", text.scrubbed_share(text.report_text("findings", "impression")).alias("density"))


@query("hedge_flags", sql("SELECT source, CAST(sum(CASE WHEN hedged THEN 1 ELSE 0 END) AS BIGINT) AS hedged, count(*) AS n FROM (SELECT d.source, t.hedged FROM documents d JOIN truth t ON t.uid = d.doc_id AND t.src = 'report') GROUP BY source", "truth"))
def hedge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.reports(spark, sf_dir).withColumn("hedged", text.report_text("findings", "impression").rlike(tx.HEDGE))
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source"), "uid").groupBy("source").agg(F.sum(F.when(F.col("hedged"), 1).otherwise(0)).alias("hedged"), F.count(F.lit(1)).alias("n"))


@query("report_hash", "SELECT doc_id, substr(md5(coalesce(text, '')), 1, 12) AS report_hash FROM documents")
def report_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12).alias("report_hash"))


@query("label_reports", sql(f"SELECT uid, {S('pos')} AS pos, {S('unc')} AS unc, {S('neg')} AS neg, no_finding, hedged FROM truth WHERE src = 'report'", "truth"))
def label_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("uid", *[sets.joined(F.col(c)).alias(c) for c in ("pos", "unc", "neg")], "no_finding", "hedged")


@query("label_prevalence", sql(f"""SELECT c.class, avg(CASE WHEN rank = 3 THEN 1.0 ELSE 0.0 END) AS positive, avg(CASE WHEN rank = 2 THEN 1.0 ELSE 0.0 END) AS uncertain,
    avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS negative, avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END) AS unmentioned
  FROM reports CROSS JOIN (SELECT unnest({derived._lists(tx.FINDINGS)}) AS class) c LEFT JOIN ranks r ON r.uid = reports.uid AND r.src = 'report' AND r.class = c.class GROUP BY c.class""", "ranks"))
def label_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.prevalence(labelled(spark, sf_dir))


_WIDE = ", ".join(f"CAST(max(CASE WHEN class = {quoted(c)} THEN CASE rank WHEN 3 THEN 1 WHEN 2 THEN -1 ELSE 0 END END) AS TINYINT) AS \"lbl_{c}\"" for c in tx.FINDINGS)


@query("label_wide", sql(f"SELECT uid, {_WIDE} FROM ranks WHERE src = 'report' GROUP BY uid", "ranks"))
def label_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.wide_labels(labeling.long_labels(labelled(spark, sf_dir), "rules"))


def corpus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelers of the documents' own texts: words that stand in them, and the given labels."""
    docs = table(spark, sf_dir, "documents")
    rules = docs.select(F.col("doc_id").alias("uid"), F.lit("rules").alias("labeler"), F.explode(F.array(F.struct(F.lit("toxic").alias("class"), F.when(F.coalesce("text", F.lit("")).rlike("(?i)idiot|scum|moron|trash"), 1).otherwise(0).cast("tinyint").alias("state")), F.struct(F.lit("quality").alias("class"), F.when(F.coalesce("text", F.lit("")).rlike(r"###|!!|\$\$\$| \| "), 0).otherwise(1).cast("tinyint").alias("state")))).alias("l")).select("uid", "labeler", "l.class", "l.state")
    codes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), "quality", "toxic")
    return studies.replace_labels(rules, studies.external_labels(codes, "given", binary=True))


_CORPUS = {
    "given": "SELECT doc_id AS uid, 'toxic' AS class, toxic AS state FROM labels UNION ALL SELECT doc_id, 'quality', quality FROM labels",
    "rules": r"SELECT doc_id AS uid, 'toxic' AS class, CASE WHEN regexp_matches(text, '(?i)idiot|scum|moron|trash') THEN 1 ELSE 0 END AS state FROM documents UNION ALL SELECT doc_id, 'quality', CASE WHEN regexp_matches(text, '###|!!|\$\$\$| \| ') THEN 0 ELSE 1 END FROM documents",
}


@query("external_labels", sql("SELECT uid, 'given' AS labeler, class, CAST(state AS TINYINT) AS state FROM given", more=_CORPUS))
def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_labels(spark, sf_dir).filter("labeler = 'given'")


@query("labeler_agreement", sql("""SELECT class, n, po AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END AS kappa FROM (
  SELECT g.class, count(*) AS n, avg(CASE WHEN g.state = r.state THEN 1.0 ELSE 0.0 END) AS po,
    avg(g.state) * avg(r.state) + (1 - avg(g.state)) * (1 - avg(r.state)) AS pe
  FROM given g JOIN rules r USING (uid, class) GROUP BY g.class)""", more=_CORPUS))
def labeler_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.agreement(corpus_labels(spark, sf_dir), "rules", "given")


@query("difficulty_strata", sql("SELECT difficulty, count(*) AS n, CAST(sum(n_positive) AS BIGINT) AS n_positive, CAST(sum(n_uncertain) AS BIGINT) AS n_uncertain, avg(density) AS density FROM strata GROUP BY difficulty", "strata"))
def difficulty_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeling.stratify(labelled(spark, sf_dir))
    return rows.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pos")).alias("n_positive"), F.sum(F.size("unc")).alias("n_uncertain"), F.avg("density").alias("density"))


@query("eda_summary", sql("""SELECT count(*) AS n, avg(CASE WHEN hedged THEN 1.0 ELSE 0.0 END) AS hedged, avg(CASE WHEN n_uncertain > 0 THEN 1.0 ELSE 0.0 END) AS any_uncertain, avg(density) AS density,
  avg(CASE WHEN density > 0.15 THEN 1.0 ELSE 0.0 END) AS scrubbed, avg(CASE WHEN difficulty = 'easy_normal' THEN 1.0 ELSE 0.0 END) AS normal FROM strata""", "strata"))
def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeling.stratify(labelled(spark, sf_dir))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("hedged")).alias("hedged"), share(F.size("unc") > 0).alias("any_uncertain"), F.avg("density").alias("density"), share(F.col("density") > 0.15).alias("scrubbed"), share(F.col("difficulty") == "easy_normal").alias("normal"))


@query("normalize_dx", sql(f"SELECT uid, k, {S('dx_classes')} AS classes FROM answers", "answers"))
def normalize_dx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.predictions(spark, sf_dir).select("uid", F.col("k").cast("long").alias("k"), sets.joined(text.answer_classes(F.col("primary_diagnosis"))).alias("classes"))


@query("primary_class", sql(f"SELECT uid, k, list_filter({derived._lists(tx.CLASSES)}, lambda c: list_contains(dx_classes, c))[1] AS class FROM answers", "answers"))
def primary_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.predictions(spark, sf_dir).select("uid", F.col("k").cast("long").alias("k"), F.get(text.answer_classes(F.col("primary_diagnosis")), F.lit(0)).alias("class"))


STRATA_SQL = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('draw|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents"


@query("balanced_test_draw", f"SELECT doc_id, lang FROM ({STRATA_SQL}) WHERE place <= 100")
def balanced_test_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(table(spark, sf_dir, "documents"), "lang", 100, seed="draw").select("doc_id", "lang")


_DEV = {"test": f"SELECT doc_id FROM ({STRATA_SQL}) WHERE place <= 100", "rest": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('dev|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM test)", "dev": "SELECT doc_id, lang FROM rest WHERE place <= greatest(1, CAST(floor(0.18 * n) AS BIGINT))"}


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, 0.18, "draw", "dev")


@query("dev_draw", sql("SELECT doc_id, lang FROM dev", more=_DEV))
def dev_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).filter("split = 'dev'").select("doc_id", "lang")


@query("train_pool", sql("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM test) AND doc_id NOT IN (SELECT doc_id FROM dev) GROUP BY lang", more=_DEV))
def train_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).filter("split = 'train'").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("proportional_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('expert|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE place <= greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT))")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_share(table(spark, sf_dir, "documents"), "source", 0.05, seed="expert", nearest=True).select("doc_id", "source")


#: Of each often disputed class in turn the first studies that no earlier class has taken.
PICKS = {"over_all": "SELECT uid, list_filter(pred_h, lambda c: NOT list_contains(truth_h, c)) AS over_called FROM scored WHERE k = 0"} | {
    f"pick{i}": f"SELECT uid, {quoted(c)} AS class FROM over_all WHERE list_contains(over_called, {quoted(c)})" + "".join(f" AND uid NOT IN (SELECT uid FROM pick{j})" for j in range(i)) + " ORDER BY md5('disputed|' || uid), uid LIMIT 15"
    for i, c in enumerate(tx.OFTEN_DISPUTED)
} | {"picked": " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(len(tx.OFTEN_DISPUTED)))}


@query("enriched_sample", sql("SELECT uid, class FROM picked", "scored", more=PICKS))
def enriched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .score_queries import scored

    rows = scored(spark, sf_dir).filter("k = 0").select("uid", F.array_except("pred_h", "truth_h").alias("disputed"))
    return sampling.enriched(rows, "disputed", tx.OFTEN_DISPUTED, 15, seed="disputed")


@query("balanced_training_set", """SELECT doc_id, toxic, unnest(generate_series(1, CASE WHEN toxic = 1 THEN 3 ELSE 1 END)) AS copy FROM (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('train|' || doc_id), doc_id) AS place, sum(toxic) OVER () AS ab FROM labels) WHERE toxic = 1 OR place <= 2 * ab""")
def balanced_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return sampling.balanced(rows, F.col("toxic") == 1, ratio=2.0, copies=3, seed="train").select("doc_id", "toxic", "copy")


@query("confirm_set", """SELECT doc_id, toxic, CASE WHEN place <= 20 THEN 'select' ELSE 'confirm' END AS part FROM (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('confirm|' || doc_id), doc_id) AS place FROM labels) WHERE place <= 40""")
def confirm_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = sampling.ranked(table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["toxic"], 40, seed="confirm")
    return ranked.select("doc_id", "toxic", F.when(F.col("place") <= 20, "select").otherwise("confirm").alias("part"))


@query("exemplars", sql("""SELECT uid, class FROM (SELECT uid, class, row_number() OVER (PARTITION BY class ORDER BY md5('shots|' || uid), uid) AS place FROM (
    SELECT a.uid, CASE WHEN len(a.pos) = 1 THEN a.pos[1] WHEN a.no_finding = 1 THEN 'No Finding' END AS class FROM truth a JOIN truth b ON b.uid = a.uid AND b.src = 'impression'
    WHERE a.src = 'report' AND list_sort(a.pos) = list_sort(b.pos) AND len(a.pos) <= 1) WHERE class IS NOT NULL) WHERE place = 1""", "truth"))
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    both = labeling.label_texts(rows.select("uid", "impression", F.col("pos").alias("pos_a"), F.col("no_finding").alias("normal_a")), "impression")
    one = F.when(F.size("pos_a") == 1, F.get("pos_a", F.lit(0))).when(F.col("normal_a") == 1, "No Finding")
    same = both.filter((F.array_sort("pos_a") == F.array_sort("pos")) & (F.size("pos_a") <= 1)).select("uid", one.alias("class")).filter("class is not null")
    return sampling.ranked(same, ["class"], 1, seed="shots", key="uid").select("uid", "class")


_ZONES = {"zone": """SELECT uid, CASE WHEN mesh LIKE 'Consolidation/lung/base%' THEN 'lower/left' WHEN mesh LIKE 'Opacity/lung/apex%' THEN 'upper/right' WHEN mesh LIKE 'Density/%' THEN 'mid/left' END AS zone FROM reports"""}


@query("zones", sql("SELECT uid, zone FROM zone", "reports", more=_ZONES))
def zones_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reports(spark, sf_dir).select("uid", zones.tag_zone(F.col("mesh")).alias("zone"))


@query("zone_boxes", """SELECT part_id, zone, CAST(floor(greatest(0, x0 - 0.075) * w + 1e-9) AS INTEGER) AS x0, CAST(floor(greatest(0, y - 0.05) * h + 1e-9) AS INTEGER) AS y0, CAST(floor(least(1, x0 + 0.575) * w + 1e-9) AS INTEGER) AS x1, CAST(floor(least(1, y + 1.0 / 3 + 0.05) * h + 1e-9) AS INTEGER) AS y1
  FROM (SELECT p_partkey AS part_id, 100 + p_partkey % 400 AS w, 200 + p_partkey % 300 AS h FROM part), (VALUES ('upper/right', 0.0, 0.0), ('upper/left', 0.5, 0.0), ('mid/right', 0.0, 1.0 / 3), ('mid/left', 0.5, 1.0 / 3), ('lower/right', 0.0, 2.0 / 3), ('lower/left', 0.5, 2.0 / 3)) z(zone, x0, y)""")
def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), (100 + F.col("p_partkey") % 400).alias("w"), (200 + F.col("p_partkey") % 300).alias("h"))
    return zones.boxes(parts, "w", "h").select("part_id", "zone", "x0", "y0", "x1", "y1")


_MARGINAL = """counts AS (SELECT zone, count(*) AS c FROM zone WHERE zone IS NOT NULL GROUP BY zone), cum AS (SELECT zone, sum(c) OVER (ORDER BY zone) - c AS lo, sum(c) OVER (ORDER BY zone) AS hi, sum(c) OVER () AS total FROM counts)"""
_U = lambda seed, uid: f"CAST(('0x' || substr(md5('{seed}|' || {uid}), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("oracle_zones", sql(f"SELECT z.uid, coalesce(z.zone, c.zone) AS zone, CASE WHEN z.zone IS NULL THEN 'assigned' ELSE 'localizable' END AS source FROM zone z LEFT JOIN cum c ON z.zone IS NULL AND {_U('oracle', 'z.uid')} * c.total >= c.lo AND {_U('oracle', 'z.uid')} * c.total < c.hi", "reports", more={**_ZONES, "counts": "SELECT zone, count(*) AS c FROM zone WHERE zone IS NOT NULL GROUP BY zone", "cum": "SELECT zone, sum(c) OVER (ORDER BY zone) - c AS lo, sum(c) OVER (ORDER BY zone) AS hi, sum(c) OVER () AS total FROM counts"}))
def oracle_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.assign(derived.reports(spark, sf_dir).select("uid", zones.tag_zone(F.col("mesh")).alias("zone")), seed="oracle")


@query("wrong_zones", sql(f"SELECT z.uid, z.zone AS own, c.zone AS zone FROM zone z JOIN cum c ON c.own = z.zone AND {_U('wrong', 'z.uid')} * c.total >= c.lo AND {_U('wrong', 'z.uid')} * c.total < c.hi WHERE z.zone IS NOT NULL", "reports", more={**_ZONES, "counts": "SELECT zone, count(*) AS c FROM zone WHERE zone IS NOT NULL GROUP BY zone", "cum": "SELECT a.zone AS own, b.zone, sum(b.c) OVER (PARTITION BY a.zone ORDER BY b.zone) - b.c AS lo, sum(b.c) OVER (PARTITION BY a.zone ORDER BY b.zone) AS hi, sum(b.c) OVER (PARTITION BY a.zone) AS total FROM counts a JOIN counts b ON a.zone <> b.zone"}))
def wrong_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.assign_wrong(derived.reports(spark, sf_dir).select("uid", zones.tag_zone(F.col("mesh")).alias("zone")), seed="wrong")


@query("manifest_regroup", "SELECT conv_id AS uid, string_agg(role, '|' ORDER BY turn) AS kinds, count(*) AS parts FROM conversations GROUP BY conv_id")
def manifest_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uid"), F.col("turn").alias("part_idx"), F.col("role").alias("kind"))
    return zones.regroup(parts, ["kind"]).select("uid", F.array_join("kind", "|").alias("kinds"), F.size("kind").cast("long").alias("parts"))


@query("part_audit", "SELECT 'v' AS variant, role AS kind, count(*) AS parts, count(DISTINCT conv_id) AS studies, count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS duplicates, min(length(coalesce(text, ''))) AS min_side, quantile_cont(length(coalesce(text, '')), 0.5) AS median_side, max(length(coalesce(text, ''))) AS max_side FROM conversations GROUP BY role")
def part_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    parts = c.select(F.lit("v").alias("variant"), F.col("role").alias("kind"), F.col("conv_id").alias("uid"), F.sha2(F.col("t").cast("binary"), 256).alias("sha256"), F.length("t").cast("long").alias("width"), F.lit(0).cast("long").alias("height"))
    return studies.audit_parts(parts)


@query("request_table", sql("""SELECT uid, c AS prompt_condition, 'Indication: ' || CASE WHEN trim(indication) = '' THEN 'None provided' ELSE trim(indication) END || chr(10) || 'Task: ' || c AS user_text FROM reports, (SELECT unnest(['direct', 'cot', 'ddx', 'evidence_first', 'uncertainty_first']) AS c)""", "reports"))
def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_table(derived.reports(spark, sf_dir), {c: "Task: " + c for c in derived.CONDITIONS})


@query("todo_tasks", sql("""SELECT uid, c AS prompt_condition, j AS judge_id FROM reports, (SELECT unnest(['direct', 'cot', 'ddx', 'evidence_first', 'uncertainty_first']) AS c), (SELECT unnest(['j1', 'j2']) AS j) WHERE NOT (uid % 3 = 0 AND c IN ('direct', 'cot') AND j = 'j1')""", "reports"))
def todo_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    uids = derived.reports(spark, sf_dir).select("uid")
    tasks = requests.task_grid(uids, {"prompt_condition": list(derived.CONDITIONS), "judge_id": ["j1", "j2"]})
    done = requests.task_grid(uids.filter("uid % 3 = 0"), {"prompt_condition": ["direct", "cot"], "judge_id": ["j1"]})
    return studies.still_to_do(tasks, done, ["uid", "prompt_condition", "judge_id"])


_STAGE_B = " || chr(10) || ".join(f"CASE WHEN list_contains(pos, {quoted(c)}) THEN {quoted(c + ': PRESENT')} WHEN list_contains(unc, {quoted(c)}) THEN {quoted(c + ': UNCERTAIN')} ELSE {quoted(c + ': ABSENT')} END" for c in tx.FINDINGS)


@query("stage_b_prompts", sql(f"SELECT uid, md5({_STAGE_B}) AS prompt_hash, length({_STAGE_B}) AS chars FROM truth WHERE src = 'report'", "truth"))
def stage_b_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = requests.stage_b_text(F.col("pos"), F.col("unc"))
    return labelled(spark, sf_dir).select("uid", F.md5(said).alias("prompt_hash"), F.length(said).cast("long").alias("chars"))


@query("slot_sets", sql("SELECT uid, array_to_string(list_sort(pos), '|') AS classes FROM truth WHERE src = 'report'", "truth"))
def slot_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.responses import render_slots, slot_set

    return labelled(spark, sf_dir).select("uid", sets.joined(slot_set(render_slots(F.col("pos")))).alias("classes"))


# ---- Whole documents, by a lexicon of their own: what their small words tell of. ----

_WORD = lambda *words: r"(?i)(?:^| )(?:" + "|".join(words) + r")(?: |,|\.|$)"
CORPUS = {
    "Place": _WORD("on", "in", "auf", "sur", "dans", "en"), "Origin": _WORD("of", "from", "von", "des", "de", "del"), "Means": _WORD("with", "by", "avec", "mit", "con", "par"),
    "Purpose": _WORD("for", "pour", "um", "para", "por"), "Number": r"[0-9]", "Address": r"(?i)@[a-z0-9-]+\.[a-z]", "Link": r"(?i)https?://", "Licence": r"(?i)licen[cs]e",
}
CORPUS_NO, CORPUS_MAYBE, CORPUS_DENIED, CORPUS_PLAIN = _WORD("not", "no", "nicht", "pas", "non", "ni"), _WORD("or", "oder", "ou", "may", "that", "que"), r"[^.]{0,20} (?:are|is) not ", r"^$"
_DOCS = {
    "texts": "SELECT doc_id AS uid, 'text' AS src, coalesce(text, '') AS text FROM documents", "sents": derived.CTES["sents"],
    "mentions": derived.sentence_classes(CORPUS), "ranks": derived.sentence_ranks(CORPUS_NO, CORPUS_MAYBE, CORPUS_DENIED),
}
_STATE = lambda rank: f"coalesce(array_to_string(list_sort(list(r.class) FILTER (WHERE rank = {rank})), '|'), '')"


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "lang", "text")
    return labeling.label_texts(rows, "text", CORPUS, CORPUS_NO, CORPUS_MAYBE, CORPUS_DENIED, CORPUS_PLAIN)


@query("document_labels", sql(f"SELECT t.uid, {_STATE(3)} AS pos, {_STATE(2)} AS unc, {_STATE(1)} AS neg FROM texts t LEFT JOIN ranks r ON r.uid = t.uid GROUP BY t.uid", more=_DOCS))
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the corpus lexicon's classes in every whole document."""
    return labelled_documents(spark, sf_dir).select("uid", *[sets.joined(F.col(c)).alias(c) for c in ("pos", "unc", "neg")])


@query("document_prevalence", sql("SELECT d.lang, c.class, avg(CASE WHEN rank = 3 THEN 1.0 ELSE 0.0 END) AS positive, avg(CASE WHEN rank = 2 THEN 1.0 ELSE 0.0 END) AS uncertain, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS negative, avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END) AS unmentioned FROM documents d CROSS JOIN (SELECT unnest(" + derived._lists(CORPUS) + ") AS class) c LEFT JOIN ranks r ON r.uid = d.doc_id AND r.class = c.class GROUP BY 1, 2", more=_DOCS))
def document_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each class's states among the documents of each language."""
    return labeling.prevalence(labelled_documents(spark, sf_dir), list(CORPUS), ("lang",))
