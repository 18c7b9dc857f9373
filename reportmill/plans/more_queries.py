"""Further queries on images, samples, verdicts, pivots and probe reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..operators import pairstats, readout, responses
from ..sources import studies
from . import derived
from .derived import CONDITIONS, _lists, sql
from .score_queries import _OMIT, hallucinated, scored
from .stat_queries import CELLS, cells
from .text_queries import images, query


@query("image_choice", sql("""SELECT uid, CASE WHEN ft % 3 <> 1 THEN front END AS head, coalesce(front, side) AS "any" FROM (
  SELECT r.uid, min(conv_id || '_' || turn) FILTER (WHERE turn % 2 = 0) AS front, arg_min(turn, conv_id || '_' || turn) FILTER (WHERE turn % 2 = 0) AS ft, min(conv_id || '_' || turn) FILTER (WHERE turn % 2 <> 0) AS side
  FROM reports r JOIN conversations c ON c.conv_id = r.uid GROUP BY r.uid)""", "reports"))
def image_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir)
    there = rows.filter(F.split("filename", "_")[1].cast("int") % 3 != 1).select("filename")
    return studies.choose_images(studies.build_studies(derived.reports(spark, sf_dir), rows), there)


_NAMED = ", ".join(derived.quoted(c) for c in tx.FINDINGS)
_SAID = f"form = 1 AND (n1 IN ({_NAMED}) OR (uid % 3 < 2 AND n2 IN ({_NAMED})))"


@query("sample_presence", sql(f"""SELECT class, presence, count(*) AS n FROM (
  SELECT n1 AS class, lower(s1) AS presence FROM answers WHERE form = 1 AND n1 IN ({_NAMED})
  UNION ALL SELECT n2, CASE WHEN uid % 3 = 0 THEN lower(s2) ELSE 'none' END FROM answers WHERE form = 1 AND uid % 3 < 2 AND n2 IN ({_NAMED})
  UNION ALL SELECT c.class, CASE WHEN list_contains(said_classes, c.class) THEN 'present' ELSE 'absent' END FROM answers, (SELECT unnest({_lists(tx.FINDINGS)}) AS class) c
    WHERE NOT (form = 4 AND uid % 2 = 1) AND NOT ({_SAID})) GROUP BY 1, 2""", "answers"))
def sample_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(derived.predictions(spark, sf_dir))
    said = F.when(F.col("json").isNotNull(), responses.sample_presence(F.col("json")))
    return rows.select(F.explode_outer(said).alias("s")).groupBy("s.class", "s.presence").agg(F.count(F.lit(1)).alias("n")).filter("class is not null")


_WIDE = "SELECT uid, " + ", ".join(f"max(CASE WHEN k = {k} THEN CASE WHEN contradicted > 0 OR fab_prose > 0 THEN 1 ELSE 0 END END) AS c{k}" for k in range(5)) + " FROM omit GROUP BY uid"
_PAIRS = " UNION ALL ".join(f"SELECT '{CONDITIONS[i]}' AS a, '{CONDITIONS[j]}' AS b, count(*) AS n, avg(c{i}) AS mean_a, avg(c{j}) AS mean_b, CAST(sum(CASE WHEN c{i} = 0 AND c{j} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n01, CAST(sum(CASE WHEN c{i} = 1 AND c{j} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n10 FROM wide" for i in range(5) for j in range(i + 1, 5))


@query("hallucination_mcnemar", sql(_PAIRS, "predictions", "truth", "norm", more=_OMIT | {"wide": _WIDE}))
def hallucination_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hallucinated(spark, sf_dir).withColumn("h", F.when(F.col("hallucinated"), 1).otherwise(0))
    return pairstats.mcnemar_counts(rows, list(CONDITIONS), "h")


@query("accuracy_pivot", sql("SELECT difficulty, " + ", ".join(f"avg(CASE WHEN k = {k} THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS {c}" for k, c in enumerate(CONDITIONS)) + " FROM scored GROUP BY difficulty", "scored"))
def accuracy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("ok", F.when(F.col("correct"), 1.0).otherwise(0.0))
    return rows.groupBy("difficulty").pivot("prompt_condition", list(CONDITIONS)).agg(F.avg("ok"))


@query("verified_diagnosis", sql(f"SELECT uid, k, coalesce(list_filter({_lists(tx.FINDINGS)}, lambda c: list_contains(pred, c) AND NOT list_contains(unc, c))[1], 'No acute cardiopulmonary finding') AS primary_diagnosis FROM scored", "scored"))
def verified_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class, in class order, that a verification pass keeps."""
    kept = F.array_compact(F.array(*[F.when(F.array_contains("pred", c) & ~F.array_contains("unc", c), F.lit(c)) for c in tx.FINDINGS]))
    return scored(spark, sf_dir).select("uid", F.col("k").cast("long").alias("k"), F.coalesce(F.get(kept, F.lit(0)), F.lit("No acute cardiopulmonary finding")).alias("primary_diagnosis"))


@query("probe_report", sql("""SELECT class, 2.0::DOUBLE * tp_m / (pos + called) AS f1_model, 2.0::DOUBLE * tp_r / (pos + called) AS f1_probe, 2.0::DOUBLE * tp_r / (pos + called) - 2.0::DOUBLE * tp_m / (pos + called) AS gain, CAST(misses AS BIGINT) AS misses, CAST(recovered AS BIGINT) AS recovered
  FROM (SELECT class, sum(y) AS pos, sum(m) AS called, sum(y * m) AS tp_m, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS tp_r, sum(y * (1 - m)) AS misses, sum(CASE WHEN r <= k THEN y * (1 - m) ELSE 0 END) AS recovered
    FROM (SELECT *, CASE WHEN other > 0.15 THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY class ORDER BY score DESC, uid) AS r, sum(CASE WHEN other > 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY class) AS k FROM cells) GROUP BY class)""", more=CELLS))
def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    return readout.probe_report(rows, rows.filter("other > 0.15"), ["class"])
