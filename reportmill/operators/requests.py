"""Request tables: texts to be sent for each study and condition, and grids of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx


def request_table(studies: DataFrame, tasks: dict[str, str], indication: str = "indication") -> DataFrame:
    """uid, prompt_condition and user_text for each study and condition; a blank indication reads 'None provided'."""
    said = F.trim(F.coalesce(indication, F.lit("")))
    head = F.concat(F.lit("Indication: "), F.when(said == "", "None provided").otherwise(said), F.lit("\n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("prompt_condition"), F.lit(t).alias("task")) for c, t in tasks.items()]))
    return studies.select("uid", head.alias("head"), each.alias("t")).select("uid", "t.prompt_condition", F.concat("head", "t.task").alias("user_text"))


def task_grid(studies: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """Each study with each combination of the small lists, by exploding within the row."""
    rows = studies.select("uid")
    for name, options in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return rows


def stage_b_text(positive: Column, uncertain: Column, classes=tx.FINDINGS) -> Column:
    """Findings of a first stage as lines in class order."""
    state = lambda c: F.when(F.array_contains(positive, c), "PRESENT").when(F.array_contains(uncertain, c), "UNCERTAIN").otherwise("ABSENT")
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), state(c)) for c in classes])


def evidence_text(positive: Column, uncertain: Column, negative: Column, evidence: Column, classes=tx.FINDINGS) -> Column:
    """Findings of a first stage as lines in class order, with what a present one rests on; a class without a state is 'not assessed'. evidence: map of class to text."""

    def line(c: str) -> Column:
        why = F.trim(F.coalesce(F.element_at(evidence, F.lit(c)), F.lit("")))
        present = F.concat(F.lit("PRESENT"), F.when(why != "", F.concat(F.lit(" (evidence: "), why, F.lit(")"))).otherwise(""))
        state = F.when(F.array_contains(positive, c), present).when(F.array_contains(uncertain, c), "UNCERTAIN").when(F.array_contains(negative, c), "ABSENT").otherwise("not assessed")
        return F.concat(F.lit(f"- {c}: "), state)

    return F.concat_ws("\n", *[line(c) for c in classes])


def judge_table(predictions: DataFrame, groundedness: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every prediction with its groundedness, 0 where there is none."""
    return predictions.join(groundedness.select(*keys, *columns), keys, "left").fillna(0, columns)
