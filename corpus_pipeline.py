"""A corpus pipeline over `documents`: each stage takes what the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame. All but the last give the
columns of documents; the last repeats documents by their sources' target weights and adds `copy`.

In every stage null text is as empty, a null id is a document like others, repeated rows are each treated for themselves (but
one alone stays in the second stage), very long texts are read whole, further columns stay as they are whatever their names,
and an empty table gives an empty result. Empty texts are neither toxic, near duplicates, contaminated nor sanitised; null stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportmill.llm import decontaminate, mixing, ngram_join, pii, toxicity
from reportmill.llm.store import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; equal texts have equal scores, so all or none of them stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that with the smallest id, without one only if none has an id. Texts without words all stay."""
    return ngram_join.keep_one(docs, k=5, least=80, per=100)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; with an empty benchmark all."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that give it away, replaced in their texts; the number of rows doesn't change."""
    return pii.sanitise(docs)


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes; null is a source like others. A document without id is drawn by its text."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_passages),
    ("pii", sanitise_personal_data),
    ("mixing", mix_to_target_weights),
]

#: SQL can't express the trained stages; tests/llm/test_models.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents, each stage's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
