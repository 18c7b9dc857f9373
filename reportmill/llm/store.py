"""Shared folder for intermediate tables, and column names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within the cluster's shared folder (spark.checkpoint.dir).

    Where that is unset, a temporary one of our own if Spark runs in this machine alone, as in tests; else an error, as
    executors would write to their own disks what the driver can't read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='reportmill-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/reportmill-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, where: str) -> None:
    """Deletes a folder of new_path, when nothing is computed from it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written here. For the end of a job, when its results are stored elsewhere."""
    delete(spark, shared_dir(spark))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder (or to a new path there) and read again: this cuts the lineage and survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python have about BATCH_BYTES at most (a longer row goes alone), unless the session has a limit of its own.

    Spark's default limit is 10,000 rows: with whole texts that is tens of MB, held by executor and Python worker alike.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores added until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
