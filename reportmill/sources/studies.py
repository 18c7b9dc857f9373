"""Reading and writing of the study's tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import taxonomy as tx
from ..functions.text import cleaned, report_text

REPORTS = "uid long, MeSH string, Problems string, image string, indication string, comparison string, findings string, impression string"
PROJECTIONS = "uid long, filename string, projection string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with texts over several lines; columns are matched by the header, the schema gives their types."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def build_studies(reports: DataFrame, images: DataFrame, require_text: bool = True) -> DataFrame:
    """One row for each study that has an image (and, if required, a text): cleaned texts, report_text and its images by projection in order.

    reports: uid and text columns; images: uid, filename, projection. Null texts are empty; images of no study are left out.
    """
    texts = [c for c in reports.columns if c != "uid"]
    names = lambda p: F.array_sort(F.collect_list(F.when(F.col("projection") == p, F.col("filename"))))
    lists = images.groupBy("uid").agg(names("Frontal").alias("frontal_paths"), names("Lateral").alias("lateral_paths"), F.count(F.lit(1)).cast("int").alias("n_images"))
    rows = reports.select("uid", *[cleaned(c).alias(c) for c in texts]).withColumn("report_text", report_text("findings", "impression"))
    rows = rows.join(lists, "uid", "inner").withColumn("has_frontal", F.size("frontal_paths") > 0)
    return rows.filter((F.col("findings") != "") | (F.col("impression") != "")) if require_text else rows


def load_studies(spark: SparkSession, reports_csv: str, projections_csv: str, require_text: bool = True) -> DataFrame:
    reports = read_csv(spark, reports_csv, REPORTS).select("uid", "indication", "comparison", "findings", "impression", F.col("MeSH").alias("mesh"), F.col("Problems").alias("problems"))
    return build_studies(reports, read_csv(spark, projections_csv, PROJECTIONS), require_text)


def external_labels(codes: DataFrame, labeler: str, binary: bool = False) -> DataFrame:
    """Long labels (uid, labeler, class, state) from an external labeler's wide codes: 0/1/2/3 as not mentioned/present/absent/uncertain, or 0/1 as absent/present."""
    long = codes.unpivot("uid", [c for c in codes.columns if c != "uid"], "class", "code")
    code = F.col("code").cast("int")
    state = F.when(code == 1, 1).when(code == 0, 0) if binary else F.when(code == 1, 1).when(code == 2, 0).when(code == 3, -1)
    return long.select("uid", F.lit(labeler).alias("labeler"), "class", state.cast("tinyint").alias("state"))


def replace_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels with those of new's labelers put in the place of their old ones."""
    return labels.join(new.select("labeler").distinct(), "labeler", "left_anti").unionByName(new)


def put_labels(new: DataFrame, path: str) -> None:
    """Writes new's labelers in the place of their old rows in a stored table of labels; other labelers' files aren't touched. Done again after a failure it gives the same table."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("labeler").parquet(path)


def load_features(features: DataFrame, sites: list[str], uids: DataFrame | None = None) -> DataFrame:
    """uid and vec: each uid's vectors of all the sites, one behind the other in the order given; uids that lack a site are left out."""
    order = F.array_position(F.array(*[F.lit(s) for s in sites]), F.col("site"))
    rows = features.filter(F.col("site").isin(sites))
    if uids is not None:
        rows = rows.join(uids.select("uid").distinct(), "uid", "left_semi")
    each = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "vec"))).alias("v"))
    return each.filter(F.size("v") == len(sites)).select("uid", F.flatten(F.col("v.vec")).alias("vec"))


def audit_parts(parts: DataFrame) -> DataFrame:
    """By variant and kind: parts, studies, bytes-identical duplicates, and smallest, median and largest longer side."""
    side = F.greatest("width", "height")
    return parts.groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("uid").alias("studies"), (F.count("sha256") - F.countDistinct("sha256")).alias("duplicates"), F.min(side).alias("min_side"), F.percentile(side, F.lit(0.5)).alias("median_side"), F.max(side).alias("max_side"))


def image_sides(content: bytes | None) -> tuple[int | None, int | None]:
    """Width and height that the header of a PNG or JPEG file states; nulls for other or broken files."""
    content = content or b""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] != b"\xff\xd8":
        return None, None
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # padding, and markers without a length
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            return struct.unpack(">HH", content[at + 5 : at + 9])[::-1] if at + 9 <= len(content) else (None, None)
        elif kind in (0xD9, 0xDA):
            break
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None, None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _sides(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([image_sides(x) for x in s], columns=["width", "height"]).astype("Int32")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, width and height of image files; sides are null where the header states none."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), _sides("content").alias("s")).select("path", "length", "sha256", "s.*")


def read_expert_labels(spark: SparkSession, path: str, classes=tx.FINDINGS) -> DataFrame:
    """uid, class and presence from an expert's CSV with a column label_{class} for each class."""
    wide = read_csv(spark, path, "uid long, " + ", ".join(f"`label_{c}` string" for c in classes))
    return wide.select("uid", *[F.lower(F.trim(F.col(f"`label_{c}`"))).alias(c) for c in classes]).unpivot("uid", list(classes), "class", "presence").filter("presence <> ''")


def blinded_manifest(studies: DataFrame, seed: str) -> DataFrame:
    """study (a hash of seed and uid), indication, and names of the first frontal and lateral image as the expert sees them: nothing of report, labels or answers, nor the uid or the files' own names."""
    study = F.md5(F.concat_ws("|", F.lit(seed), F.col("uid").cast("string")))
    name = lambda c, s: F.when(F.size(c) > 0, F.concat(F.substring(study, 1, 12), F.lit(f"_{s}.png"))).otherwise("")
    return studies.select(study.alias("study"), F.coalesce("indication", F.lit("")).alias("indication"), name("frontal_paths", "f").alias("frontal"), name("lateral_paths", "l").alias("lateral"))


def write_table(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def put_done(rows: DataFrame, path: str, run: str) -> None:
    """Appends a run's results to a stored table of checkpoints. A run that is done again replaces its own rows only, so a failed one leaves no row twice."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_done(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The stored results, of each key that of the last run (by name); an empty folder's table has to be made by put_done first."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "run")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("run").cast("string")).alias("__last"))
    return last.select(*keys, "__last.*")


def still_to_do(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key isn't among those done."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def choose_images(studies: DataFrame, existing: DataFrame) -> DataFrame:
    """uid, head (first frontal image, null if its file is missing; never a later one) and any (first frontal, else first lateral image)."""
    rows = studies.select("uid", F.get("frontal_paths", F.lit(0)).alias("front"), F.get("lateral_paths", F.lit(0)).alias("side"))
    found = existing.select(F.col(existing.columns[0]).alias("front"), F.lit(True).alias("there")).distinct()
    return rows.join(found, "front", "left").select("uid", F.when(F.col("there"), F.col("front")).alias("head"), F.coalesce("front", "side").alias("any"))
