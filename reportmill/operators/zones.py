"""Image zones from tags, their boxes, and seeded assignment of zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from .sampling import order_key

ALL = tuple(f"{b}/{s}" for b in tx.BANDS for s in tx.SIDES)


def tag_zone(tags: Column) -> Column:
    """'band/side' of the first ;-entry of slash-separated tags that has both; null if none has."""
    entries = F.split(F.coalesce(tags, F.lit("")), ";")
    tokens = lambda e: F.transform(F.split(e, "/"), lambda t: F.lower(F.trim(t)))
    side = lambda e: F.get(F.filter(tokens(e), lambda t: t.isin(*tx.SIDES)), F.lit(0))

    def band_of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for b, keys in reversed(list(tx.BANDS.items())):
            hit = F.lit(False)
            for k in keys:
                hit = hit | t.startswith(k)
            out = F.when(hit, b).otherwise(out)
        return out

    band = lambda e: F.get(F.array_compact(F.transform(tokens(e), band_of)), F.lit(0))
    both = F.transform(entries, lambda e: F.when(band(e).isNotNull() & side(e).isNotNull(), F.concat_ws("/", band(e), side(e))))
    return F.get(F.array_compact(both), F.lit(0))


def boxes(parts: DataFrame, width: str, height: str, margin: float = 0.15) -> DataFrame:
    """A row for each part and zone with its pixel box, grown by the margin and clipped. A patient's right is an image's left."""
    # A third of the height has no exact double; the small addition keeps whole pixels whole.
    pixel = lambda share, size: F.floor(share * F.col(size) + 1e-9).cast("int")
    each = []
    for zone in ALL:
        band, side = zone.split("/")
        i, x0 = list(tx.BANDS).index(band), 0.0 if side == "right" else 0.5
        box = (max(0.0, x0 - 0.5 * margin), max(0.0, i / 3 - margin / 3), min(1.0, x0 + 0.5 + 0.5 * margin), min(1.0, (i + 1) / 3 + margin / 3))
        each.append(F.struct(F.lit(zone).alias("zone"), *[pixel(F.lit(v), s).alias(n) for v, s, n in zip(box, (width, height, width, height), ("x0", "y0", "x1", "y1"), strict=True)]))
    return parts.withColumn("__b", F.explode(F.array(*each))).select(*parts.columns, "__b.*")


def uniform(seed: str, key: str) -> Column:
    return F.conv(F.substring(order_key(seed, key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _counts(df: DataFrame) -> list[tuple[str, int]]:
    """Zones and how many rows have them, in name order: six rows at most; one each if no row has any."""
    found = {r["zone"]: r["count"] for r in df.filter("zone is not null").groupBy("zone").count().collect()}
    return sorted((found or dict.fromkeys(ALL, 1)).items())


def _drawn(u: Column, counts: list[tuple[str, int]]) -> Column:
    total, upto, out = sum(c for _, c in counts), 0, []
    for zone, c in counts:
        upto += c
        out.append((upto, zone))
    drawn = F.lit(out[-1][1])
    for upto, zone in reversed(out[:-1]):
        drawn = F.when(u * total < upto, zone).otherwise(drawn)
    return drawn


def assign(df: DataFrame, seed: str, key: str = "uid") -> DataFrame:
    """uid, zone and source: the true zone, or one drawn as often as true zones are."""
    return df.select(key, F.coalesce("zone", _drawn(uniform(seed, key), _counts(df))).alias("zone"), F.when(F.col("zone").isNull(), "assigned").otherwise("localizable").alias("source"))


def assign_wrong(df: DataFrame, seed: str, key: str = "uid") -> DataFrame:
    """uid, own and zone: for rows with a zone another one, drawn as often as it is true elsewhere."""
    counts = _counts(df)
    out = F.lit(None).cast("string")
    for own, _ in counts:
        others = [x for x in counts if x[0] != own] or [(z, 1) for z in ALL if z != own]
        out = F.when(F.col("zone") == own, _drawn(uniform(seed, key), others)).otherwise(out)
    return df.filter("zone is not null").select(key, F.col("zone").alias("own"), out.alias("zone"))


def caption(zone: Column) -> Column:
    """What is said of a zone's crop ('band/side'); empty for a whole view."""
    band, side = F.split(zone, "/")[0], F.split(zone, "/")[1]
    return F.when(F.coalesce(zone, F.lit("")) == "", "").otherwise(F.concat(F.lit("^ "), F.initcap(side), F.lit(" "), band, F.lit(" zone (patient "), side, F.lit("), higher resolution.")))


def load_manifest(parts: DataFrame, uid: str = "uid") -> DataFrame:
    """uid, frontal (whole views and their crops), captions (of these, one for one) and lateral paths, in the order of the parts. parts: uid, part_idx, kind, path, zone."""
    side = F.col("kind") == "lateral"
    rows = parts.groupBy(uid).agg(F.array_sort(F.collect_list(F.when(~side, F.struct("part_idx", "path", caption(F.col("zone")).alias("caption"))))).alias("f"), F.array_sort(F.collect_list(F.when(side, F.struct("part_idx", "path")))).alias("l"))  # a study's own parts
    return rows.select(uid, F.col("f.path").alias("frontal"), F.col("f.caption").alias("captions"), F.col("l.path").alias("lateral"))


def regroup(parts: DataFrame, columns: list[str], order: str = "part_idx") -> DataFrame:
    """A row for each uid with arrays of the columns in the order of its parts."""
    each = F.array_sort(F.collect_list(F.struct(order, *columns)))  # a study's own parts
    rows = parts.groupBy("uid").agg(each.alias("__p"))
    return rows.select("uid", *[F.col(f"__p.{c}").alias(c) for c in columns])
