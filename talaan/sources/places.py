"""Places files: a pruned, pushed-down Parquet scan, a polygon filter, and the mapping to raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talaan.functions import names, web
from talaan.operators.regions import regions_of_points


def scan(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], categories: list[str]) -> DataFrame:
    """Places in (south, west, north, east) of any of the categories, open, named, and with confidence of 0.5 or more.

    The box, name and status tests reach the Parquet reader as filters on struct leaves; partition folders are pruned.
    """
    south, west, north, east = bbox
    p = spark.read.parquet(path)
    kept = p.where(F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north)).where(
        F.col("names.primary").isNotNull() & (F.coalesce("operating_status", F.lit("open")) != "permanently_closed") & (F.coalesce("confidence", F.lit(0.0)) >= 0.5)
        & F.arrays_overlap("taxonomy.hierarchy", F.array(*map(F.lit, categories)))
    )
    first = F.get("addresses", F.lit(0))
    return kept.select(
        "id", F.col("names.primary").alias("name"), "confidence", "websites", "emails", "phones", "socials", first["freeform"].alias("freeform"), first["locality"].alias("locality"),
        first["region"].alias("region"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"), ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"),
        F.transform("sources", lambda s: s["dataset"]).alias("datasets"),
    )


def within(places: DataFrame, boundary: DataFrame | None) -> DataFrame:
    """Places inside a boundary's rings (one row); all places if there is no polygon."""
    if boundary is None:
        return places
    inside = regions_of_points(places, "id", "lat", "lon", boundary, "area_id", "rings").select(F.col("key").alias("id"))
    return places.join(inside.distinct(), "id", "left_semi")


def best(places: DataFrame, limit: int) -> DataFrame:
    """The first ceil(1.5 limit) by confidence, null as 0, then id."""
    return places.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "id").limit(-(-3 * limit // 2))


def _social(urls: Column, platform: str) -> Column:
    return F.get(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: web.platform(u) == platform), F.lit(0))


def to_raw(places: DataFrame) -> DataFrame:
    """Rows as the raw table has them; the payload holds confidence and distinct datasets."""
    none = F.array().cast("array<string>")
    datasets = F.array_sort(F.array_distinct(F.filter(F.coalesce("datasets", none), lambda d: d.isNotNull() & (d != ""))))
    return places.select(
        F.lit("overture").alias("source"), F.col("id").alias("source_ref"), "name", F.coalesce("phones", none).alias("phones_raw"), F.get("websites", F.lit(0)).alias("website_raw"),
        F.coalesce("emails", none).alias("emails_raw"), names.house_number(F.col("freeform")).alias("housenumber"), names.house_street(F.col("freeform")).alias("street"),
        F.col("locality").alias("city"), F.col("region").alias("province"), _social(F.col("socials"), "facebook").alias("facebook"), "lat", "lon",
        F.to_json(F.struct("confidence", datasets.alias("datasets"))).alias("payload"),
    )
