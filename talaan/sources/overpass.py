"""Map data: the query text for a service, and its JSON answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talaan.functions import names

SCHEMA = (
    "version double, generator string, remark string, elements array<struct<type: string, id: bigint, lat: double, lon: double, "
    "center: struct<lat: double, lon: double>, tags: map<string,string>>>"
)


def query_text(tags: list[str], area_id: int | None = None, bbox: tuple | None = None, out: str = "out center tags;") -> str:
    """One clause per k=v tag, within an area or a box."""
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    head, scope = ("", "(" + ",".join(str(x) for x in bbox) + ")") if area_id is None else (f"area({area_id})->.a;", "(area.a)")
    each = "".join('nwr["{}"="{}"]{};'.format(*map(esc, t.split("=", 1)), scope) for t in tags)
    return f"[out:json][timeout:90];{head}({each});{out}"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def elements(answers: DataFrame) -> DataFrame:
    """Raw records of named nodes, ways and relations, each type/id once, the first by position."""
    e = answers.select(F.posexplode("elements").alias("pos", "e"))
    t = F.col("e.tags")

    def tag(*keys: str) -> Column:
        return names.first_present(*(t[k] for k in keys))

    def many(*keys: str) -> Column:
        return F.array_compact(F.array(*(tag(k) for k in keys)))

    rows = e.where(F.col("e.type").isin("node", "way", "relation")).select(
        "pos", F.lit("osm").alias("source"), F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("source_ref"), tag("name", "name:en", "brand").alias("name"),
        many("phone", "contact:phone", "mobile", "contact:mobile").alias("phones_raw"), tag("website", "contact:website", "url").alias("website_raw"), many("email", "contact:email").alias("emails_raw"),
        tag("addr:housenumber").alias("housenumber"), tag("addr:street").alias("street"), tag("addr:suburb", "addr:barangay").alias("suburb"), tag("addr:city").alias("city"),
        tag("addr:province").alias("province"), tag("contact:facebook", "facebook").alias("facebook"), tag("opening_hours").alias("opening_hours"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"),
    ).where("name is not null")
    cols = [c for c in rows.columns if c not in ("source_ref", "pos")]
    return rows.groupBy("source_ref").agg(F.min_by(F.struct(*cols), "pos").alias("r")).select("source_ref", "r.*")


def total(answers: DataFrame) -> DataFrame:
    """The total of the first count element, else 0."""
    first = F.get(F.filter("elements", lambda e: e["type"] == "count"), F.lit(0))
    return answers.select(F.coalesce(first["tags"]["total"].try_cast("bigint"), F.lit(0)).alias("total"))


def geocoded(rows: DataFrame) -> DataFrame:
    """A geocoder's answers as areas: relations are areas from 3,600,000,000, ways from 2,400,000,000, else a box; boxes are s, w, n, e."""
    b = F.transform("boundingbox", lambda x: x.cast("double"))  # south, north, west, east
    base = F.when(F.col("osm_type") == "relation", F.lit(3_600_000_000)).when(F.col("osm_type") == "way", F.lit(2_400_000_000))
    return rows.select(
        "display_name", F.when(base.isNotNull(), "area").otherwise("bbox").alias("kind"), (base + F.col("osm_id")).alias("area_id"), F.array(b[0], b[2], b[1], b[3]).alias("bbox")
    )
