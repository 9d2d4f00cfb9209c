"""Queries p7_…: leads near each other, and the service areas around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talaan.operators.near import near_pairs
from talaan.operators.regions import regions_of_points
from talaan.runtime import table

NEAR_M = 50.0


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead pairs at most 50 m apart, and (area, lead) for each lead in an area; ``key_a``, ``key_b``."""
    leads = table(spark, sf_dir, "leads").select("lead_id", "lat", "lon")
    near = near_pairs(leads, "lead_id", "lat", "lon", NEAR_M)
    inside = regions_of_points(leads, "lead_id", "lat", "lon", table(spark, sf_dir, "service_areas"), "area_id", "rings")
    return near.unionByName(inside.select(F.col("area").alias("key_a"), F.col("key").alias("key_b")))


def p7_area_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leads each service area holds; areas without leads count 0."""
    areas = table(spark, sf_dir, "service_areas")
    leads = table(spark, sf_dir, "leads").select("lead_id", "lat", "lon")
    held = regions_of_points(leads, "lead_id", "lat", "lon", areas, "area_id", "rings").groupBy("area").agg(F.count("*").alias("n"))
    return areas.select("area_id").join(held, F.col("area") == F.col("area_id"), "left").select("area_id", F.coalesce("n", F.lit(0)).alias("n_leads"))


_P = """(SELECT DISTINCT lead_id, lat, lon FROM leads WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))"""
_NEAR = f"""SELECT DISTINCT a.lead_id AS key_a, b.lead_id AS key_b FROM {_P} a JOIN {_P} b ON b.lat BETWEEN a.lat - 0.0005 AND a.lat + 0.0005 AND a.lead_id < b.lead_id
WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= {NEAR_M}"""
_INSIDE = f"""SELECT area_id, lead_id FROM (SELECT area_id, ring[i][1] AS ax, ring[i][2] AS ay, ring[i + 1][1] AS bx, ring[i + 1][2] AS b_y FROM (SELECT area_id, ring, unnest(range(1, len(ring))) AS i
FROM (SELECT area_id, unnest(rings) AS ring FROM service_areas))) e JOIN {_P} p ON (ay > p.lat) <> (b_y > p.lat) AND p.lon < (bx - ax) * (p.lat - ay) / (b_y - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1"""

QUERIES = {"p7_found": p7_found, "p7_area_load": p7_area_load}
SQL = {
    "p7_found": f"{_NEAR} UNION ALL SELECT area_id, lead_id FROM ({_INSIDE})",
    "p7_area_load": f"SELECT s.area_id, count(i.lead_id) AS n_leads FROM service_areas s LEFT JOIN ({_INSIDE}) i USING (area_id) GROUP BY 1",
}
