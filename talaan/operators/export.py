"""Rows of an export: the managed columns of a lead, licence lines, and what an export says about its run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.functions import dims, score

COLUMNS = [
    "lead_id", "business_name", "category", "phone", "phones_extra", "email", "email_kind", "emails_extra", "website", "facebook", "instagram", "linkedin", "tiktok", "address", "city", "score", "flags",
    "why_contact", "tech", "opening_hours", "lat", "lon", "sources", "updated_at",
]


def lead_rows(leads: DataFrame, category: Column) -> DataFrame:
    """The managed columns of scored leads; lists are joined by commas, times are ISO, a field that leads lack is null."""
    made = {
        "category": category, "email_kind": score.email_kind(F.col("email"), F.col("name_key")), "why_contact": score.why_contact(F.col("flags")),
        "updated_at": F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"), **{c: F.array_join(c, ", ") for c in ("phones_extra", "emails_extra", "flags", "tech", "sources")},
    }
    none = F.lit(None).cast("string")
    return leads.select(*(made[c].alias(c) if c in made else F.col(c) if c in leads.columns else none.alias(c) for c in COLUMNS))


def attribution(osm: Column, places: Column) -> Column:
    """Licence lines for the sources used; the map's if neither."""
    return F.when(osm & places, F.lit(dims.OSM_LICENCE + "\n" + dims.PLACES_LICENCE)).when(places, F.lit(dims.PLACES_LICENCE)).otherwise(F.lit(dims.OSM_LICENCE))


def run_counts(clean: dict, outcomes: dict) -> list[tuple[str, str]]:
    """The rows of a summary that a run's own statistics give; unknown counts are a dash or 0."""
    return [
        ("New this run", str(clean.get("new", "—"))), ("Duplicates merged", str(clean.get("duplicates_merged", 0))), ("Removed on request (suppressed)", str(clean.get("suppressed", 0))),
        ("Websites not read (robots.txt)", str(outcomes.get("robots_blocked", 0))),
    ]


def about(runs: DataFrame) -> DataFrame:
    """``run_id``, ``pos``, ``field``, ``value`` of runs with their number of leads ``n``."""
    fields = [("Category", F.col("category")), ("Location", F.col("location")), ("Run ID", F.col("run_id")), ("Leads", F.coalesce("n", F.lit(0)).cast("string"))]
    rows = F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.lit(k).alias("field"), v.alias("value")) for i, (k, v) in enumerate(fields)))
    return runs.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")
