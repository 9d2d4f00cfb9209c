"""Best representative of each duplicate group, field by field.

The records of a group are ranked once per field by window ordering: usable value first, then trust,
then recency, then the smallest id. Spark limits each window's rank to 1 before the shuffle, so a group
with a third of all rows sends one row per task.

* Trust is the best of the record's sources in the trust table, compared trimmed and without case;
  unlisted, null or no sources are 0.
* Recency is ``updated_at`` as an instant. Text without a zone means UTC; null, unreadable or later
  than 2030 is earliest.
* Repeated rows count once. A field without a usable value in a group has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATEST = "2031-01-01T00:00:00Z"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?$"
HOST = r"([A-Za-z0-9_-]+\.)+[A-Za-z0-9_-]+"


def instant(text: Column) -> Column:
    """Microseconds since 1970 of an ISO text, or null."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"[T ]"), t).when(t.rlike(r"[T ]"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))
    ts = F.when(t.rlike(ISO), zoned.try_cast("timestamp"))
    return F.when(ts < F.lit(LATEST).cast("timestamp"), F.unix_micros(ts))


def usable_phone(c: Column) -> Column:
    return c.rlike(r"^\+639\d{9}$") & ~c.rlike(r"^\+639(\d)\1{8}$")


def usable_website(c: Column) -> Column:
    return c.rlike(rf"(?i)^https?://([^/?#@\s]*@)?{HOST}(:\d+)?([/?#]\S*)?$")


def usable_email(c: Column) -> Column:
    return c.rlike(rf"^[^@\s]+@{HOST}$")


FIELDS = {"phone": usable_phone, "website": usable_website, "email": usable_email}


def trusted(records: DataFrame, trust: DataFrame) -> DataFrame:
    """``records`` repeated per source with ``trust_`` added; at least one row each. The trust side is one row per source."""
    t = trust.select(F.lower(F.trim("source")).alias("src_"), F.col("trust").alias("t_")).groupBy("src_").agg(F.max("t_").alias("t_"))
    each = records.withColumn("src_", F.explode_outer("sources")).withColumn("src_", F.lower(F.trim("src_")))
    return each.join(t, "src_", "left").withColumn("trust_", F.coalesce("t_", F.lit(0))).drop("src_", "t_")


def survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """``group_no``, ``field_name``, ``lead_id``, ``value``: the record each field of each group is taken from."""
    r = records.where("group_no is not null and lead_id is not null").select("group_no", "lead_id", "sources", *FIELDS, instant(F.col("updated_at")).alias("at_"))
    fields = F.array(*(F.when(ok(F.trim(f)), F.struct(F.lit(f).alias("field_name"), F.trim(f).alias("value"))) for f, ok in FIELDS.items()))
    r = r.withColumn("f_", F.explode(F.filter(fields, lambda x: x.isNotNull()))).select("group_no", "lead_id", "sources", "at_", "f_.*")
    best = W.partitionBy("group_no", "field_name").orderBy(F.desc("trust_"), F.desc_nulls_last("at_"), F.asc("lead_id"), F.asc("value"))
    ranked = trusted(r, trust).withColumn("rank_", F.row_number().over(best)).where("rank_ = 1")
    return ranked.select(F.col("group_no").cast("bigint").alias("group_no"), "field_name", "lead_id", "value")


def golden(records: DataFrame, trust: DataFrame) -> DataFrame:
    """One built record per group: each field's surviving value, null where none is usable."""
    kept = survivors(records, trust)
    groups = records.where("group_no is not null").select(F.col("group_no").cast("bigint").alias("group_no")).groupBy("group_no").agg(F.count("*").alias("n_records"))
    built = kept.groupBy("group_no").agg(*(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS))
    return groups.join(built, "group_no", "left")
