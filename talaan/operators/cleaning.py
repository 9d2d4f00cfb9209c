"""The cleaning step: raw records to candidates, suppression, resolution of all records at once, merged leads and counts.

Records are resolved as a set, not one after another: rules 0 to 4 give each record its first match, connected records are one lead, and its
fields are the first present values in order of arrival. A record-by-record pass can differ where a merged lead takes
its name from one record and its position from another. The limit keeps the first leads by arrival; later
records still merge into kept leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.functions import names, phones, web
from talaan.functions.text import strip
from talaan.operators import resolve
from talaan.operators.labels import spread
from talaan.runtime import broadcast_if_small


def _rest(values: Column) -> Column:
    """All but the first."""
    return F.filter(values, lambda v, i: i > 0)


def candidates(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per raw record with a name key; an unknown city falls back to the run's area."""
    area = runs.select("run_id", F.coalesce("area_name", "location").alias("area"))
    r = raw.join(broadcast_if_small(area, 10_000), "run_id", "left")
    city = F.nullif(strip(F.col("city")), F.lit(""))
    numbers = phones.normalize(F.col("phones_raw"))
    r = r.withColumn("numbers", numbers).withColumn("web", web.normal_url(F.col("website_raw")))
    mails = F.array_distinct(F.filter(F.transform("emails_raw", web.normal_email), lambda e: e.isNotNull()))
    site = F.when(web.platform(F.col("web")).isNull(), F.col("web"))
    out = r.select(
        "record_id", "run_id", "source", "source_ref", F.col("name").alias("business_name"), names.name_key(F.col("name")).alias("name_key"),
        names.address_line(F.concat_ws(" ", "housenumber", "street"), F.col("suburb"), F.col("city")).alias("address"), F.coalesce(city, "area").alias("city"),
        names.city_key(F.coalesce(city, "area")).alias("city_key"), F.when(city.isNull(), "run_area").otherwise(F.col("source")).alias("city_source"), "province",
        names.street_key(F.col("street")).alias("street_key"), "lat", "lon", F.get("numbers", F.lit(0)).alias("phone"), _rest(F.col("numbers")).alias("phones_extra"),
        F.get(mails, F.lit(0)).alias("email"), _rest(mails).alias("emails_extra"), site.alias("website"), web.registered_domain(site).alias("domain"),
        F.coalesce(F.when(web.platform(F.col("web")) == "facebook", F.col("web")), F.col("facebook")).alias("facebook"), "opening_hours", "fetched_at",
    )
    return out.where("name_key <> ''")


def without_suppressed(cands: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidates of which no domain, phone, e-mail or e-mail domain is on the list (``kind``, ``value``): one anti join per record."""
    keys = F.array_distinct(F.filter(F.concat(
        F.array(F.concat(F.lit("domain:"), "domain")), F.transform(F.concat(F.array("phone"), "phones_extra"), lambda p: F.concat(F.lit("phone:"), p)),
        F.transform(F.concat(F.array("email"), "emails_extra"), lambda e: F.concat(F.lit("email:"), e)),
        F.transform(F.concat(F.array("email"), "emails_extra"), lambda e: F.concat(F.lit("domain:"), web.registered_domain(web.mail_host(e)))),
    ), lambda k: k.isNotNull()))
    gone = lists.select(F.concat_ws(":", "kind", "value").alias("k")).distinct()
    hit = cands.select("record_id", F.explode(keys).alias("k")).join(gone, "k", "left_semi").select("record_id").distinct()
    return cands.join(hit, "record_id", "left_anti")


def linked(cands: DataFrame) -> DataFrame:
    """``record_id``, ``label``: the records of each lead share the smallest record id; all records are listed."""
    as_leads = cands.select(F.col("record_id").alias("lead_id"), "name_key", "phone", "domain", "city_key", "street_key", "lat", "lon", F.col("record_id").alias("first_seen_at"))
    firsts = cands.groupBy("source", "source_ref").agg(F.min("record_id").alias("first"))
    same = cands.join(firsts, ["source", "source_ref"]).where("first <> record_id").select(F.col("first").alias("a"), F.col("record_id").alias("b"))
    one = as_leads.join(firsts.select(F.col("first").alias("lead_id")), "lead_id", "left_semi")
    found = resolve.first_match(resolve.firsts(one)).select(F.col("match_id").alias("a"), F.col("lead_id").alias("b"))
    lab = spread(same.unionByName(found), "a", "b")
    return cands.select("record_id").join(lab.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("label", "record_id").alias("label"))


def leads_of(cands: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per lead: the first present value of each field by arrival, united lists, sources, first and last sight."""
    x = cands.join(links, "record_id")
    if limit is not None:
        kept = x.groupBy("run_id", "label").agg(F.min("record_id").alias("first"))
        kept = kept.withColumn("n_", F.row_number().over(W.partitionBy("run_id").orderBy("first"))).where(F.col("n_") <= limit).select("label").distinct()
        x = x.join(kept, "label", "left_semi")
    fields = [f for f in resolve.FIELDS if f in x.columns]
    types = dict(x.dtypes)

    def first(c: str):
        v = F.nullif(F.col(c), F.lit("")) if types[c] == "string" else F.col(c)
        return F.min_by(v, F.when(v.isNotNull(), F.col("record_id"))).alias(c)

    g = x.groupBy("label").agg(
        *map(first, fields), F.array_sort(F.collect_set("source")).alias("sources"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("phone"), "phones_extra")))).alias("ph"),
        F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("email"), "emails_extra")))).alias("em"), F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"),
        F.min_by("source", "record_id").alias("s0"), F.min_by("source_ref", "record_id").alias("r0"), F.count("*").alias("n_records"),
    )
    rest = lambda lst, main: F.filter(lst, lambda v: v.isNotNull() & ~v.eqNullSafe(F.col(main)))
    ident = F.concat(F.lit("L-"), F.substring(F.sha1(F.concat_ws("|", "s0", "r0")), 1, 12))
    return g.select(ident.alias("lead_id"), *fields, rest("ph", "phone").alias("phones_extra"), rest("em", "email").alias("emails_extra"), "sources", "first_seen_at", "last_seen_at", "n_records", "label")


def stats(raw: DataFrame, cands: DataFrame, kept: DataFrame, links: DataFrame) -> DataFrame:
    """Per run: found, unnamed, suppressed, leads, and duplicates merged (records beyond the leads they joined)."""
    n = lambda df, c: df.groupBy("run_id").agg(F.count("*").alias(c))
    groups = kept.join(links, "record_id").groupBy("run_id").agg(F.countDistinct("label").alias("leads"))
    x = n(raw, "found").join(n(cands, "named"), "run_id", "left").join(n(kept, "kept"), "run_id", "left").join(groups, "run_id", "left").na.fill(0)
    return x.select("run_id", "found", (F.col("found") - F.col("named")).alias("unnamed"), (F.col("named") - F.col("kept")).alias("suppressed"), "leads", (F.col("kept") - F.col("leads")).alias("duplicates_merged"))
