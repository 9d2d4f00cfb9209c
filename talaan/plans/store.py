"""State changes over the stored tables, as snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from talaan.operators import enrichment, snapshots
from talaan.plans.registry import Registry
from talaan.runtime import table

R = Registry()
query = R.query
CUTOFF = "2026-06-01 00:00:00"
GONE = "gmail.com"
_L = "(SELECT DISTINCT ON (lead_id) * FROM leads)"


def _refs(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("source", "source_ref", "run_id", "record_id")


@query("""SELECT source, source_ref, run_id, record_id FROM raw_records WHERE fetched_at < TIMESTAMP '2026-06-01' UNION ALL
SELECT source, source_ref, run_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY source, source_ref ORDER BY record_id) AS n FROM raw_records WHERE fetched_at >= TIMESTAMP '2026-06-01') b
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM raw_records a WHERE a.fetched_at < TIMESTAMP '2026-06-01' AND a.source = b.source AND a.source_ref = b.source_ref)""")
def insert_or_ignore(spark, sf_dir):
    raw, t = table(spark, sf_dir, "raw_records"), F.lit(CUTOFF).cast("timestamp_ntz")
    cols = ["source", "source_ref", "run_id", "record_id"]
    old, new = raw.where(F.col("fetched_at") < t).select(*cols), raw.where(F.col("fetched_at") >= t).select(*cols)
    return snapshots.insert_or_ignore(old, new, ["source", "source_ref"], [F.col("record_id")]).select(*cols)


@query("""SELECT run_id, run_status, n FROM (SELECT run_id, run_status, 1 AS n FROM runs WHERE created_at < TIMESTAMP '2026-06-01' AND run_id NOT IN (SELECT run_id FROM runs WHERE category = 'cafe')
UNION ALL SELECT run_id, 'replaced', 2 FROM runs WHERE category = 'cafe')""")
def insert_or_replace(spark, sf_dir):
    r = table(spark, sf_dir, "runs")
    old = r.where(F.col("created_at") < F.lit(CUTOFF).cast("timestamp_ntz")).select("run_id", "run_status", F.lit(1).alias("n"))
    new = r.where("category = 'cafe'").select("run_id", F.lit("replaced").alias("run_status"), F.lit(2).alias("n"))
    return snapshots.insert_or_replace(old, new, ["run_id"])


_AT = "ends_with('.' || coalesce(regexp_extract({e}, '@(.*)$', 1), ''), '.mail.example')"


@query(f"""SELECT 'leads' AS part, count(*) AS n FROM {_L} WHERE NOT (coalesce(domain = 'mail.example', false) OR {_AT.format(e='email')} OR len(list_filter(emails_extra, lambda x: {_AT.format(e='x')})) > 0)
UNION ALL SELECT 'raw', count(*) FROM raw_records WHERE len(list_filter(emails_raw, lambda x: {_AT.format(e='lower(x)')})) = 0""")
def forget_domain(spark, sf_dir):
    l, r = snapshots.forget(table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]), table(spark, sf_dir, "raw_records"), "mail.example")
    return l.agg(F.count("*").alias("n")).select(F.lit("leads").alias("part"), "n").unionByName(r.agg(F.count("*").alias("n")).select(F.lit("raw").alias("part"), "n"))


_GONE_PHONES = "(SELECT phone FROM leads WHERE phone IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lead_id) > 2)"
_GONE_MAILS = "(SELECT email FROM leads WHERE email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lead_id) > 1)"


@query(f"""SELECT DISTINCT lead_id FROM (
SELECT lead_id, unnest(list_concat([phone], phones_extra)) AS v FROM leads) WHERE v IN {_GONE_PHONES} UNION SELECT DISTINCT lead_id FROM (SELECT lead_id, unnest(list_concat([email], emails_extra)) AS v FROM leads) WHERE v IN {_GONE_MAILS}""")
def forget_contacts(spark, sf_dir):
    """Leads to forget for lists of phones (those of more than two leads) and e-mails (of more than one)."""
    l = table(spark, sf_dir, "leads")
    many = lambda c, n: l.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("lead_id").alias("n")).where(F.col("n") > n).select(F.lit(c).alias("kind"), F.col(c).alias("value"))
    return snapshots.to_forget(l, many("phone", 2).unionByName(many("email", 1)))


@query(f"""SELECT 'raw' AS part, count(*) AS n FROM raw_records WHERE fetched_at >= TIMESTAMP '{CUTOFF}' OR run_id IN (SELECT run_id FROM runs WHERE run_status IN ('partial', 'running'))
UNION ALL SELECT 'leads', count(*) FROM leads WHERE last_seen_at >= TIMESTAMP '{CUTOFF}'""")
def purge_cutoff(spark, sf_dir):
    r, l = snapshots.purge(*(table(spark, sf_dir, t) for t in ("raw_records", "runs", "leads")), CUTOFF)
    return r.agg(F.count("*").alias("n")).select(F.lit("raw").alias("part"), "n").unionByName(l.agg(F.count("*").alias("n")).select(F.lit("leads").alias("part"), "n"))


@query("SELECT DISTINCT r.run_id, r.source FROM raw_records r JOIN runs USING (run_id) WHERE run_status = 'completed'")
def cascade_links(spark, sf_dir):
    keep = table(spark, sf_dir, "runs").where("run_status = 'completed'").select("run_id")
    return table(spark, sf_dir, "raw_records").select("run_id", "source").join(keep, "run_id", "left_semi").distinct()


@query("""SELECT DISTINCT l.first_seen_run_id AS run_id, coalesce(m.keep_id, l.lead_id) AS lead_id FROM leads l LEFT JOIN
(SELECT lead_id_b AS drop_id, min(lead_id_a) AS keep_id FROM possible_duplicates WHERE match_rule = 1 AND lead_id_a <> '' AND lead_id_b <> '' GROUP BY 1) m ON l.lead_id = m.drop_id""")
def repoint_links(spark, sf_dir):
    moves = table(spark, sf_dir, "possible_duplicates").where("match_rule = 1 and lead_id_a <> '' and lead_id_b <> ''")
    moves = moves.groupBy(F.col("lead_id_b").alias("drop_id")).agg(F.min("lead_id_a").alias("keep_id"))
    return snapshots.repoint(table(spark, sf_dir, "leads").select(F.col("first_seen_run_id").alias("run_id"), "lead_id"), moves)


@query("""WITH g AS (SELECT DISTINCT lead_id FROM leads WHERE score < 60), r AS (SELECT DISTINCT lead_id FROM leads WHERE score >= 40), s AS (SELECT DISTINCT lead_id FROM leads WHERE website IS NOT NULL),
o AS (SELECT count(*) > 0 AS any_left FROM g WHERE lead_id IN (SELECT lead_id FROM s))
SELECT coalesce(g.lead_id, r.lead_id) AS lead_id, CASE WHEN r.lead_id IS NULL THEN 'keep' WHEN g.lead_id IS NOT NULL THEN 'update' WHEN s.lead_id IS NOT NULL AND any_left THEN 'skip' ELSE 'append' END AS action
FROM g FULL JOIN r ON g.lead_id = r.lead_id LEFT JOIN s ON s.lead_id = coalesce(g.lead_id, r.lead_id), o""")
def sheet_upsert_plan(spark, sf_dir):
    l = table(spark, sf_dir, "leads")
    return snapshots.upsert_plan(l.where("score < 60"), l.where("score >= 40"), l.where("website is not null"), "lead_id")


_ROW = "SELECT domain, min(phone) AS phone, min(city) AS city FROM leads WHERE domain IS NOT NULL AND {w} GROUP BY 1"


@query(f"""SELECT r.domain, CASE WHEN t.domain IS NULL THEN 'create' WHEN (coalesce(t.phone, '') = '' AND coalesce(r.phone, '') <> '') OR (coalesce(t.city, '') = '' AND coalesce(r.city, '') <> '') THEN 'fill' ELSE 'none' END AS action,
CASE WHEN coalesce(t.phone, '') = '' THEN r.phone ELSE t.phone END AS phone, CASE WHEN coalesce(t.city, '') = '' THEN r.city ELSE t.city END AS city
FROM ({_ROW.format(w="last_seen_at >= TIMESTAMP '" + CUTOFF + "'")}) r LEFT JOIN ({_ROW.format(w="last_seen_at < TIMESTAMP '" + CUTOFF + "'")}) t USING (domain)""")
def company_fill_empty(spark, sf_dir):
    l, t = table(spark, sf_dir, "leads").where("domain is not null"), F.lit(CUTOFF).cast("timestamp_ntz")
    one = lambda df: df.groupBy("domain").agg(F.min("phone").alias("phone"), F.min("city").alias("city"))
    return snapshots.fill_plan(one(l.where(F.col("last_seen_at") < t)), one(l.where(F.col("last_seen_at") >= t)), "domain", ["phone", "city"])


@query(f"""SELECT lead_id, CASE WHEN ends_with(email, '.mail.example') THEN coalesce('info@' || domain, 'someone@gmail.com') ELSE email END AS email,
CASE WHEN ends_with(coalesce(email, ''), '.mail.example') THEN CASE WHEN domain IS NULL THEN 'zed@other.example' ELSE 'someone@gmail.com,zed@other.example' END ELSE array_to_string(['zed@other.example', 'someone@gmail.com', 'info@' || domain], ',') END AS extra,
CAST(ends_with(coalesce(email, ''), '.mail.example') AS INT) AS n_dropped FROM {_L}""")
def dead_emails_dropped(spark, sf_dir):
    """The scoring step's rewrite: hosts below mail.example are known to take no mail, and what is left is ranked again.

    Each lead is given three more e-mails, at another host, a free provider and, where it has a domain, its own.
    """
    more = F.array_compact(F.array(F.lit("zed@other.example"), F.lit("someone@gmail.com"), F.concat(F.lit("info@"), "domain")))
    l = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]).withColumn("emails_extra", more)
    dead = l.where("email like '%.mail.example'").select(F.lower(F.substring_index("email", "@", -1)).alias("host"), F.lit(False).alias("has_mail")).distinct()
    return enrichment.without_dead_emails(l, dead).select("lead_id", "email", F.array_join("emails_extra", ",").alias("extra"), "n_dropped")


@query("SELECT run_id, CAST(coalesce(try_cast(json_extract(run_options, '$.search.seconds') AS DOUBLE), 0) AS DOUBLE) AS seconds, coalesce(json_extract_string(run_options, '$.batch'), 'none') AS batch FROM runs")
def run_stats(spark, sf_dir):
    """Seconds of a run's steps, and its options over defaults."""
    r = table(spark, sf_dir, "runs")
    given = F.from_json("run_options", "map<string,string>")
    opts = enrichment.merged_stats(F.create_map(F.lit("batch"), F.lit("none")), F.coalesce(given, F.create_map().cast("map<string,string>")))
    return r.select("run_id", enrichment.run_seconds(F.col("run_options")).alias("seconds"), opts["batch"].alias("batch"))


QUERIES, SQL = R.queries, R.sql
