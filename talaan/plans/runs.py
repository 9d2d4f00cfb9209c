"""Runs and their leads: joins, as-of and anti joins, counts, windows, top-k and predicates over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.plans.registry import Registry
from talaan.runtime import table

R = Registry()
query = R.query
NOW = "2026-12-01 12:00:00"

# run_leads: which leads a run brought first, each once
_LINKS = "(SELECT DISTINCT first_seen_run_id AS run_id, lead_id FROM leads)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "leads").select(F.col("first_seen_run_id").alias("run_id"), "lead_id").distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs")


@query(f"SELECT l.run_id, l.lead_id, r.category, r.created_at FROM {_LINKS} l JOIN runs r USING (run_id)")
def leads_for_run(spark, sf_dir):
    return links(spark, sf_dir).join(runs(spark, sf_dir).select("run_id", "category", "created_at"), "run_id")


@query("""SELECT a.source, a.source_ref, count(*) AS n_rows, count(DISTINCT a.run_id) AS n_runs FROM raw_records a
JOIN (SELECT DISTINCT source, source_ref FROM raw_records WHERE housenumber IS NOT NULL) b ON a.source = b.source AND a.source_ref = b.source_ref GROUP BY 1, 2""")
def lead_by_source_ref(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_records").select("source", "source_ref", "run_id", "housenumber")
    known = raw.where("housenumber is not null").select("source", "source_ref")
    return raw.join(known, ["source", "source_ref"], "left_semi").groupBy("source", "source_ref").agg(F.count("*").alias("n_rows"), F.countDistinct("run_id").alias("n_runs"))


_BASE = "CASE WHEN json_extract_string({t}.run_options, '$.batch') LIKE '%@%' AND json_extract_string({t}.run_options, '$.monitor') = 'true' THEN regexp_replace(json_extract_string({t}.run_options, '$.batch'), '@[^@]*$', '') END"
_PREV_OF = """SELECT run_id, prev_run_id FROM (SELECT a.run_id, b.run_id AS prev_run_id, row_number() OVER (PARTITION BY a.run_id ORDER BY b.created_at DESC, b.run_id DESC) AS n
FROM {r} a JOIN {r} b ON a.category = b.category AND CASE WHEN a.area_kind = 'area' AND a.area_id IS NOT NULL THEN a.area_id = b.area_id ELSE lower(a.location) = lower(b.location) END
AND ({base_a} IS NULL OR {base_a} = {base_b}) AND b.created_at <= a.created_at AND a.run_id <> b.run_id AND b.run_status = 'completed') WHERE n = 1"""
_MONITORED = "(SELECT * EXCLUDE (run_options), CASE WHEN json_extract_string(run_options, '$.batch') IS NOT NULL AND limit_n % 200 <> 0 THEN json_object('batch', json_extract_string(run_options, '$.batch'), 'monitor', true)::VARCHAR ELSE run_options END AS run_options FROM runs)"
_PREV = _PREV_OF.format(r="runs", base_a=_BASE.format(t="a"), base_b=_BASE.format(t="b"))


def monitor_base(options):
    """The name of the monitor that a run belongs to: its batch without the week; null for other runs."""
    batch = F.get_json_object(options, "$.batch")
    return F.when((F.get_json_object(options, "$.monitor") == "true") & F.contains(batch, F.lit("@")), F.regexp_replace(batch, "@[^@]*$", ""))


def previous_of(r: DataFrame) -> DataFrame:
    """``run_id``, ``prev_run_id``: the latest completed earlier run of the same category over the same area.

    Runs over a known area are compared by its id, others by location. For a run of a monitor only runs of that monitor count. Runs of one
    search are laid out by time once for each way they can be compared, and each run looks back over those, so no pairs are made.
    """
    base = r.select("run_id", "category", "created_at", "run_status", monitor_base(F.col("run_options")).alias("base"), "area_id", F.lower("location").alias("place"), ((F.col("area_kind") == "area") & F.col("area_id").isNotNull()).alias("by_area"))
    area, place = F.concat(F.lit("a"), F.col("area_id").cast("string")), F.concat(F.lit("p"), "place")
    asks = F.struct(F.when(F.coalesce("by_area", F.lit(False)), area).otherwise(place).alias("where"), F.coalesce(F.concat(F.lit("m"), "base"), F.lit("*")).alias("whose"))
    kept = F.filter(F.flatten(F.transform(F.array(area, place), lambda w: F.transform(F.array(F.lit("*"), F.concat(F.lit("m"), "base")), lambda m: F.struct(w.alias("where"), m.alias("whose"))))), lambda x: x["where"].isNotNull() & x["whose"].isNotNull())
    done = base.where("run_status = 'completed'").select("category", "created_at", "run_id", F.explode(kept).alias("key"), F.lit(True).alias("done"))
    look = base.select("category", "created_at", "run_id", asks.alias("key"), F.lit(False).alias("done"))
    # at one time all completed runs come before those that look back; a run never finds itself
    w = W.partitionBy("category", "key").orderBy("created_at", F.desc("done"), "run_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.when(F.col("done"), F.struct("created_at", "run_id"))
    rows = done.unionByName(look).withColumn("last", F.max(seen).over(w))
    own = rows.where("not done").select("run_id", "created_at", "key", "category", "last")
    hit = own.where("last is not null and last.run_id <> run_id").select("run_id", F.col("last.run_id").alias("prev_run_id"))
    # a run that found itself, being completed and latest, takes the one before itself
    self_ = own.where("last.run_id = run_id").select("run_id", "category", "key")
    before = done.withColumn("prev", F.max(F.struct("created_at", "run_id")).over(W.partitionBy("category", "key").orderBy("created_at", "run_id").rowsBetween(W.unboundedPreceding, -1)))
    again = self_.join(before.select("run_id", "category", "key", "prev"), ["run_id", "category", "key"]).where("prev is not null").select("run_id", F.col("prev.run_id").alias("prev_run_id"))
    return hit.unionByName(again)


def previous(spark, sf_dir) -> DataFrame:
    return previous_of(runs(spark, sf_dir))


@query(_PREV_OF.format(r=_MONITORED, base_a=_BASE.format(t="a"), base_b=_BASE.format(t="b")))
def previous_monitor_run(spark, sf_dir):
    """The same where batch runs with a limit that isn't a multiple of 200 belong to monitors, as no run in the tables does."""
    batch = F.get_json_object("run_options", "$.batch")
    options = F.when(batch.isNotNull() & (F.col("limit_n") % 200 != 0), F.to_json(F.struct(batch.alias("batch"), F.lit(True).alias("monitor")))).otherwise(F.col("run_options"))
    return previous_of(runs(spark, sf_dir).withColumn("run_options", options))


@query(_PREV)
def previous_run_asof(spark, sf_dir):
    return previous(spark, sf_dir)


@query(f"""SELECT l.run_id, l.lead_id FROM {_LINKS} l JOIN ({_PREV}) p USING (run_id)
WHERE NOT EXISTS (SELECT 1 FROM {_LINKS} x WHERE x.run_id = p.prev_run_id AND x.lead_id = l.lead_id)""")
def new_since_previous(spark, sf_dir):
    l = links(spark, sf_dir)
    mine = l.join(previous(spark, sf_dir), "run_id")
    return mine.join(l.select(F.col("run_id").alias("prev_run_id"), "lead_id"), ["prev_run_id", "lead_id"], "left_anti").select("run_id", "lead_id")


@query(f"SELECT l.run_id, count(*) AS n_new FROM {_LINKS} l WHERE l.run_id NOT IN (SELECT run_id FROM ({_PREV})) GROUP BY 1")
def first_run_all_new(spark, sf_dir):
    return links(spark, sf_dir).join(previous(spark, sf_dir).select("run_id"), "run_id", "left_anti").groupBy("run_id").agg(F.count("*").alias("n_new"))


@query("SELECT record_id, source_ref FROM raw_records WHERE source = 'osm' AND source_ref IN (SELECT source_ref FROM raw_records WHERE facebook IS NOT NULL)")
def leads_in_semi(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_records")
    return raw.where("source = 'osm'").select("record_id", "source_ref").join(raw.where("facebook is not null").select("source_ref"), "source_ref", "left_semi").select("record_id", "source_ref")


@query("SELECT DISTINCT lead_id FROM leads WHERE len(list_filter(tech, lambda x: x = 'wordpress')) > 0 OR list_contains(categories, 'gym')")
def array_exists(spark, sf_dir):
    return table(spark, sf_dir, "leads").where(F.exists("tech", lambda x: x == "wordpress") | F.array_contains("categories", "gym")).select("lead_id").distinct()


@query("SELECT run_id, count(*) AS n_raw, count(DISTINCT source) AS n_sources FROM raw_records GROUP BY 1")
def raw_for_run(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").groupBy("run_id").agg(F.count("*").alias("n_raw"), F.countDistinct("source").alias("n_sources"))


@query(f"SELECT (SELECT count(*) FROM raw_records) AS n_raw, (SELECT count(*) FROM {_LINKS}) AS n_links, (SELECT count(*) FROM (SELECT DISTINCT source, source_ref FROM raw_records)) AS n_refs")
def table_counts(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_records")
    one = [
        raw.agg(F.count("*").alias("n")).withColumn("k", F.lit("raw")), links(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("k", F.lit("links")),
        raw.select("source", "source_ref").distinct().agg(F.count("*").alias("n")).withColumn("k", F.lit("refs")),
    ]
    u = one[0].unionByName(one[1]).unionByName(one[2])
    return u.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"n_{k}") for k in ("raw", "links", "refs")))


@query(f"SELECT run_id, count(*) AS n_leads FROM {_LINKS} GROUP BY 1")
def run_lead_counts(spark, sf_dir):
    return links(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n_leads"))


@query("SELECT first_seen_run_id AS run_id, enrich_status, count(DISTINCT lead_id) AS n FROM leads GROUP BY 1, 2")
def enrich_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "leads").groupBy(F.col("first_seen_run_id").alias("run_id"), "enrich_status").agg(F.countDistinct("lead_id").alias("n"))


@query("SELECT phone, count(DISTINCT name_key) AS n_names FROM leads WHERE phone IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name_key) >= 3")
def shared_phones(spark, sf_dir):
    names = table(spark, sf_dir, "leads").where("phone is not null").groupBy("phone").agg(F.countDistinct("name_key").alias("n_names"))
    return names.where("n_names >= 3")


@query("SELECT r.run_id, count(DISTINCT CASE WHEN l.first_seen_run_id = r.run_id THEN l.lead_id END) AS n_new FROM runs r LEFT JOIN leads l ON l.first_seen_run_id = r.run_id GROUP BY 1")
def new_lead_counts(spark, sf_dir):
    l = links(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    return runs(spark, sf_dir).select("run_id").join(l, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_new"))


@query("""SELECT run_id, lead_id, row_number() OVER (PARTITION BY run_id ORDER BY first_at, lead_id) - 1 AS position
FROM (SELECT first_seen_run_id AS run_id, lead_id, min(first_seen_at) AS first_at FROM leads GROUP BY 1, 2)""")
def run_positions(spark, sf_dir):
    first = table(spark, sf_dir, "leads").groupBy(F.col("first_seen_run_id").alias("run_id"), "lead_id").agg(F.min("first_seen_at").alias("first_at"))
    return first.select("run_id", "lead_id", (F.row_number().over(W.partitionBy("run_id").orderBy("first_at", "lead_id")) - 1).alias("position"))


@query("""SELECT batch, category, run_id FROM (SELECT json_extract_string(run_options, '$.batch') AS batch, category, run_id,
row_number() OVER (PARTITION BY json_extract_string(run_options, '$.batch'), category ORDER BY created_at DESC, run_id DESC) AS n FROM runs) WHERE batch IS NOT NULL AND n = 1""")
def batch_latest_per_row(spark, sf_dir):
    b = runs(spark, sf_dir).select(F.get_json_object("run_options", "$.batch").alias("batch"), "category", "run_id", "created_at").where("batch is not null")
    return b.groupBy("batch", "category").agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_per_user_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", "created_at").orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


@query("SELECT run_id, category, run_status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20")
def list_runs(spark, sf_dir):
    return runs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("run_id")).limit(20).select("run_id", "category", "run_status")


_KEY = "category || '|' || lower(regexp_replace(trim(coalesce(area_name, location)), '\\s+', ' ', 'g'))"


def search_key():
    return F.concat_ws("|", "category", F.lower(F.regexp_replace(F.trim(F.coalesce("area_name", "location")), r"\s+", " ")))


@query(f"""SELECT k AS search_key, run_id, dense_rank() OVER (ORDER BY newest DESC, k) AS group_no, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, run_id DESC) AS place
FROM (SELECT *, max(created_at) OVER (PARTITION BY k) AS newest FROM (SELECT run_id, created_at, {_KEY} AS k FROM runs))""")
def group_runs_newest_first(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_id", "created_at", search_key().alias("search_key"))
    groups = r.groupBy("search_key").agg(F.max("created_at").alias("newest"))
    numbered = groups.select("search_key", F.row_number().over(W.orderBy(F.desc("newest"), "search_key")).alias("group_no"))  # one row per search, bounded by searches
    place = F.row_number().over(W.partitionBy("search_key").orderBy(F.desc("created_at"), F.desc("run_id")))
    return r.join(numbered, "search_key").select("search_key", "run_id", "group_no", place.alias("place"))


@query(f"""SELECT k AS search_key, run_id FROM (SELECT k, run_id, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, run_id DESC) AS n, max(created_at) OVER (PARTITION BY k) AS newest
FROM (SELECT run_id, created_at, {_KEY} AS k FROM runs)) WHERE n = 1 ORDER BY newest DESC, k LIMIT 8""")
def sidebar_groups(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_id", "created_at", search_key().alias("search_key"))
    top = r.groupBy("search_key").agg(F.max(F.struct("created_at", "run_id")).alias("m")).orderBy(F.desc("m.created_at"), "search_key").limit(8)
    return top.select("search_key", "m.run_id")


@query("""SELECT run_id, CASE WHEN n > 1 THEN label || ' · #' || substr(run_id, 1, 6) ELSE label END AS label
FROM (SELECT run_id, category || ' in ' || location AS label, count(*) OVER (PARTITION BY category || ' in ' || location) AS n FROM runs)""")
def run_labels(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_id", F.concat_ws(" in ", "category", "location").alias("label"))
    n = F.count("*").over(W.partitionBy("label"))
    return r.select("run_id", F.when(n > 1, F.concat("label", F.lit(" · #"), F.substring("run_id", 1, 6))).otherwise(F.col("label")).alias("label"))


@query("SELECT min(run_id) AS run_id, count(*) AS n FROM runs WHERE run_id LIKE '61c33%' HAVING count(*) = 1")
def run_by_prefix(spark, sf_dir):
    return runs(spark, sf_dir).where(F.col("run_id").startswith("61c33")).agg(F.min("run_id").alias("run_id"), F.count("*").alias("n")).where("n = 1")


@query("SELECT json_extract_string(run_options, '$.batch') AS batch, count(*) AS n, count(CASE WHEN run_status = 'completed' THEN 1 END) AS done FROM runs WHERE json_extract_string(run_options, '$.batch') IS NOT NULL GROUP BY 1")
def batch_caption(spark, sf_dir):
    b = runs(spark, sf_dir).select(F.get_json_object("run_options", "$.batch").alias("batch"), "run_status").where("batch is not null")
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("run_status") == "completed").alias("done"))


@query("SELECT run_id, run_status, current_step FROM runs WHERE run_status IN ('partial', 'running') AND current_step <> 'done'")
def can_resume(spark, sf_dir):
    return runs(spark, sf_dir).where("run_status in ('partial', 'running') and current_step <> 'done'").select("run_id", "run_status", "current_step")


@query("SELECT run_id FROM runs WHERE contains(lower(category || ' ' || location || ' ' || run_id), 'cafe') AND contains(lower(category || ' ' || location || ' ' || run_id), 'sa') AND run_status IN ('completed', 'partial')")
def run_word_filter(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "category", "location", "run_id"))
    words = F.split(F.lit("cafe sa"), " ")
    hit = runs(spark, sf_dir).withColumn("text", text).withColumn("words", words)
    return hit.where(F.forall("words", lambda w: F.contains(F.col("text"), w)) & F.col("run_status").isin("completed", "partial")).select("run_id")


@query(f"""SELECT r.run_id, strftime(r.created_at, '%Y-%m-%d %H:%M') AS started, r.category || ' in ' || r.location AS search, r.run_status, coalesce(c.n, 0) AS n_leads
FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM {_LINKS} GROUP BY 1) c USING (run_id)""")
def run_rows(spark, sf_dir):
    c = run_lead_counts(spark, sf_dir)
    r = runs(spark, sf_dir).join(c, "run_id", "left")
    return r.select("run_id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("started"), F.concat_ws(" in ", "category", "location").alias("search"), "run_status", F.coalesce("n_leads", F.lit(0)).alias("n_leads"))


@query("""SELECT run_id, 'weekly@' || isoyear(created_at) || '-W' || lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0') AS batch FROM runs""")
def iso_week_batch(spark, sf_dir):
    year = F.extract(F.lit("YEAROFWEEK"), F.col("created_at")).cast("string")
    return runs(spark, sf_dir).select("run_id", F.concat(F.lit("weekly@"), year, F.lit("-W"), F.lpad(F.weekofyear("created_at").cast("string"), 2, "0")).alias("batch"))


@query(f"""SELECT run_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || ' days ago' END AS ago
FROM (SELECT run_id, CAST(floor(epoch(TIMESTAMP '{NOW}' - created_at)) AS BIGINT) AS s FROM runs WHERE created_at <= TIMESTAMP '{NOW}')""")
def ago(spark, sf_dir):
    s = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000)
    r = runs(spark, sf_dir).where(F.col("created_at") <= F.lit(NOW).cast("timestamp_ntz")).select("run_id", s.alias("s"))
    n = lambda d: F.floor(F.col("s") / d).cast("string")
    out = F.when(F.col("s") < 60, "just now").when(F.col("s") < 3600, F.concat(n(60), F.lit(" min ago"))).when(F.col("s") < 86400, F.concat(n(3600), F.lit(" h ago")))
    return r.select("run_id", out.when(F.col("s") < 172800, "yesterday").otherwise(F.concat(n(86400), F.lit(" days ago"))).alias("ago"))


@query("SELECT run_id, (s // 60) || ' min ' || (s % 60) || ' s' AS duration FROM (SELECT run_id, CAST(round_even(epoch(finished_at - created_at), 0) AS BIGINT) AS s FROM runs WHERE finished_at IS NOT NULL)")
def run_duration(spark, sf_dir):
    s = F.bround((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6, 0).cast("long")
    r = runs(spark, sf_dir).where("finished_at is not null").select("run_id", s.alias("s"))
    return r.select("run_id", F.concat(F.floor(F.col("s") / 60).cast("string"), F.lit(" min "), F.pmod("s", F.lit(60)).cast("string"), F.lit(" s")).alias("duration"))


@query("SELECT run_id, strftime(created_at + INTERVAL 8 HOUR, '%b %-d, %H:%M') AS local_time FROM runs")
def short_time(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", F.date_format(F.col("created_at") + F.expr("interval 8 hours"), "MMM d, HH:mm").alias("local_time"))


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ttl_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts")).scalar()
    return e.where(F.col("ts") > newest - F.expr("interval 24 hours")).select("event_id", "user_id")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props_hist(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query(f"""SELECT lead_id FROM leads WHERE website IS NOT NULL AND website <> '' AND (enrich_status IN ('pending', 'failed') OR (enrich_status = 'ok' AND enriched_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)) GROUP BY 1""")
def leads_to_enrich(spark, sf_dir):
    old = (F.col("enrich_status") == "ok") & (F.col("enriched_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 90 days"))
    return table(spark, sf_dir, "leads").where("website <> ''").where(F.col("enrich_status").isin("pending", "failed") | old).select("lead_id").distinct()


@query("""SELECT r.run_id, j.n AS row_no, CASE WHEN r.run_id IS NULL THEN 'create' WHEN r.run_status = 'completed' THEN 'skip' ELSE 'resume' END AS action
FROM (SELECT row_number() OVER (ORDER BY c, p) AS n, c, p FROM (SELECT DISTINCT category AS c, lower(location) AS p FROM runs)) j
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, lower(location) ORDER BY created_at DESC, run_id DESC) AS k FROM runs WHERE limit_n >= 200) WHERE k = 1) r ON r.category = j.c AND lower(r.location) = j.p""")
def job_actions(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("place", F.lower("location"))
    jobs = r.select("category", "place").distinct().withColumn("row_no", F.row_number().over(W.orderBy("category", "place")))  # as many rows as jobs
    last = r.where("limit_n >= 200").groupBy("category", "place").agg(F.max(F.struct("created_at", "run_id", "run_status")).alias("m"))
    j = jobs.join(last, ["category", "place"], "left")
    action = F.when(F.col("m.run_id").isNull(), "create").when(F.col("m.run_status") == "completed", "skip").otherwise("resume")
    return j.select("m.run_id", "row_no", action.alias("action"))


@query(f"""SELECT 'union' AS op, count(*) AS n FROM (SELECT lead_id FROM leads WHERE website IS NOT NULL UNION SELECT lead_id FROM leads WHERE facebook IS NOT NULL)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT lead_id FROM leads WHERE website IS NOT NULL INTERSECT SELECT lead_id FROM leads WHERE facebook IS NOT NULL)
UNION ALL SELECT 'except', count(*) FROM (SELECT lead_id FROM leads WHERE website IS NOT NULL EXCEPT SELECT lead_id FROM leads WHERE facebook IS NOT NULL)""")
def set_algebra(spark, sf_dir):
    l = table(spark, sf_dir, "leads")
    a, b = l.where("website is not null").select("lead_id"), l.where("facebook is not null").select("lead_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


QUERIES, SQL = R.queries, R.sql
