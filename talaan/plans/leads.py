"""Scores, segments, summaries and keys of leads, and text functions over raw records and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.functions import dims, names, score, web
from talaan.functions.text import MISREAD
from talaan.operators import export
from talaan.plans.registry import Registry
from talaan.runtime import table

R = Registry()
query = R.query
YEAR = 2026


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# the leads, each once, with what the queries below share
_L = "(SELECT DISTINCT ON (lead_id) * FROM leads)"
_MAILHOST = "regexp_extract(email, '@(.*)$', 1)"


def _reg(h: str) -> str:
    two = f"regexp_extract({h}, '([^.]+\\.[^.]+)$', 1)"
    three = f"regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1)"
    return f"CASE WHEN {two} = '' OR regexp_matches({h}, '^[0-9.]+$') THEN NULL WHEN {two} IN {_in(dims.SUFFIXES)} OR regexp_full_match({two}, '{dims.COUNTRY_SUFFIX}') THEN nullif({three}, '') ELSE {two} END"


_OWN = f"(coalesce(email, '') <> '' AND coalesce(domain, '') <> '' AND domain NOT IN {_in(dims.SHARED_HOSTS)} AND coalesce({_reg(_MAILHOST)} = domain, false))"
_HAS = lambda c: f"(coalesce({c}, '') <> '')"
_SCORE = (
    f"least(100, {_HAS('email')}::INT * 30 + {_OWN}::INT * 10 + {_HAS('phone')}::INT * 20 + {_HAS('website')}::INT * 15 + {_HAS('facebook')}::INT * 10 + "
    f"{_HAS('street_key')}::INT * 10 + {_HAS('opening_hours')}::INT * 5)"
)
_TESTS = [
    ("no_website", f"NOT {_HAS('website')}"), ("social_only", f"NOT {_HAS('website')} AND {_HAS('facebook')}"), ("no_https", "https_ok = false"),
    ("no_mobile_viewport", "mobile_viewport = false"), ("free_email_provider", f"{_HAS('email')} AND {_MAILHOST} IN {_in(dims.FREE_MAIL)}"),
    ("stale_site", f"site_signals IS NOT NULL AND CAST(nullif(regexp_extract(list_filter(site_signals, lambda x: starts_with(x, 'copyright:'))[1], '([0-9]+)$', 1), '') AS INT) <= {YEAR - 3}"),
    ("no_analytics", "site_signals IS NOT NULL AND len(list_filter(site_signals, lambda x: starts_with(x, 'analytics:') OR starts_with(x, 'pixel:'))) = 0"),
    ("no_online_booking", f"site_signals IS NOT NULL AND len(list_filter(site_signals, lambda x: starts_with(x, 'booking:'))) = 0 AND list_has_any(categories, {list(dims.BY_APPOINTMENT)})"),
]
_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _TESTS) + "], lambda x: x IS NOT NULL)"
_LOCAL = "lower(regexp_extract(email, '^([^@]*)', 1))"
_PERSON = r"^(?:dra?\.?)?([a-z]{2,})[._-]([a-z]{2,})(?:[._-][a-z]{1,})?[0-9]*$"
_KIND = f"""CASE WHEN NOT {_HAS('email')} THEN ''
WHEN list_has_any(list_transform(string_split_regex({_LOCAL}, '[._+-]'), lambda w: regexp_replace(w, '[0-9]+$', '')), {dims.ROLES})
  OR len(list_filter(string_split(coalesce(name_key, ''), ' '), lambda w: length(w) >= 3 AND contains({_LOCAL}, w))) > 0 THEN 'business'
WHEN regexp_matches({_LOCAL}, '{_PERSON}') AND regexp_extract({_LOCAL}, '{_PERSON}', 1) NOT IN {_in(dims.ROLES)} AND regexp_extract({_LOCAL}, '{_PERSON}', 2) NOT IN {_in(dims.ROLES)} THEN 'personal'
WHEN regexp_matches({_LOCAL}, '^dra?[._-]?[a-z]{{3,}}[0-9]*$') THEN 'personal' ELSE 'unknown' END"""
_SCORED = f"(SELECT * EXCLUDE (score, flags), {_SCORE} AS score, {_FLAGS} AS flags, {_KIND} AS kind FROM {_L})"


def scored(spark, sf_dir) -> DataFrame:
    """The leads, each once, rescored. Only the columns a query keeps are read."""
    l = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"])
    return l.withColumn("score", score.score()).withColumn("flags", score.flags(YEAR))


@query(f"SELECT lead_id, score, array_to_string(flags, ',') AS flags FROM {_SCORED}")
def score_leads(spark, sf_dir):
    return scored(spark, sf_dir).select("lead_id", "score", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT band, count(lead_id) AS n FROM (SELECT unnest(range(5)) AS band) LEFT JOIN {_SCORED} ON least(greatest(score, 0) // 20, 4) = band GROUP BY 1")
def score_bands(spark, sf_dir):
    n = scored(spark, sf_dir).groupBy(F.least(F.floor(F.greatest("score", F.lit(0)) / 20), F.lit(4)).alias("band")).agg(F.count("*").alias("k"))
    return spark.range(5).withColumnRenamed("id", "band").join(n, "band", "left").select("band", F.coalesce("k", F.lit(0)).alias("n"))


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {_SCORED}) GROUP BY 1")
def flag_histogram(spark, sf_dir):
    return scored(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"SELECT first_seen_run_id AS run_id, count(*) AS scored, round(avg(score), 1) AS average_score FROM {_SCORED} GROUP BY 1")
def run_score_stats(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count("*").alias("scored"), F.round(F.avg("score"), 1).alias("average_score"))


_SEG = {
    "no-website": f"NOT {_HAS('website')}", "facebook-only": "list_contains(flags, 'social_only')",
    "website-upgrade": f"{_HAS('website')} AND list_has_any(flags, ['no_https', 'no_mobile_viewport', 'stale_site'])", "no-booking": "list_contains(flags, 'no_online_booking')",
    "business-email": f"{_HAS('email')} AND kind <> 'personal'",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS segment, count(CASE WHEN {c} THEN 1 END) AS n FROM {_SCORED}" for k, c in _SEG.items()))
def segment_counts(spark, sf_dir):
    segs = score.segments()
    one = scored(spark, sf_dir).agg(*(F.count_if(c).alias(k) for k, c in segs.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), F.col(f"`{k}`").alias("n")) for k in segs))).alias("s")).select("s.*")


@query(" UNION ALL ".join(f"SELECT '{k}' AS segment, lead_id FROM {_SCORED} WHERE {c}" for k, c in _SEG.items()))
def segment_members(spark, sf_dir):
    segs = score.segments()
    named = F.array_compact(F.array(*(F.when(c, k) for k, c in segs.items())))
    return scored(spark, sf_dir).select(F.explode(named).alias("segment"), "lead_id")


_SUMMARY = [
    ("Reachable", f"{_HAS('email')} OR {_HAS('phone')} OR {_HAS('website')} OR {_HAS('facebook')}"), ("With email", _HAS("email")), ("With phone", _HAS("phone")),
    ("With website", _HAS("website")), ("With Facebook", _HAS("facebook")), ("Personal-name emails", "kind = 'personal'"),
    *((f"Opening: {t}", f"list_contains(flags, '{f}')") for f, t in dims.REASONS),
]


@query(
    f"WITH s AS {_SCORED} SELECT 'Leads' AS metric, CAST(count(*) AS VARCHAR) AS value FROM s UNION ALL "
    + "SELECT 'New this run', '—' UNION ALL SELECT 'Duplicates merged', '0' UNION ALL SELECT 'Removed on request (suppressed)', '0' UNION ALL SELECT 'Websites not read (robots.txt)', '0' UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{m.replace(chr(39), chr(39) * 2)}', CASE WHEN count(*) = 0 THEN '0' ELSE count(CASE WHEN {c} THEN 1 END) || ' (' || (count(CASE WHEN {c} THEN 1 END) * 100 // count(*)) || '%)' END FROM s" for m, c in _SUMMARY
    )
)
def run_summary(spark, sf_dir):
    """Flagship: completeness and sales openings of all leads, in one pass and one exchange of counts."""
    kind = score.email_kind(F.col("email"), F.col("name_key"))
    tests: dict[str, Column] = {
        "Reachable": score.reachable(), "With email": score.has("email"), "With phone": score.has("phone"), "With website": score.has("website"), "With Facebook": score.has("facebook"),
        "Personal-name emails": kind == "personal", **{f"Opening: {t}": F.array_contains("flags", f) for f, t in dims.REASONS},
    }
    one = scored(spark, sf_dir).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"m{i}") for i, c in enumerate(tests.values())))
    rows = [F.struct(F.lit("Leads").alias("metric"), F.col("n").cast("string").alias("value"))]
    rows += [F.struct(F.lit(m).alias("metric"), score.share(F.col(f"m{i}"), F.col("n")).alias("value")) for i, m in enumerate(tests)]
    rows += [F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value")) for m, v in export.run_counts({}, {})]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(f"SELECT first_seen_run_id AS run_id, count(*) AS n, count(CASE WHEN {_HAS('email')} THEN 1 END) * 100 // count(*) AS email_pct, count(CASE WHEN {_HAS('phone')} THEN 1 END) * 100 // count(*) AS phone_pct FROM {_L} GROUP BY 1")
def coverage(spark, sf_dir):
    l = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]).groupBy(F.col("first_seen_run_id").alias("run_id"))
    pct = lambda c: F.floor(F.count_if(score.has(c)) * 100 / F.count("*"))
    return l.agg(F.count("*").alias("n"), pct("email").alias("email_pct"), pct("phone").alias("phone_pct"))


@query(f"SELECT count(CASE WHEN NOT ({_SUMMARY[0][1]}) THEN 1 END) AS hidden, count(*) AS total FROM {_L}")
def reachable_hidden(spark, sf_dir):
    return table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]).agg(F.count_if(~score.reachable()).alias("hidden"), F.count("*").alias("total"))


@query(f"SELECT lead_id, kind AS email_kind FROM {_SCORED}")
def email_kinds(spark, sf_dir):
    l = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"])
    return l.select("lead_id", score.email_kind(F.col("email"), F.col("name_key")).alias("email_kind"))


_SAID = "list_filter([" + ", ".join(f"CASE WHEN list_contains(flags, '{f}')" + (" AND NOT list_contains(flags, 'social_only')" if f == "no_website" else "") + f" THEN '{t.replace(chr(39), chr(39) * 2)}' END" for f, t in dims.REASONS) + "], lambda x: x IS NOT NULL)[1:2]"


@query(f"SELECT lead_id, upper(line[1:1]) || line[2:] AS why FROM (SELECT lead_id, array_to_string({_SAID}, '; ') AS line FROM {_SCORED})")
def why_contact(spark, sf_dir):
    return scored(spark, sf_dir).select("lead_id", score.why_contact(F.col("flags")).alias("why"))


@query(f"SELECT lead_id, score FROM {_SCORED} ORDER BY score DESC, lead_id LIMIT 50")
def topk_score(spark, sf_dir):
    return scored(spark, sf_dir).select("lead_id", "score").orderBy(F.desc("score"), "lead_id").limit(50)


def _guard(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN chr(39) || {c} ELSE {c} END AS {c}"


_JOINED = lambda c: f"array_to_string({c}, ', ')"
_WHY = f"(SELECT *, upper(line[1:1]) || line[2:] AS why_contact FROM (SELECT *, array_to_string({_SAID}, '; ') AS line FROM {_SCORED}))"


@query("SELECT lead_id, category, phone, phones_extra, email_kind, instagram, linkedin, tiktok, score, lat, lon, updated_at, "
       + ", ".join(_guard(c) for c in ("business_name", "email", "emails_extra", "website", "facebook", "address", "city", "flags", "why_contact", "tech", "opening_hours", "sources"))
       + f""" FROM (SELECT lead_id, business_name, categories[1] AS category, phone, {_JOINED('phones_extra')} AS phones_extra, email, kind AS email_kind, {_JOINED('emails_extra')} AS emails_extra, website, facebook,
CAST(NULL AS VARCHAR) AS instagram, CAST(NULL AS VARCHAR) AS linkedin, CAST(NULL AS VARCHAR) AS tiktok, address, city, score, {_JOINED('flags')} AS flags, why_contact, {_JOINED('tech')} AS tech, opening_hours, lat, lon, {_JOINED('sources')} AS sources,
strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM {_WHY})""")
def csv_export_projection(spark, sf_dir):
    """All 24 managed columns of the export, cells guarded against formulas."""
    rows = export.lead_rows(scored(spark, sf_dir), F.get("categories", F.lit(0)))
    return rows.select(*(web.escape_cell(c, F.col(c)).alias(c) if t == "string" and c not in ("lead_id", "category", "email_kind", "updated_at", "instagram", "linkedin", "tiktok") else F.col(c) for c, t in rows.dtypes))


_OSM, _PLACES = ("'" + x.replace("'", "''") + "'" for x in (dims.OSM_LICENCE, dims.PLACES_LICENCE))


@query(f"""SELECT run_id, CASE WHEN list_contains(s, 'overture') AND list_contains(s, 'osm') THEN {_OSM} || chr(10) || {_PLACES} WHEN list_contains(s, 'overture') THEN {_PLACES} ELSE {_OSM} END AS attribution
FROM (SELECT run_id, list(DISTINCT src) AS s FROM (SELECT first_seen_run_id AS run_id, unnest(sources) AS src FROM {_L} UNION SELECT run_id, unnest(sources) FROM runs) GROUP BY 1)""")
def attribution(spark, sf_dir):
    """The licence lines of each run, for the sources asked and those behind its leads."""
    led = table(spark, sf_dir, "leads").select(F.col("first_seen_run_id").alias("run_id"), F.explode("sources").alias("src"))
    used = led.unionByName(table(spark, sf_dir, "runs").select("run_id", F.explode("sources").alias("src")))
    has = lambda x: F.max((F.col("src") == x).cast("int")) == 1
    return used.groupBy("run_id").agg(export.attribution(has("osm"), has("overture")).alias("attribution"))


@query(f"""SELECT r.run_id, CASE WHEN rows_.n IS NULL THEN 0 ELSE rows_.n END AS n_leads, r.category || ' / ' || r.location || ' / ' || r.run_id AS about FROM runs r LEFT JOIN (SELECT first_seen_run_id AS run_id, count(*) AS n FROM {_L} GROUP BY 1) rows_ USING (run_id)""")
def about_rows(spark, sf_dir):
    """What every export says about its run."""
    n = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]).groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count("*").alias("n"))
    a = export.about(table(spark, sf_dir, "runs").join(n, "run_id", "left"))
    return a.groupBy("run_id").agg(F.max(F.when(F.col("field") == "Leads", F.col("value").cast("bigint"))).alias("n_leads"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").between(1, 3), F.struct("pos", "value")))), lambda x: x["value"]), " / ").alias("about"))


_STRIP = lambda c: f"nullif(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"
# --- keys and cleaning ---------------------------------------------------------------------------
_FOLD = lambda c: f"regexp_replace(strip_accents(lower({c})), '[\\x{{300}}-\\x{{36f}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
_TOK = lambda c: f"trim(regexp_replace(replace({c}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT record_id, regexp_replace({_TOK(_FOLD('name'))}, '( ({'|'.join(dims.LEGAL)}))+$', '') AS name_key FROM raw_records")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("record_id", names.name_key(F.col("name")).alias("name_key"))


def _misread(c: str) -> str:
    """Lower case with UTF-8 that was read as Latin-1 put right."""
    out = f"lower({c})"
    for bad, good in MISREAD:
        out = f"replace({out}, '{bad}', '{good}')"
    return out


@query("SELECT record_id, nullif(" + _TOK(f"regexp_replace(trim({_FOLD(_misread('city'))}), '^(?:city|municipality) of\\s+|\\s+city$', '', 'g')") + ", '') AS city_key FROM raw_records")
def city_keys(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("record_id", names.city_key(F.col("city")).alias("city_key"))


_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.STREET_WORDS.items()) + "}"


@query(
    "SELECT record_id, nullif(array_to_string(list_transform(list_filter(string_split("
    + _TOK(f"regexp_replace({_FOLD('street')}, '" + dims.UNIT + "', ' ', 'g')")
    + f", ' '), lambda t: t <> ''), lambda t: CASE {' '.join(f'WHEN t = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in dims.STREET_WORDS.items())} ELSE t END), ' '), '') AS street_key FROM raw_records WHERE street IS NOT NULL"
)
def street_keys(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").where("street is not null").select("record_id", names.street_key(F.col("street")).alias("street_key"))


@query(
    """SELECT a.lead_id AS lead_a, b.lead_id AS lead_b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM (SELECT DISTINCT lead_id, phone, name_key, list_distinct(string_split(name_key, ' ')) AS t FROM leads WHERE phone IS NOT NULL) a JOIN (SELECT DISTINCT lead_id, phone, list_distinct(string_split(name_key, ' ')) AS t FROM leads) b USING (phone) WHERE a.lead_id < b.lead_id"""
)
def jaccard_same_phone(spark, sf_dir):
    l = table(spark, sf_dir, "leads").where("phone is not null").select("lead_id", "phone", "name_key").distinct()
    a, b = l.toDF("lead_a", "phone", "na"), l.toDF("lead_b", "phone", "nb")
    return a.join(b, "phone").where("lead_a < lead_b").select("lead_a", "lead_b", F.round(names.jaccard(F.col("na"), F.col("nb")), 6).alias("jaccard"))


@query(f"""SELECT record_id, nullif(array_to_string(list_filter([a, CASE WHEN b IS DISTINCT FROM a THEN b END, CASE WHEN c IS DISTINCT FROM a AND c IS DISTINCT FROM b THEN c END], lambda x: x IS NOT NULL), ', '), '') AS address
FROM (SELECT record_id, {_STRIP("concat_ws(' ', housenumber, street)")} AS a, {_STRIP('suburb')} AS b, {_STRIP('city')} AS c FROM raw_records)""")
def address_lines(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("record_id", names.address_line(F.concat_ws(" ", "housenumber", "street"), F.col("suburb"), F.col("city")).alias("address"))


_H = r"^\s*(\d+[A-Za-z]?(?:-[A-Za-z0-9]+)?),?\s+(\S.*)$"


@query(f"SELECT record_id, nullif(regexp_extract(street, '{_H}', 1), '') AS house_no, CASE WHEN regexp_matches(street, '{_H}') THEN regexp_extract(street, '{_H}', 2) ELSE street END AS rest FROM raw_records WHERE street IS NOT NULL")
def split_house_number(spark, sf_dir):
    s = F.col("street")
    return table(spark, sf_dir, "raw_records").where("street is not null").select("record_id", names.house_number(s).alias("house_no"), names.house_street(s).alias("rest"))




@query(f"SELECT record_id, coalesce({_STRIP('suburb')}, {_STRIP('city')}, {_STRIP('province')}) AS place FROM raw_records")
def first_nonblank(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("record_id", names.first_present(F.col("suburb"), F.col("city"), F.col("province")).alias("place"))


_U = "CASE WHEN contains(website_raw, '://') THEN website_raw ELSE 'https://' || website_raw END"
_UP = r"^([A-Za-z]+)://([^/?#:]+)([^?#]*)(?:\?([^#]*))?"
_Q = f"list_filter(string_split(regexp_extract({_U}, '{_UP}', 4), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))"


@query(f"""SELECT record_id, lower(regexp_extract({_U}, '{_UP}', 1)) || '://' || lower(regexp_extract({_U}, '{_UP}', 2)) || CASE WHEN len({_Q}) > 0 THEN CASE WHEN regexp_replace(regexp_extract({_U}, '{_UP}', 3), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({_U}, '{_UP}', 3), '/+$', '') END
|| '?' || array_to_string({_Q}, '&') ELSE regexp_replace(regexp_extract({_U}, '{_UP}', 3), '/+$', '') END AS url FROM raw_records WHERE website_raw IS NOT NULL""")
def normal_urls(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").where("website_raw is not null").select("record_id", web.normal_url(F.col("website_raw")).alias("url"))


@query(f"SELECT lead_id, {_reg(_MAILHOST)} AS mail_domain, {_OWN} AS own_domain FROM {_L} WHERE email IS NOT NULL")
def own_domain_mail(spark, sf_dir):
    l = table(spark, sf_dir, "leads").dropDuplicates(["lead_id"]).where("email is not null")
    return l.select("lead_id", web.registered_domain(web.mail_host(F.col("email"))).alias("mail_domain"), score.own_domain_email().alias("own_domain"))


@query("""SELECT record_id, lower(trim(regexp_extract(regexp_replace(trim(m), '^mailto:', ''), '^([^?]*)', 1))) AS email FROM (SELECT record_id, unnest(emails_raw) AS m FROM raw_records)
WHERE regexp_matches(lower(trim(regexp_extract(regexp_replace(trim(m), '^mailto:', ''), '^([^?]*)', 1))), '^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}$')""")
def normal_emails(spark, sf_dir):
    e = table(spark, sf_dir, "raw_records").select("record_id", F.explode("emails_raw").alias("m"))
    return e.select("record_id", web.normal_email(F.col("m")).alias("email")).where("email is not null")


_HIDDEN = r"(?i)([A-Za-z0-9._%+\-]+\s*[\[({]\s*at\s*[\])}]\s*[A-Za-z0-9\-]+(?:\s*[\[({]\s*dot\s*[\])}]\s*[A-Za-z0-9\-]+)+)"
_OPENED = r"regexp_replace(regexp_replace(x, '(?i)\s*[\[({]\s*at\s*[\])}]\s*', '@'), '(?i)\s*[\[({]\s*dot\s*[\])}]\s*', '.', 'g')"
_ALL_MAILS = rf"list_distinct(list_transform(list_concat(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,24}}'), list_transform(regexp_extract_all(text, '{_HIDDEN}', 1), lambda x: {_OPENED})), lambda x: lower(x)))"
_JUNK = f"regexp_matches(x, '\\.(png|jpe?g|gif|webp|svg|bmp|ico|avif)$|@[0-9]+x\\.') OR regexp_extract(x, '@(.*)$', 1) IN {_in(dims.JUNK_MAIL)} OR coalesce({_reg(chr(114) + 'egexp_extract(x, ' + chr(39) + '@(.*)$' + chr(39) + ', 1)')} IN {_in(dims.JUNK_MAIL)}, false)"


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter({_ALL_MAILS}, lambda x: NOT ({_JUNK}))), ',') AS emails FROM documents WHERE text IS NOT NULL")
def email_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(F.array_sort(web.emails_in(F.col("text"))), ",").alias("emails"))


_HOST = "regexp_replace(lower(regexp_extract(website_raw, '^(?:[A-Za-z]+://)?([^/?#:]+)', 1)), '^www\\.', '')"
_MAIL = r"lower(trim(regexp_extract(regexp_replace(trim(m), '^mailto:', ''), '^([^?]*)', 1)))"
_PREFER = "coalesce(list_position([" + ", ".join(f"'{x}'" for x in dims.PREFERRED) + "], regexp_extract(e, '^([^@]*)', 1)), 100)"
_BOXES = "('x-admin@gmail.com'), ('info@yahoo.com'), ('zoe@nowhere.example')"


@query(rf"""SELECT domain, array_to_string(list_transform(list_sort(list_transform(es, lambda e: struct_pack(t := CASE WHEN {_reg("regexp_extract(e, '@(.*)$', 1)")} = domain THEN 0 WHEN regexp_extract(e, '@(.*)$', 1) IN {_in(dims.FREE_MAIL)} THEN 1 ELSE 2 END,
p := {_PREFER}, e := e))), lambda x: x.e), ',') AS emails FROM (SELECT domain, list(DISTINCT e) AS es FROM (SELECT {_reg(_HOST)} AS domain, {_MAIL} AS e FROM (SELECT website_raw, unnest(emails_raw) AS m FROM raw_records WHERE website_raw IS NOT NULL)
UNION SELECT {_reg(_HOST)}, e FROM raw_records, (VALUES {_BOXES}) v(e) UNION SELECT {_reg(_HOST)}, 'sales@' || {_reg(_HOST)} FROM raw_records)
WHERE domain IS NOT NULL AND domain NOT IN {_in(dims.SHARED_HOSTS)} AND regexp_matches(e, '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}$') GROUP BY 1)""")
def email_rank(spark, sf_dir):
    """The e-mails of each website's records in rank order, with some at free providers, elsewhere and at the website's own domain."""
    raw = table(spark, sf_dir, "raw_records").where("website_raw is not null")
    host = F.regexp_replace(F.lower(F.regexp_extract("website_raw", r"^(?:[A-Za-z]+://)?([^/?#:]+)", 1)), r"^www\.", "")
    r = raw.select(web.registered_domain(host).alias("domain"), "emails_raw").where(F.col("domain").isNotNull() & ~web.is_shared(F.col("domain")))
    given = F.concat(F.array(F.lit("x-admin@gmail.com"), F.lit("info@yahoo.com"), F.lit("zoe@nowhere.example"), F.concat(F.lit("sales@"), "domain")), F.transform("emails_raw", web.normal_email))
    each = r.select("domain", given.alias("es")).select("domain", F.explode("es").alias("e")).where("e is not null").distinct()
    return each.groupBy("domain").agg(F.sort_array(F.collect_list("e")).alias("es")).select("domain", F.array_join(web.ranked_emails(F.col("es"), F.col("domain")), ",").alias("emails"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._\-]+', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|password|secret)["'']?\s*[:=]\s*["'']?)[^\s"''&]+', '\1[REDACTED]', 'g'), '(?i)(key=)[A-Za-z0-9_\-]{12,}', '\1[REDACTED]', 'g')) AS n FROM documents WHERE text IS NOT NULL""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(web.redact(F.col("text"))).alias("n"))


_SILENT = "|".join(rf"<{t}\b[\s\S]*?</{t}\s*>" for t in ("script", "style", "noscript", "template", "svg"))


@query(rf"SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '{_SILENT}', ' ', 'gi'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM documents WHERE text IS NOT NULL")
def visible_text_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(web.visible_text(F.col("text"))).alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def formula_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", web.escape_cell("text", F.col("text")).alias("cell"))


@query("SELECT r.source, count(*) AS n_records, count(DISTINCT source_ref) AS n_refs, count(DISTINCT run_id) AS n_runs FROM raw_records r GROUP BY 1")
def multi_source_counts(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").groupBy("source").agg(F.count("*").alias("n_records"), F.countDistinct("source_ref").alias("n_refs"), F.countDistinct("run_id").alias("n_runs"))


@query("SELECT run_id, substr(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(category)), '[^\\w\\-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'export'), 1, 60) || '-' || substr(run_id, 1, 8) AS base FROM runs")
def export_basename(spark, sf_dir):
    return table(spark, sf_dir, "runs").select("run_id", F.concat(names.slug(F.col("category")), F.lit("-"), F.substring("run_id", 1, 8)).alias("base"))


QUERIES, SQL = R.queries, R.sql
