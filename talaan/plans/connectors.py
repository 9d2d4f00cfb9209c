"""Queries over text, HTML and connector rules. Pages are built from the documents table, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.functions import dims, html, phones, robots, web
from talaan.plans.registry import Registry
from talaan.runtime import table
from talaan.sources import overpass, places

R = Registry()
query = R.query
YEAR = 2026


MARKS = {
    "wordpress": '<link href="/wp-content/a.css">', "shopify": '<img src="https://cdn.shopify.com/a.png">', "wix": '<img src="https://static.wixstatic.com/a">', "squarespace": '<img src="https://static1.squarespace.com/a">',
    "webflow": '<html data-wf-page="1">', "joomla": '<meta name="generator" content="Joomla! 4">', "drupal": '<img src="/sites/default/files/a.png">', "godaddy": '<img src="https://img1.wsimg.com/a">',
    "weebly": '<script src="https://cdn2.editmysite.com/a.js"></script>', "blogger": '<meta content="blogger" name="generator">',
}
HEADERS = [("link", '<https://a/wp-json/>; rel="https://api.w.org/"'), ("powered-by", "Shopify"), ("server", "Squarespace"), ("x-generator", "Drupal 10"), ("x-wix-request-id", "1"), ("server", "nginx")]


def pages(spark, sf_dir) -> DataFrame:
    """Each document as a homepage: by doc_id some carry platform, analytics, booking, viewport and copyright marks, headers and links."""
    i = F.col("doc_id")
    platform = F.lit("")
    for k, mark in enumerate(MARKS.values()):
        platform = F.when(i % 12 == k, mark).otherwise(platform)
    header = F.create_map().cast("map<string,string>")
    for k, (name, v) in enumerate(HEADERS):
        header = F.when(i % 17 == k, F.create_map(F.lit(name), F.lit(v))).otherwise(header)
    marks = F.concat(
        F.when(i % 2 == 0, '<meta name="viewport" content="width=device-width, initial-scale=1">').otherwise(""), platform,
        F.when(i % 5 == 0, '<script src="https://www.googletagmanager.com/gtag/js?id=1"></script>').otherwise(""), F.when(i % 7 == 0, '<a href="https://calendly.com/x">Book</a>').otherwise(""),
        F.concat(F.lit("<p>&copy; "), (2000 + i % 40).cast("string"), F.lit("</p>")), F.concat(F.lit('<a href="mailto:desk'), i.cast("string"), F.lit('@clinic.com.ph?subject=x">mail</a>')),
        F.when(i % 3 == 0, '<a href="/about-us/">Who we are</a><a href="/menu.pdf">Contact sheet</a>').otherwise(""), F.when(i % 4 == 0, '<a href="https://else.example/contact">Contact</a><a href="#contact">Contact</a>').otherwise(""),
        F.when(i % 5 != 1, '<a href="/contact#form">Write to us</a>').otherwise(""), F.when(i % 3 == 1, '<a href="/p/7">Get in touch</a><a href="/contact/">Again</a>').otherwise(""),
        F.concat(F.lit('<a href="tel:0917 55'), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit('">call</a>')),
    )
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.concat(F.lit("https://site"), i.cast("string"), F.lit(".com.ph/")).alias("url"), header.alias("headers"), F.concat(F.lit("<html><body>"), marks, F.lit("<div>"), F.col("text"), F.lit("</div></body></html>")).alias("html")
    )


_PLATFORM = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{m.replace(chr(39), chr(39) * 2)}'" for k, m in enumerate(MARKS.values())) + " ELSE '' END"
_P = f"""(SELECT doc_id, '<html><body>' || CASE WHEN doc_id % 2 = 0 THEN '<meta name="viewport" content="width=device-width, initial-scale=1">' ELSE '' END || {_PLATFORM}
|| CASE WHEN doc_id % 5 = 0 THEN '<script src="https://www.googletagmanager.com/gtag/js?id=1"></script>' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '<a href="https://calendly.com/x">Book</a>' ELSE '' END
|| '<p>&copy; ' || (2000 + doc_id % 40) || '</p>' || text AS html, CASE doc_id % 17 {' '.join(f"WHEN {k} THEN '{n}:{v}'" for k, (n, v) in enumerate(HEADERS))} ELSE '' END AS header FROM documents WHERE text IS NOT NULL)"""


def _platform_test(name: str) -> str:
    tests = [f"regexp_matches(html, '(?i){p}')" for n, p in dims.PLATFORMS if n == name]
    tests += [f"regexp_matches(header, '(?i)^{h}:.*{p}')" for n, h, p in dims.PLATFORM_HEADERS if n == name]
    return " OR ".join(tests)


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_platform_test(n)} THEN '{n}' END" for n, _ in dims.PLATFORMS)}], lambda x: x IS NOT NULL), ',') AS tech,
regexp_matches(html, '(?i)<meta[^>]*name\\s*=\\s*["'']?viewport[^>]*width\\s*=\\s*device-width') AS viewport FROM {_P}""")
def detect_tech(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select("doc_id", F.array_join(web.tech(h, F.col("headers")), ",").alias("tech"), web.has_viewport(h).alias("viewport"))


@query(f"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(html, '(?i)(?:©|&copy;|&#169;|\\bcopyright\\b)\\s*(?:\\d{{4}}\\s*(?:-|–|&ndash;|to)\\s*)?(\\d{{4}})', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1990 AND {YEAR})) AS copyright_year,
regexp_matches(html, '(?i)googletagmanager\\.com/gtag/js|google-analytics\\.com/(?:analytics|ga)\\.js|googletagmanager\\.com/gtm\\.js') AS analytics, regexp_matches(html, '(?i)calendly\\.com/') AS booking FROM {_P}""")
def site_facts(spark, sf_dir):
    f = web.site_facts(F.col("html"), YEAR)
    p = pages(spark, sf_dir).select("doc_id", f.alias("f"))
    stamp = F.get(F.filter("f", lambda x: x.startswith("copyright:")), F.lit(0))
    return p.select("doc_id", F.substring(stamp, 11, 4).cast("int").alias("copyright_year"), F.array_contains("f", "analytics:google").alias("analytics"), F.array_contains("f", "booking:calendly").alias("booking"))


@query()
def page_contacts(spark, sf_dir):
    """All contacts of each page: e-mails in rank order, phones, social pages, protected e-mails."""
    x = pages(spark, sf_dir).withColumn("parts", html.parts_column(F.col("html"), F.col("url"))).select("doc_id", "url", html.contacts(F.col("parts")).alias("x"))
    site = web.registered_domain(F.col("url"))
    return x.select("doc_id", F.array_join(web.ranked_emails(F.col("x.emails"), site), ",").alias("emails"), F.array_join("x.phones", ",").alias("phones"), F.size("x.socials").alias("n_socials"), "x.protected_emails")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 <> 1 OR doc_id % 3 = 1 THEN CASE WHEN doc_id % 5 = 1 THEN site || 'p/7' ELSE site || 'contact' END END,
CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 5 = 1 THEN site || 'contact' ELSE site || 'p/7' END WHEN doc_id % 3 = 0 THEN site || 'about-us' END], lambda x: x IS NOT NULL), ',') AS pages
FROM (SELECT *, 'https://site' || doc_id || '.com.ph/' AS site FROM documents WHERE text IS NOT NULL)""")
def contact_links(spark, sf_dir):
    """The contact and about pages that each page links to; files, other sites, anchors and repeats don't count."""
    x = pages(spark, sf_dir).withColumn("parts", html.parts_column(F.col("html"), F.col("url")))
    return x.select("doc_id", F.array_join(html.contact_pages(F.col("parts"), F.col("url")), ",").alias("pages"))


@query()
def phone_lists(spark, sf_dir):
    """The valid numbers of each record's typed phone list, with the carry rules for short and area-less parts."""
    return table(spark, sf_dir, "raw_records").select("record_id", F.array_join(phones.normalize(F.col("phones_raw")), ",").alias("phones"))


_BARE = "trim(regexp_replace(p, '(?i)\\b(?:loc|ext|local)\\b[\\s\\S]*$', ''))"
_DIG = "regexp_replace(bare, '\\D', '', 'g')"


@query(f"""SELECT record_id, CASE WHEN regexp_matches(n, '^\\+(63(9\\d{{9}}|2\\d{{8}}|[3-8]\\d{{8}}))$') OR (regexp_matches(n, '^\\+\\d{{8,15}}$') AND NOT starts_with(n, '+63')) THEN n END AS phone FROM (
SELECT record_id, CASE WHEN starts_with(bare, '+') AND NOT starts_with(d, '63') THEN '+' || d ELSE '+63' || ltrim(CASE WHEN starts_with(d, '63') AND (length(d) > 10 OR starts_with(d, '630')) THEN d[3:] ELSE d END, '0') END AS n
FROM (SELECT record_id, bare, {_DIG} AS d FROM (SELECT record_id, {_BARE} AS bare FROM (SELECT record_id, unnest(phones_raw) AS p FROM raw_records))))""")
def phone_e164(spark, sf_dir):
    """Every typed value read as one number."""
    p = table(spark, sf_dir, "raw_records").select("record_id", F.explode("phones_raw").alias("p"))
    return p.select("record_id", phones.e164(F.col("p")).alias("phone"))


@query("SELECT DISTINCT phone, CASE WHEN regexp_matches(phone, '^\\+639\\d{9}$') THEN '+63 ' || phone[4:6] || ' ' || phone[7:9] || ' ' || phone[10:13] WHEN regexp_matches(phone, '^\\+632\\d{8}$') THEN '+63 2 ' || phone[5:8] || ' ' || phone[9:12] WHEN regexp_matches(phone, '^\\+63\\d{9}$') THEN '+63 ' || phone[4:5] || ' ' || phone[6:8] || ' ' || phone[9:12] ELSE phone END AS shown FROM leads WHERE phone IS NOT NULL")
def display_phone(spark, sf_dir):
    return table(spark, sf_dir, "leads").where("phone is not null").select("phone", phones.display(F.col("phone")).alias("shown")).distinct()


@query("SELECT DISTINCT facebook, 'https://m.me/' || regexp_replace(facebook, '^@', '') AS chat FROM leads WHERE facebook IS NOT NULL AND length(regexp_replace(facebook, '^@', '')) >= 5")
def messenger_links(spark, sf_dir):
    f = table(spark, sf_dir, "leads").where("facebook is not null").select("facebook").distinct()
    url = F.concat(F.lit("https://www.facebook.com/"), F.regexp_replace("facebook", "^@", ""))
    return f.select("facebook", web.messenger(url).alias("chat")).where("chat is not null")


@query("SELECT DISTINCT user_id FROM (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, value, sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events) WHERE value >= 50 GROUP BY 1, 2) WHERE n >= 3")
def blocked_streaks(spark, sf_dir):
    """Hosts with three refusals in a row; users stand for hosts, values of 50 or more for refusals."""
    log = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") >= 50, 403).otherwise(200))
    return robots.blocked_hosts(log, "user_id", ["ts", "event_id"], "status")


@query("SELECT record_id, replace(replace(name, '\\', '\\\\'), '\"', '\\\"') AS quoted FROM raw_records")
def query_escape(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("record_id", web.escape_query(F.col("name")).alias("quoted"))


@query("""SELECT r.record_id, list_contains(['osm', 'overture'], r.source) AS open_data, coalesce(c.n > 1, false) AS repeated FROM raw_records r LEFT JOIN (SELECT source_ref, count(*) AS n FROM raw_records GROUP BY 1) c USING (source_ref)""")
def record_facts(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_records").select("record_id", "source", "source_ref")
    n = raw.groupBy("source_ref").agg(F.count("*").alias("n"))
    return raw.join(n, "source_ref", "left").select("record_id", F.col("source").isin("osm", "overture").alias("open_data"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("repeated"))


@query("""SELECT source_ref AS id, name, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY record_id) AS k FROM raw_records WHERE source = 'overture') WHERE k = 1 AND lon BETWEEN 117 AND 123 AND lat BETWEEN 6 AND 12
AND CAST(json_extract(payload, '$.confidence') AS DOUBLE) >= 0.5 AND length(name) % 7 <> 0 AND length(name) % 5 <> 0 AND length(name) % 3 <> 0""")
def query_places(spark, sf_dir):
    """The places scan, over the places records written as a places file in the shared folder; by the name's length some have no name, are closed for good, or of another category."""
    from talaan.runtime import cut

    raw = table(spark, sf_dir, "raw_records").where("source = 'overture'")
    one = raw.groupBy("source_ref").agg(F.min_by(F.struct("name", "lat", "lon", "payload", "phones_raw", "emails_raw"), "record_id").alias("r")).select(F.col("source_ref").alias("id"), "r.*")
    box = F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    none, n = F.array().cast("array<string>"), F.length("name")
    status = F.when(n % 5 == 0, "permanently_closed").when(n % 2 == 0, "open")
    made = cut(one.select(
        "id", F.struct(F.when(n % 7 != 0, F.col("name")).alias("primary")).alias("names"), F.get_json_object("payload", "$.confidence").cast("double").alias("confidence"), status.alias("operating_status"), none.alias("websites"),
        F.col("emails_raw").alias("emails"), F.col("phones_raw").alias("phones"), none.alias("socials"), F.array(F.struct(F.lit(None).cast("string").alias("freeform"), F.lit(None).cast("string").alias("locality"), F.lit(None).cast("string").alias("region"))).alias("addresses"),
        box.alias("bbox"), F.struct(F.array(F.lit("all"), F.when(n % 3 == 0, "other").otherwise("any")).alias("hierarchy")).alias("taxonomy"), F.array(F.struct(F.lit("open").alias("dataset"))).alias("sources"),
    ))
    return places.scan(spark, made._talaan_path, (6.0, 117.0, 12.0, 123.0), ["any"]).select("id", "name", "lon", "lat")


@query("""SELECT source_ref, name, phone FROM (SELECT source_ref, trim(name) AS name, phones_raw[1] AS phone, row_number() OVER (PARTITION BY source_ref ORDER BY record_id) AS k FROM raw_records WHERE source = 'osm') WHERE k = 1 AND trim(name) <> ''""")
def overpass_elements(spark, sf_dir):
    """Map answers rebuilt from the map records, and read back as raw records."""
    raw = table(spark, sf_dir, "raw_records").where("source = 'osm'")
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("phone"), F.get("phones_raw", F.lit(0))), lambda k, v: v.isNotNull())
    kind, ident = F.split_part("source_ref", F.lit("/"), F.lit(1)), F.split_part("source_ref", F.lit("/"), F.lit(2)).cast("bigint")
    point = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    e = F.struct(kind.alias("type"), ident.alias("id"), F.col("lat").alias("lat"), F.col("lon").alias("lon"), point.alias("center"), tags.alias("tags"))
    # an answer per record, so nothing is gathered; positions follow the record ids
    answers = raw.select(F.array(e).alias("elements"), "record_id")
    rows = overpass.elements(answers)
    first = answers.select(F.col("elements")[0].alias("e"), "record_id").groupBy(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("source_ref")).agg(F.count("*").alias("n"))
    return rows.join(first, "source_ref", "left_semi").select("source_ref", "name", F.get("phones_raw", F.lit(0)).alias("phone"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_activity(spark, sf_dir):
    from talaan.streaming.monitor import windowed

    w = windowed(table(spark, sf_dir, "events"), "1 hour", None)
    return w.select("user_id", F.col("window.start").alias("hour"), "n", F.round("total", 4).alias("total"))


QUERIES, SQL = R.queries, R.sql
