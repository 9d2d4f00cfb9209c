import zipfile

import pytest
from pyspark.sql import functions as F

from talaan.functions import html, names, phones, robots, score, text, web
from talaan.functions.text import one_edit
from talaan.operators import resolve, snapshots
from talaan.sources import jobs, listings, overpass, places


def value(spark, column, **cols):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [
    ("Dr. José's Clínica & Spa, Inc.", "dr jose s clinica and spa"), ("Inc", "inc"), ("  ", ""), ("ABC Co. Ltd.", "abc"),
])
def test_name_key(spark, raw, want):
    assert value(spark, names.name_key(F.col("x")), x=raw) == want


def test_street_city_and_address(spark):
    assert value(spark, names.street_key(F.col("x")), x="Unit 5, 12 Rizal St. cor Mabini Ave") == "12 rizal street corner mabini avenue"
    assert value(spark, names.street_key(F.col("x")), x="Unit 5") is None
    assert value(spark, names.city_key(F.col("x")), x="City of Parañaque") == "paranaque"
    assert value(spark, names.address_line(F.col("a"), F.col("b"), F.col("c")), a=" 12 Rizal ", b="", c="12 Rizal") == "12 Rizal"
    assert value(spark, names.house_number(F.col("x")), x="12-B, Rizal St") == "12-B"


def test_similarity(spark):
    pair = {"a": "maayo stay argao", "b": "maayo argao"}
    assert value(spark, names.close(F.col("a"), F.col("b")), **pair)
    assert not value(spark, names.close(F.col("a"), F.col("b")), a="ai s restaurant", b="max s restaurant sm")
    assert value(spark, names.similar(F.col("a"), F.col("b")), a="smile", b="smile dental")
    assert not value(spark, names.similar(F.col("a"), F.col("b")), a="", b="x")
    for a, b, ok in (("abcd", "abdc", True), ("abcd", "abce", True), ("abcd", "acd", True), ("abcd", "badc", False), ("abcd", "dbca", False)):
        assert bool(value(spark, one_edit(F.col("a"), F.col("b")), a=a, b=b)) is ok


@pytest.mark.parametrize("raw, want", [
    ("WWW.Clinic.PH/", "https://www.clinic.ph"), ("http://u:p@A.ph:8080/x/?utm_source=m&b=1&fbclid=2#f", "http://a.ph:8080/x?b=1"), ("mailto:a@b.ph", None), ("a b.ph", None), ("localhost", None),
    ("https://a.ph?q=1", "https://a.ph/?q=1"), ("ftp://a.ph", None), ("//a.ph/x", "https://a.ph/x"),
])
def test_urls(spark, raw, want):
    once = value(spark, web.normal_url(F.col("x")), x=raw)
    assert once == want
    if want:
        assert value(spark, web.normal_url(F.col("x")), x=once) == once


def test_social_and_mail(spark):
    v = lambda c, x: value(spark, c(F.col("x")), x=x)
    assert v(web.platform, "https://m.facebook.com/x") == "facebook" and v(web.platform, "https://notfacebook.com") is None
    assert v(web.website_only, "facebook.com/x") is None
    assert v(web.registered_domain, "https://shop.clinic.com.ph/x") == "clinic.com.ph" and v(web.registered_domain, "com.ph") is None
    assert v(web.messenger, "https://www.facebook.com/105872085480167") == "https://m.me/105872085480167" and v(web.messenger, "https://facebook.com/groups") is None
    assert v(web.clean_email, "mailto:Info%40Clinic.ph?x") == "info@clinic.ph" and v(web.clean_email, "a@2x.png") is None and v(web.clean_email, "a@example.com") is None
    assert v(web.emails_in, "b@x.ph, a (at) y (dot) ph, B@x.ph") == ["b@x.ph", "a@y.ph"]
    ranked = web.ranked_emails(F.array(*map(F.lit, ["x@other.ph", "me@gmail.com", "zed@own.ph", "info@own.ph"])), F.col("x"))
    assert value(spark, ranked, x="own.ph") == ["info@own.ph", "zed@own.ph", "me@gmail.com", "x@other.ph"]
    assert v(web.redact, "token = abc123 Bearer x.y") == "token = [REDACTED] Bearer [REDACTED]"
    assert value(spark, web.escape_cell("name", F.col("x")), x="=1+1") == "'=1+1" and value(spark, web.escape_cell("phone", F.col("x")), x="+63") == "+63"


def test_html_facts(spark):
    page = '<meta name=viewport content="width=device-width"><script src="/wp-content/x"></script>© 2012-2019 &copy; 2050 calendly.com/x'
    assert value(spark, web.tech(F.col("x")), x=page) == ["wordpress"] and value(spark, web.has_viewport(F.col("x")), x=page)
    assert value(spark, web.site_facts(F.col("x"), 2026), x=page) == ["copyright:2019", "booking:calendly"]


@pytest.mark.parametrize("email, key, kind", [
    ("info@x.ph", "", "business"), ("inquiries2@x.ph", "", "business"), ("smiledental@x.ph", "smile dental", "business"), ("maria.santos@x.ph", "", "personal"), ("dr.reyes@x.ph", "", "personal"),
    ("qwerty@x.ph", "", "unknown"), ("", "", ""), (None, "", ""),
])
def test_email_kind(spark, email, key, kind):
    assert value(spark, score.email_kind(F.col("e").cast("string"), F.col("k")), e=email, k=key) == kind


def test_score_flags_and_reasons(spark):
    cols = "email string, domain string, phone string, website string, facebook string, street_key string, opening_hours string, https_ok boolean, mobile_viewport boolean, site_signals array<string>, categories array<string>"
    rows = [
        ("a@own.ph", "own.ph", "+63", "https://own.ph", "f", "s", "o", False, None, ["copyright:2019"], ["dentist"]), (None, None, None, "", "f", None, None, None, None, None, None),
        ("a@gmail.com", None, None, "w", None, None, None, True, False, [], []),
    ]
    got = spark.createDataFrame(rows, cols).select(score.score().alias("s"), score.flags(2026).alias("flags")).withColumn("why", score.why_contact(F.col("flags"))).collect()
    assert [r.s for r in got] == [100, 10, 45]
    assert got[0].flags == ["no_https", "stale_site", "no_analytics", "no_online_booking"] and got[1].flags == ["no_website", "social_only"]
    assert got[1].why == "Only on social media, no website" and got[2].flags == ["no_mobile_viewport", "free_email_provider", "no_analytics"]


@pytest.mark.parametrize("raw, want", [
    (["(032) 555-0123 / 0917 123 4567"], ["+63325550123", "+639171234567"]), (["(047) 737-2145/72"], ["+63477372145", "+63477372172"]), (["02 8123 4567 loc. 12; 0917 123 4567"], ["+63281234567", "+639171234567"]),
    (["0917 123 4567 / 8765-4321"], ["+639171234567"]), (["02 8123 4567/9/77"], ["+63281234567", "+63281234569", "+63281234577"]), ([None, "x/12", "/", "+63 2 8123-4567 ext 5"], ["+63281234567"]), (["63325550123", "12"], ["+63325550123"]), (["+1 202 555 0100"], ["+12025550100"]), ([], []), (None, []), (["(032) 555-0123 / 5550124"], ["+63325550123", "+63325550124"]),
])
def test_phones(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v array<string>")
    assert df.select(phones.normalize(F.col("v"))).first()[0] == want
    assert df.select(phones.in_text(F.array_join("v", " or "))).first()[0] is not None


def contacts_of(spark, page, base):
    df = spark.createDataFrame([(page, base)], "h string, b string").withColumn("p", html.parts_column(F.col("h"), F.col("b")))
    return df.select(html.contacts(F.col("p")).alias("x"), html.contact_pages(F.col("p"), F.col("b")).alias("pages")).first()


def test_html_extraction(spark):
    page = (
        '<a href="mailto:Info@clinic.ph?subject=x">m</a><a href="tel:0917 123 4567">t</a><a href="https://facebook.com/sharer/x">s</a><a href="https://www.facebook.com/clinic">f</a>'
        '<script type="application/ld+json">{"@graph":[{"@type":"Dentist","email":"desk@clinic.ph","sameAs":["https://instagram.com/c"]}]}</script><style>x@y.ph</style><a data-cfemail="1">p</a>'
    )
    x = contacts_of(spark, page, "https://clinic.ph/").x
    assert x["emails"] == ["info@clinic.ph", "desk@clinic.ph"] and x["phones"] == ["+639171234567"] and x["protected_emails"] == 1
    assert x["socials"] == {"facebook": "https://www.facebook.com/clinic", "instagram": "https://instagram.com/c"}
    assert contacts_of(spark, None, "https://clinic.ph/").x.asDict() == {"emails": [], "phones": [], "socials": {}, "protected_emails": 0}
    hidden = "<p>Write desk [at] clinic [dot] ph or (02) 8123 4567</p>"
    assert contacts_of(spark, hidden, "https://clinic.ph/").x[:2] == (["desk@clinic.ph"], ["+63281234567"])
    links = '<a href="/about">About</a><a href="/contact-us">Write</a><a href="https://else.ph/contact">x</a><a href="/c.pdf">contact</a>'
    assert contacts_of(spark, links, "https://clinic.ph/").pages == ["https://clinic.ph/contact-us", "https://clinic.ph/about"]


def test_robots(spark):
    rules = robots.rules("User-agent: a\nUser-agent: Bot\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: *\nDisallow: /", "bot")
    assert robots.allows(rules, "/x/y") and not robots.allows(rules, "/x/yz") and robots.allows(rules, "/z")
    coded = robots.rules("User-agent: *\nDisallow: /a%3Cd\nDisallow: /é", "bot")
    assert not robots.allows(coded, "/a<d") and not robots.allows(coded, "/a%3cd") and not robots.allows(coded, "/%C3%A9x") and robots.allows(coded, "/a")
    assert value(spark, robots.origin(F.col("x")), x="HTTPS://A.ph:8080/p?q") == "https://a.ph:8080" and value(spark, robots.origin(F.col("x")), x="ftp://a.ph/") is None
    assert not robots.allows(robots.rules("User-agent: *\nDisallow: /", "bot"), "/") and robots.allows([], "/")
    assert [robots.is_public(a) for a in ("8.8.8.8", "10.0.0.1", "::ffff:10.0.0.1", "224.0.0.1", "x", None)] == [True, False, False, False, False, False]
    assert [value(spark, robots.access_of_status(F.col("x")), x=s) for s in (200, 404, 429, 503)] == ["parse", "allow", "disallow", "disallow"]


def test_listing_pages(spark):
    a = listings.Adapter("t", "https://d.ph", ".item", {"name": "h2", "phone": {"selector": "a[href^='tel:']", "attr": "href"}, "address": ".a"}, ["https://d.ph/{city}"], "a[rel=next]", 3, dict.fromkeys(listings.CHECKS, True))
    one = '<div class="item"><h2>A</h2><a href="tel:123">x</a><p class="a">1 St</p></div><div class="item"><p class="a">x</p></div><a rel="next" href="/2">n</a>'
    pages = {"https://d.ph/San%20B": one, "https://d.ph/2": one + '<div class="x item"><h2>B</h2></div>'}
    found = listings.crawl(pages.get, a, 10, city="San B")
    assert [(r["name"], r["phone"]) for r in found] == [("A", "123"), ("B", None)] and found[0]["source_ref"].startswith("h:")
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    assert sorted(r.name for r in listings.read_listings(df, a).collect()) == ["A", "B"]
    with pytest.raises(ValueError):
        listings.Adapter("t", "https://d.ph", ".item", {"name": "h2"})


def test_map_answers(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"name": " A ", "phone": "1", "contact:mobile": "2", "name:en": "x"}}, {"type": "node", "id": 1, "tags": {"name": "again"}},'
                 '{"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"brand": "B"}}, {"type": "node", "id": 3, "tags": {"phone": "1"}}, {"type": "count", "id": 0, "tags": {"total": "5"}}]}')
    answers = overpass.read(spark, str(p))
    rows = {r.source_ref: r for r in overpass.elements(answers).collect()}
    assert set(rows) == {"node/1", "way/2"} and rows["node/1"].name == "A" and rows["node/1"].phones_raw == ["1", "2"] and rows["way/2"].lat == 3.0
    assert overpass.total(answers).first().total == 5
    assert overpass.query_text(['a=b"'], bbox=(1, 2, 3, 4)) == '[out:json][timeout:90];(nwr["a"="b\\""](1,2,3,4););out center tags;'


def test_places_scan_pushes_filters_down(spark, tmp_path):
    ddl = "id string, names struct<primary:string>, confidence double, operating_status string, websites array<string>, emails array<string>, phones array<string>, socials array<string>, addresses array<struct<freeform:string,locality:string,region:string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, taxonomy struct<primary:string,hierarchy:array<string>>, sources array<struct<dataset:string>>"
    box = (121.0, 121.2, 14.0, 14.2)

    def place(i, name="N", conf=0.9, status=None, kinds=("dentist",), b=box):
        return (i, (name,), conf, status, ["https://a.ph"], None, ["1"], ["https://facebook.com/x"], [("12 Rizal St", "Makati", "NCR")], b, (kinds[0], list(kinds)), [("meta",), ("meta",)])

    rows = [place("a"), place("b", conf=0.4), place("c", status="permanently_closed"), place("d", kinds=("bar",)), place("e", name=None), place("f", b=(10.0, 10.0, 1.0, 1.0)), place("g", conf=None), place("h", kinds=("x", "dentist"))]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "p"))
    found = places.scan(spark, str(tmp_path / "p"), (13.0, 120.0, 15.0, 122.0), ["dentist"])
    raw = {r.source_ref: r for r in places.to_raw(found).collect()}
    assert set(raw) == {"a", "h"} and raw["a"].housenumber == "12" and raw["a"].street == "Rizal St" and raw["a"].payload == '{"confidence":0.9,"datasets":["meta"]}' and raw["a"].facebook
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan.split("PushedFilters")[1]
    hole = spark.createDataFrame([("z", [[[120.0, 13.0], [122.0, 13.0], [122.0, 15.0], [120.0, 15.0], [120.0, 13.0]], [[121.05, 14.05], [121.15, 14.05], [121.15, 14.15], [121.05, 14.15], [121.05, 14.05]]])], "area_id string, rings array<array<array<double>>>")
    assert places.within(found, hole).count() == 0 and places.within(found, None).count() == 2 and places.best(found, 1).count() == 2


def test_jobs_and_sinks(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text("﻿Category,LOCATION,limit,sources\ndentist,Makati,10,osm;overture\n\n# x,y,,\ncafe,,,\ngym,Pasig,9999,osm|overture\n", encoding="utf-8")
    got = {r.row: r for r in jobs.read_jobs(spark, str(tmp_path / "jobs.csv")).collect()}
    assert got[1].limit_n == 10 and got[1].sources == ["osm", "overture"] and not got[1].error
    assert {k: r.error for k, r in got.items() if r.error} == {3: "no location", 4: "limit must be 1 to 5000"} or {k: r.error for k, r in got.items() if r.error} == {4: "no location", 5: "limit must be 1 to 5000"}
    assert jobs.resolve_category("Dentists", {"dentist": {"synonyms": ["dentists"]}}) == ("dentist", []) and jobs.resolve_category("dentst", {"dentist": {}})[1] == ["dentist"]
    from talaan.sinks import files

    df = spark.createDataFrame([("L-1", "=A", 5), ("L-2", None, None)], "lead_id string, business_name string, score int")
    assert files.write_csv(df, str(tmp_path / "x.csv"), [("Run", "r")]) == 2
    text = (tmp_path / "x.csv").read_bytes()
    assert text.startswith(b"\xef\xbb\xbf") and b"'=A" in text and (tmp_path / "x.about.txt").exists() and files.csv_bytes(df) == text
    files.write_xlsx(df, str(tmp_path / "x.xlsx"), [("Run", "r")])
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<v>5</v>" in sheet and "'=A" in sheet and 'autoFilter ref="A1:C3"' in sheet
    done, failed = files.export_all({"ok": lambda d: d.count(), "bad": lambda d: 1 / 0}, df)
    assert done == {"ok": 2} and "bad" in failed


def test_enrichment(spark):
    from talaan.operators import enrichment

    cols = "lead_id string, email string, emails_extra array<string>, phone string, phones_extra array<string>, facebook string, domain string, https_ok boolean, enrich_status string"
    leads = spark.createDataFrame([("L-1", "z@own.ph", [], "+631", [], "", "own.ph", None, "pending"), ("L-2", None, [], None, [], None, None, None, "pending")], cols)
    found = spark.createDataFrame([("L-1", (["info@own.ph", "gone@own.ph"], ["+632", "+631"], {"facebook": "https://facebook.com/a"}, 0), True)],
                                  "lead_id string, x struct<emails:array<string>,phones:array<string>,socials:map<string,string>,protected_emails:int>, https boolean")
    got = {r.lead_id: r for r in enrichment.apply_extraction(leads, found, ["gone@own.ph"]).collect()}
    assert got["L-1"].email == "info@own.ph" and got["L-1"].emails_extra == ["z@own.ph"] and got["L-1"].phones_extra == ["+632"] and got["L-1"].facebook and got["L-1"].https_ok and got["L-1"].enrich_status == "ok"
    assert got["L-2"].enrich_status == "pending" and got["L-2"].email is None
    dead = spark.createDataFrame([("own.ph", False), ("x.ph", None)], "host string, has_mail boolean")
    assert [(r.email, r.n_dropped) for r in enrichment.without_dead_emails(leads, dead).orderBy("lead_id").collect()] == [(None, 1), (None, 0)]
    assert enrichment.decode("é".encode("latin-1"), "text/html; charset=latin-1") == "é" and enrichment.decode(b"<meta charset=nope>\xff", None).endswith("\ufffd")
    assert value(spark, enrichment.run_seconds(F.col("x")), x='{"search": {"seconds": 1.5}, "clean": {"seconds": 2}, "n": 3}') == 3.5


def test_commands(tmp_path, spark):
    from talaan.__main__ import main

    assert main(["list"]) == 0 and main(["run", "nope", "--data", "x", "--out", "y"]) == 2


def test_folding_covers_every_marked_letter(spark):
    for raw, want in (("Việt Ångström", "viet angstrom"), ("ＦＵＬＬ", "full"), ("Ελλάς άέ", "ελλας αε"), ("Niño\u0301", "nino"), (None, None), ("", "")):
        assert value(spark, text.fold(F.col("x")), x=raw) == want


def test_replacing_keeps_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, None), ("c", 1, "z")], "k string, n int, v string")
    assert {tuple(r) for r in snapshots.insert_or_replace(old, new, ["k"], [F.col("n")]).collect()} == {("a", 3, None), ("b", 1, "x"), ("c", 1, "z")}
    assert snapshots.insert_or_replace(old, new.limit(0), ["k"]).count() == 2


def test_forgetting_by_kind(spark):
    leads = spark.createDataFrame([("L1", "+63917", [], "a@x.ph", [], "x.ph"), ("L2", None, ["+63917"], None, ["b@m.y.ph"], None), ("L3", None, None, "c@notx.ph", None, None)], "lead_id string, phone string, phones_extra array<string>, email string, emails_extra array<string>, domain string")
    gone = lambda *kv: {r.lead_id for r in snapshots.to_forget(leads, spark.createDataFrame([kv], "kind string, value string")).collect()}
    assert gone("phone", "+63917") == {"L1", "L2"} and gone("domain", "x.ph") == {"L1"} and gone("domain", "y.ph") == {"L2"} and gone("email", "c@notx.ph") == {"L3"}
    raw = spark.createDataFrame([("osm", "1"), ("osm", "2")], "source string, source_ref string")
    listed = spark.createDataFrame([("L1", "osm", "1")], "lead_id string, source string, source_ref string")
    kept = spark.createDataFrame([("domain", "x.ph", "asked")], "kind string, value string, reason string")
    l, r, s = snapshots.forgotten(leads, raw, listed, kept, spark.createDataFrame([("domain", "x.ph")], "kind string, value string"), "new")
    assert (l.count(), [tuple(x) for x in r.collect()], [tuple(x) for x in s.collect()]) == (2, [("osm", "2")], [("domain", "x.ph", "asked")])


def test_jobs_and_sources(spark):
    rows = [{"category": "cafe", "location": f"p{i}"} for i in range(501)]
    with pytest.raises(ValueError):
        jobs.parse_jobs(spark, rows)
    assert jobs.parse_jobs(spark, rows[:500] + [{"category": "# x"}] * 100).count() == 500

    def bad():
        return spark.range(3).select(F.raise_error(F.lit("down")).cast("bigint").alias("id"))

    out, counts, errors = jobs.union_sources({"a": lambda: spark.range(3), "b": bad})
    assert out.count() == 3 and counts == {"a": 3} and set(errors) == {"b"}
    with pytest.raises(RuntimeError):
        jobs.union_sources({"b": bad})
    found = jobs.load_categories("dentist:\n  label: Dentists\n  synonyms: [tooth doctor]\n  osm:\n    - amenity=dentist\ncafe:\n  osm: [amenity=cafe]\n")
    assert found["dentist"]["osm"] == ["amenity=dentist"] and found["cafe"] == {"osm": ["amenity=cafe"]}
    with pytest.raises(ValueError):
        jobs.load_categories("a:\n  synonyms: [x]\n  osm: [k=v]\nb:\n  synonyms: [x]\n  osm: [k=v]\n")


def test_a_record_seen_again_overwrites_and_others_fill(spark):
    cols = "lead_id string, " + ", ".join(f"{c} {'double' if c in ('lat', 'lon') else 'string'}" for c in resolve.FIELDS) + ", " + ", ".join(f"{c} array<string>" for c in resolve.LISTS) + ", enrich_status string"

    def lead(i, name, phone, web):
        v = {"business_name": name, "phone": phone, "website": web}
        return (i, *(v.get(c) for c in resolve.FIELDS), ["+63"], [], ["osm"], [], "ok")

    df = spark.createDataFrame([lead("L1", "A", "+63", ""), lead("L2", "B", None, "https://b.ph")], cols)
    pairs = spark.createDataFrame([("L1", "L2")], "keep_id string, drop_id string")
    r = resolve.merged(pairs, df).first()
    assert (r.business_name, r.phone, r.website, r.phones_extra, r.enrich_status) == ("A", "+63", "https://b.ph", [], "pending")
    r = resolve.merged(pairs, df, F.lit(True)).first()
    assert (r.business_name, r.phone) == ("B", "+63")
