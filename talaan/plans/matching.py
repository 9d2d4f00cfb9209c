"""Entity-resolution queries over the leads table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talaan.operators import resolve
from talaan.plans.registry import Registry
from talaan.runtime import table

R = Registry()
query = R.query

_COLS = "lead_id, name_key, phone, domain, city_key, street_key, lat, lon, first_seen_at"
_L = f"(SELECT DISTINCT {_COLS} FROM leads)"
_OK = lambda t: f"({t}.lat IS NOT NULL AND {t}.lon IS NOT NULL AND NOT isnan({t}.lat) AND NOT isnan({t}.lon) AND {t}.lat BETWEEN -90 AND 90 AND {t}.lon BETWEEN -180 AND 180 AND NOT ({t}.lat = 0 AND {t}.lon = 0))"
_D = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))))"
_NEAR = f"(NOT {_OK('a')} OR NOT {_OK('b')} OR {_D} <= 250)"
_J = "(len(list_intersect(list_distinct(string_split(a.name_key, ' ')), list_distinct(string_split(b.name_key, ' ')))) / len(list_distinct(list_concat(string_split(a.name_key, ' '), string_split(b.name_key, ' ')))))"
_SIM = f"(a.name_key <> '' AND b.name_key <> '' AND (contains(a.name_key, b.name_key) OR contains(b.name_key, a.name_key) OR {_J} >= 0.5))"
_CLOSE = f"(a.name_key <> '' AND b.name_key <> '' AND (replace(a.name_key, ' ', '') = replace(b.name_key, ' ', '') OR {_J} >= 0.6))"
_OLDER = "(b.first_seen_at < a.first_seen_at OR (b.first_seen_at = a.first_seen_at AND b.lead_id < a.lead_id))"
_FEW = "(SELECT phone FROM leads WHERE phone IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name_key) < 3)"
_ON = {
    1: f"a.phone = b.phone AND a.phone <> '' AND a.phone IN {_FEW} AND {_SIM} AND {_NEAR}",
    2: "a.domain = b.domain AND a.domain <> '' AND a.city_key = b.city_key AND a.city_key <> ''",
    3: f"a.name_key = b.name_key AND a.name_key <> '' AND a.street_key = b.street_key AND a.street_key <> '' AND a.city_key = b.city_key AND a.city_key <> '' AND {_NEAR}",
    4: f"{_OK('a')} AND {_OK('b')} AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND {_D} <= 100 AND {_CLOSE}",
}
_RULE = lambda n: f"SELECT a.lead_id, b.lead_id AS other_id, {n} AS rule, b.first_seen_at AS seen FROM {_L} a JOIN {_L} b ON {_ON[n]} WHERE a.lead_id <> b.lead_id AND {_OLDER}"
_ALL = " UNION ALL ".join(_RULE(n) for n in _ON)


def _leads(spark, sf_dir):
    return resolve.slim(table(spark, sf_dir, "leads"))


def _rule(n):
    def run(spark, sf_dir):
        l = _leads(spark, sf_dir)
        return resolve.matches(l, l).where(F.col("rule") == n).select("lead_id", "other_id")

    run.__name__ = {1: "rule1_phone", 2: "rule2_domain_city", 3: "rule3_name_street_city", 4: "rule4_near_name"}[n]
    return query(f"SELECT lead_id, other_id FROM ({_RULE(n)})")(run)


for _n in _ON:
    _rule(_n)


@query(f"SELECT a.lead_id AS lead_a, b.lead_id AS lead_b, round({_D}, 2) AS metres FROM {_L} a JOIN {_L} b ON {_OK('a')} AND {_OK('b')} AND b.lat BETWEEN a.lat - 0.003 AND a.lat + 0.003 AND {_D} <= 250 WHERE a.lead_id < b.lead_id")
def haversine_pairs_250m(spark, sf_dir):
    from talaan.operators.near import cells, usable

    l = _leads(spark, sf_dir).where(usable(F.col("lat"), F.col("lon"))).select("lead_id", "lat", "lon")
    a = cells(l, "lat", "lon", 250.0, reach=False).select("cell", F.struct("lead_id", "lat", "lon").alias("a"))
    b = cells(l, "lat", "lon", 250.0, reach=True).select("cell", F.struct("lead_id", "lat", "lon").alias("b"))
    d = resolve.distance("a", "b")
    return a.join(b, "cell").where("a.lead_id < b.lead_id").where(d <= 250).select(F.col("a.lead_id").alias("lead_a"), F.col("b.lead_id").alias("lead_b"), F.round(d, 2).alias("metres"))


_FIRSTS = f"(SELECT lead_id, rule, arg_min(other_id, struct_pack(t := seen, x := other_id)) AS other_id FROM ({_ALL}) GROUP BY 1, 2)"
_MATCH = f"""(SELECT f.lead_id, f.other_id AS match_id, f.rule, (SELECT arg_min(g.other_id, g.rule) FROM {_FIRSTS} g WHERE g.lead_id = f.lead_id AND g.rule > f.rule AND g.other_id <> f.other_id) AS conflict_id
FROM {_FIRSTS} f WHERE f.rule = (SELECT min(g.rule) FROM {_FIRSTS} g WHERE g.lead_id = f.lead_id))"""


@query(f"SELECT lead_id, match_id, rule, conflict_id FROM {_MATCH}")
def first_match_rank(spark, sf_dir):
    return resolve.first_match(resolve.firsts(_leads(spark, sf_dir)))


@query(f"""SELECT DISTINCT least(a.lead_id, b.lead_id) AS lead_a, greatest(a.lead_id, b.lead_id) AS lead_b FROM (SELECT DISTINCT {_COLS} FROM leads WHERE enrich_status = 'ok') a JOIN {_L} b
ON (a.phone = b.phone AND a.phone <> '' AND {_SIM} AND {_NEAR}) OR (a.domain = b.domain AND a.domain <> '' AND a.city_key = b.city_key AND a.city_key <> '') WHERE a.lead_id <> b.lead_id""")
def post_enrich_pairs(spark, sf_dir):
    done = resolve.slim(table(spark, sf_dir, "leads").where("enrich_status = 'ok'"))
    all_ = _leads(spark, sf_dir)
    both = resolve.by_phone(done, all_, guard=False).unionByName(resolve.by_domain_city(done, all_))
    return both.select(F.least("a.lead_id", "b.lead_id").alias("lead_a"), F.greatest("a.lead_id", "b.lead_id").alias("lead_b")).distinct()


@query()
def location_duplicates(spark, sf_dir):
    return resolve.greedy_pairs(_leads(spark, sf_dir))


@query()
def merged_locations(spark, sf_dir):
    """Rule 4's duplicates merged until none is left: who was merged into whom, in which round."""
    return resolve.merge_location_duplicates(table(spark, sf_dir, "leads"), 2026)[1]


_REF = "(SELECT source, source_ref, min(record_id) AS first FROM raw_records GROUP BY 1, 2)"


@query(f"SELECT CAST(r.record_id AS VARCHAR) AS lead_id, 0 AS rule, CAST(f.first AS VARCHAR) AS other_id FROM raw_records r JOIN {_REF} f ON r.source = f.source AND r.source_ref = f.source_ref WHERE r.record_id <> f.first")
def rule0_source_ref(spark, sf_dir):
    """Records that a source listed before, each with the first record of its reference."""
    raw = table(spark, sf_dir, "raw_records").select("source", "source_ref", F.col("record_id"))
    known = raw.groupBy("source", "source_ref").agg(F.min("record_id").alias("first")).select("source", "source_ref", F.col("first").cast("string").alias("lead_id"))
    again = raw.select("source", "source_ref", F.col("record_id").cast("string").alias("lead_id"))
    return resolve.by_source_ref(again, known).where("lead_id <> other_id")


@query(f"""SELECT f.lead_id AS drop_id, f.match_id AS keep_id, coalesce(nullif(k.phone, ''), d.phone) AS phone, coalesce(nullif(k.website, ''), d.website) AS website,
array_to_string(list_sort(list_distinct(list_concat(k.sources, d.sources))), ',') AS sources, CASE WHEN coalesce(nullif(k.website, ''), d.website) IS DISTINCT FROM k.website THEN 'pending' ELSE k.enrich_status END AS enrich_status
FROM {_MATCH} f
JOIN (SELECT DISTINCT ON (lead_id) * FROM leads) k ON k.lead_id = f.match_id JOIN (SELECT DISTINCT ON (lead_id) * FROM leads) d ON d.lead_id = f.lead_id""")
def merge_fill(spark, sf_dir):
    leads = table(spark, sf_dir, "leads")
    l = resolve.slim(leads)
    pairs = resolve.first_match(resolve.firsts(l)).select(F.col("lead_id").alias("drop_id"), F.col("match_id").alias("keep_id"))
    m = resolve.merged(pairs, leads)
    return m.select("drop_id", "keep_id", "phone", "website", F.array_join(F.array_sort("sources"), ",").alias("sources"), "enrich_status")


QUERIES, SQL = R.queries, R.sql
