"""The p-queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talaan.llm import addresses, business, canon, groups, history, linkage, packing, residue, survivors, tokenizer
from talaan.runtime import parallelism, scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.lead_groups(table(spark, sf_dir, "possible_duplicates"))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have each size."""
    sizes = p1_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_leads"))
    return sizes.groupBy("n_leads").agg(F.count("*").alias("n_groups"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivors.survivors(table(spark, sf_dir, "merge_candidates"), table(spark, sf_dir, "source_trust"))
    return found.select("group_no", "field_name", "lead_id")


def p2_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.golden(table(spark, sf_dir, "merge_candidates"), table(spark, sf_dir, "source_trust"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_business(table(spark, sf_dir, "raw_records"))


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its votes, confidence and whether it is accepted."""
    out = linkage.links(table(spark, sf_dir, "raw_records"))
    return out.select("ref_a", "ref_b", *linkage.VOTES, F.round("confidence", 6).alias("confidence"), "accepted")


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_records").select("record_id", "city", "province")
    leads = table(spark, sf_dir, "leads").select("lead_id", "city_key", "province")
    return canon.map_cities(raw, leads, table(spark, sf_dir, "canonical_cities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cities(spark, sf_dir).select("row_key", F.col("entry").alias("city_id")).distinct()


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values for which no entry is meant, and how many rows hold each."""
    return _cities(spark, sf_dir).where("entry = 'none'").groupBy("value").agg(F.countDistinct("row_key").alias("n_rows"))


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "lead_addresses").repartition(parallelism(spark))
    return records, table(spark, sf_dir, "canonical_cities")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_addresses(*_addresses(spark, sf_dir))


def p5_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city, street identifier, number and confidence of each address record that can be read."""
    r = addresses.resolved(*_addresses(spark, sf_dir))
    return r.select("address_id", "city_id", "street_id", "kind", "ext", "number", F.round("score", 3).alias("score"))


LEAD_COLUMNS = [
    "lead_id", "business_name", "categories", "address", "city", "city_key", "street_key", "lat", "lon", "phone", "phones_extra", "email", "emails_extra", "website", "domain", "facebook",
    "first_seen_run_id",
]


def _history(spark: SparkSession, sf_dir: str) -> tuple[history.History, DataFrame, DataFrame]:
    """An empty history, leads and runs; which words of a name tell the kind is learned from all leads."""
    leads, runs = table(spark, sf_dir, "leads").select(*LEAD_COLUMNS), table(spark, sf_dir, "runs")
    return history.History(spark, f"{scratch(spark)}/history-{uuid.uuid4().hex}", business.learn(business.from_leads(leads))), leads, runs


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs in one batch against an empty history; within it, each lead against those before it."""
    past, leads, runs = _history(spark, sf_dir)
    return past.add(leads, runs)


def p6_late_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the last quarter of the time as a batch of their own, against the history of the earlier ones."""
    past, leads, runs = _history(spark, sf_dir)
    ends = runs.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).first()
    when = ends.a + (ends.b - ends.a) * 0.75
    late = runs.where(F.col("created_at") > F.lit(when)).select(F.col("run_id").alias("first_seen_run_id"))
    past.add(leads.join(late, "first_seen_run_id", "left_anti"), runs)
    return past.add(leads.join(late, "first_seen_run_id", "left_semi"), runs)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer.encode(docs.repartition(parallelism(spark)))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: texts, tokens, and texts that decode to something else than they were (none)."""
    docs = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).repartition(parallelism(spark))
    ids = docs.withColumn("ids", tokenizer.encode_column(F.col("text")))
    back = ids.withColumn("back", tokenizer.decode_column(F.col("ids")))
    return back.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.count_if(F.col("back") != F.col("text")).alias("n_changed")
    )


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs.repartition(parallelism(spark)))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, the tokens in them, and the share of their space that is used."""
    boxes = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return boxes.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"),
        F.round(F.sum("n") / (F.count("*") * packing.CAPACITY), 4).alias("used_share"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return residue.residue(docs.repartition(parallelism(spark))).where("excluded").select("doc_id").distinct()


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of page: how many texts are excluded, and for which reason (a text may have several)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "page_kind").repartition(parallelism(spark))
    j = docs.select("page_kind", residue.judge_column(F.col("text")).alias("j")).select("page_kind", "j.*")
    error = F.col("coverage") >= residue.COVERED
    return j.groupBy("page_kind").agg(
        F.count("*").alias("n_docs"), F.count_if("slot").alias("n_slot"), F.count_if("filler").alias("n_filler"), F.count_if(error).alias("n_error"),
        F.count_if(F.col("slot") | F.col("filler") | error).alias("n_excluded"),
    )


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1].isdigit()}
_ID = """CASE WHEN lower({c}) LIKE 'l-%' THEN 'L-' || lower(substr({c}, 3)) ELSE lower({c}) END"""
_SIDE = "nullif(regexp_replace(lead_id_{s}, '^[\\s]+|[\\s]+$', '', 'g'), '')"
_EDGES = f"(SELECT {_ID.format(c='a')} AS a, {_ID.format(c='b')} AS b FROM (SELECT {_SIDE.format(s='a')} AS a, {_SIDE.format(s='b')} AS b FROM possible_duplicates) WHERE a IS NOT NULL AND b IS NOT NULL AND lower(a) <> lower(b))"
_GROUPS = f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
SELECT node AS lead_id, min(other) AS group_id FROM r GROUP BY 1"""
_AT = """CASE WHEN regexp_matches(updated_at, '^\\d{4}-\\d{2}-\\d{2}([T ].*)?$') THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(updated_at, '(Z|[+-]\\d{2}:\\d{2})$') AND length(updated_at) > 10 THEN updated_at
WHEN length(updated_at) > 10 THEN updated_at || '+00:00' ELSE updated_at || ' 00:00:00+00:00' END AS TIMESTAMPTZ)) END"""
_USABLE = {
    "phone": "regexp_matches(trim(phone), '^\\+639\\d{9}$') AND len(list_distinct(string_split(substr(trim(phone), 5), ''))) > 1",
    "website": "regexp_matches(trim(website), '(?i)^https?://([A-Za-z0-9_-]+\\.)+[A-Za-z0-9_-]+([/?#:].*)?$')",
    "email": "regexp_matches(trim(email), '^[^@\\s]+@([A-Za-z0-9_-]+\\.)+[A-Za-z0-9_-]+$')",
}
_BEST = " UNION ALL ".join(
    f"""SELECT group_no, '{f}' AS field_name, lead_id, value FROM (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY trust DESC, seen DESC NULLS LAST, lead_id, value) AS n
FROM (SELECT m.group_no, m.lead_id, trim(m.{f}) AS value, CASE WHEN {_AT} < epoch_us(TIMESTAMPTZ '2031-01-01 00:00:00+00:00') THEN {_AT} END AS seen,
(SELECT coalesce(max(t.trust), 0) FROM source_trust t WHERE list_contains(list_transform(coalesce(m.sources, []), lambda s: lower(trim(s))), lower(trim(t.source)))) AS trust
FROM merge_candidates m WHERE {ok})) WHERE n = 1"""
    for f, ok in _USABLE.items()
)

SQL: dict[str, str] = {
    "p1_found": _GROUPS,
    "p1_sizes": f"SELECT n_leads, count(*) AS n_groups FROM (SELECT group_id, count(*) AS n_leads FROM ({_GROUPS}) GROUP BY 1) GROUP BY 1",
    "p2_found": f"SELECT group_no, field_name, lead_id FROM ({_BEST})",
    "p2_golden": "SELECT g.group_no, g.n_records, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN value END) AS {f}" for f in _USABLE)
    + f" FROM (SELECT group_no, count(*) AS n_records FROM merge_candidates GROUP BY 1) g LEFT JOIN ({_BEST}) b USING (group_no) GROUP BY 1, 2",
}
