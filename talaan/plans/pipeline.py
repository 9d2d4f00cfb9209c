"""The pipeline over DataFrames: raw records, cleaned leads, scores, exports; each stage is a function of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talaan.functions import score
from talaan.operators import cleaning
from talaan.plans.registry import Registry
from talaan.runtime import cut, table

R = Registry()
query = R.query
_GONE = [("email", "none@none.ph"), ("domain", "gone.example")]


def _clean(spark, sf_dir):
    raw, runs = table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "runs")
    c = cut(cleaning.candidates(raw, runs))
    kept = cleaning.without_suppressed(c, spark.createDataFrame(_GONE, "kind string, value string"))
    kept = cut(kept)
    return raw, c, kept, cut(cleaning.linked(kept))


@query()
def clean_leads(spark, sf_dir):
    """All raw records resolved and merged to leads, with scores."""
    _, _, kept, links = _clean(spark, sf_dir)
    leads = cleaning.leads_of(kept, links)
    return leads.select("lead_id", "business_name", "name_key", "city_key", "phone", "email", "website", F.array_join("sources", ",").alias("sources"), "n_records", score.score().alias("score"))


@query()
def clean_stats(spark, sf_dir):
    """Counts of the cleaning step per run."""
    return cleaning.stats(*_clean(spark, sf_dir))


@query("SELECT r.run_id, r.source, count(*) AS n_records, count(CASE WHEN regexp_matches(coalesce(r.city, ''), '[^\\s]') THEN NULL ELSE 1 END) AS from_area FROM raw_records r JOIN runs USING (run_id) GROUP BY 1, 2")
def city_fallbacks(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_records").join(table(spark, sf_dir, "runs").select("run_id"), "run_id")
    return raw.groupBy("run_id", "source").agg(F.count("*").alias("n_records"), F.count_if(~F.coalesce("city", F.lit("")).rlike(r"[^\s]")).alias("from_area"))


QUERIES, SQL = R.queries, R.sql
