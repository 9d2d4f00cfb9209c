"""What a visited site changes in a lead, and the scoring step's rewrite of dead e-mails."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.functions import score, web


def _none() -> Column:
    return F.array().cast("array<string>")


def _rest(values: Column) -> Column:
    """All but the first."""
    return F.filter(values, lambda v, i: i > 0)


def _all(first: str, rest: str) -> Column:
    return F.filter(F.concat(F.array(first), F.coalesce(rest, _none())), lambda v: v.isNotNull() & (v != ""))


def apply_extraction(leads: DataFrame, found: DataFrame, suppressed: list[str]) -> DataFrame:
    """Leads with what their pages gave (``lead_id``, ``x`` as ``html.contacts`` returns it, ``https``).

    Suppressed contacts are dropped, all e-mails ranked, phones appended in order, empty social fields filled; the
    status is ok and the error cleared. Leads without a page stay as they are.
    """
    gone = F.array(*map(F.lit, suppressed)) if suppressed else _none()
    l = leads.join(found, "lead_id", "left")
    seen = F.col("x").isNotNull()
    mails = web.ranked_emails(F.array_except(F.array_union(_all("email", "emails_extra"), F.coalesce("x.emails", _none())), gone), F.col("domain"))
    nums = F.array_except(F.array_union(_all("phone", "phones_extra"), F.coalesce("x.phones", _none())), gone)
    new = {
        "email": F.get(mails, F.lit(0)), "emails_extra": _rest(mails), "phone": F.get(nums, F.lit(0)), "phones_extra": _rest(nums),
        "facebook": F.coalesce(F.nullif(F.col("facebook"), F.lit("")), F.col("x.socials")["facebook"]), "https_ok": F.col("https"), "enrich_status": F.lit("ok"),
    }
    return l.select(*(F.when(seen, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in leads.columns))


def without_dead_emails(leads: DataFrame, dead: DataFrame) -> DataFrame:
    """Leads without e-mails at hosts known to take none (``host``, ``has_mail``); unknown hosts never drop one.

    E-mails are ranked again only where one was dropped; ``n_dropped`` tells how many.
    """
    hosts = leads.select(F.col("lead_id"), F.explode(F.array_distinct(F.transform(_all("email", "emails_extra"), lambda e: F.lower(web.mail_host(e))))).alias("host"))
    bad = hosts.join(dead.where("has_mail = false").select("host").distinct(), "host", "left_semi").groupBy("lead_id").agg(F.collect_set("host").alias("bad_"))
    l = leads.join(bad, "lead_id", "left").withColumn("bad_", F.coalesce("bad_", _none()))
    kept = F.filter(_all("email", "emails_extra"), lambda e: ~F.array_contains(F.col("bad_"), F.lower(web.mail_host(e))))
    n = F.size(_all("email", "emails_extra")) - F.size(kept)
    ranked = web.ranked_emails(kept, F.col("domain"))
    new = {"email": F.get(ranked, F.lit(0)), "emails_extra": _rest(ranked)}
    return l.select(*(F.when(n > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in leads.columns), n.alias("n_dropped"))


def rescored(leads: DataFrame, year: int) -> DataFrame:
    return leads.withColumn("score", score.score()).withColumn("flags", score.flags(year))


def merged_stats(old: Column, new: Column) -> Column:
    """Two maps of statistics, the newer entry first."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def run_seconds(stats: Column) -> Column:
    """The sum of ``seconds`` over the objects of a JSON of step statistics; other entries don't count."""
    steps = F.from_json(stats, "map<string,string>")
    each = F.transform(F.map_values(steps), lambda v: F.coalesce(F.get_json_object(v, "$.seconds").try_cast("double"), F.lit(0.0)))
    return F.aggregate(F.coalesce(each, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)


def decode(body: bytes | None, content_type: str | None) -> str:
    """Text of a body: the header's charset, else the meta tag's in the first 4,096 bytes, else UTF-8; errors are replaced."""
    body = body or b""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I)
    meta = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:4096], re.I)
    for name in (named and named[1], meta and meta[1].decode("ascii", "replace"), "utf-8"):
        try:
            if name:
                return body.decode(name, "replace")
        except LookupError:
            continue
    return ""


def decode_column(body: Column, content_type: Column) -> Column:
    @F.pandas_udf("string")
    def go(b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([decode(x, y) for x, y in zip(b, t)], dtype=object)

    return go(body, content_type)
