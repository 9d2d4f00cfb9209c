"""Changes to stored tables as new snapshots: the Parquet tables are never changed in place.

Each function returns the new table; ``runtime.cut`` or a write to a fresh folder makes it the stored one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` and the rows whose key it lacks; of rows with one key the first by ``order``."""
    ranks = [o.alias(f"rank_{i}") for i, o in enumerate(order)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*ranks, *[F.col(c) for c in target.columns if c not in keys])).alias("m"))
    fresh = first.select(*keys, *(F.col(f"m.{c}") for c in target.columns if c not in keys)).select(*target.columns)
    return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))


def insert_or_replace(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``rows`` and what of ``target`` they don't replace; of rows with one key the last by ``order``, then by their other values."""
    rest = [c for c in target.columns if c not in keys]
    ranks = [o.alias(f"rank_{i}") for i, o in enumerate(order or [])]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*ranks, *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest)).select(*target.columns)
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(last)


def suppressed(email: Column, extra: Column, domain: Column, gone: str) -> Column:
    """The domain itself, or any e-mail at it or at a subdomain."""
    at = lambda e: F.endswith(F.concat(F.lit("."), F.substring_index(e, "@", -1)), F.lit("." + gone))
    return F.coalesce(domain == gone, F.lit(False)) | F.coalesce(at(email), F.lit(False)) | F.exists(F.coalesce(extra, F.array().cast("array<string>")), at)


def to_forget(leads: DataFrame, gone: DataFrame) -> DataFrame:
    """``lead_id`` of leads that hold a value of ``gone`` (``kind`` phone, email or domain, ``value``).

    A domain also means every e-mail at it or at a subdomain of it. One join on the values, however long the list.
    """
    none = F.array().cast("array<string>")
    mails = F.concat(F.array("email"), F.coalesce("emails_extra", none))
    host = lambda e: F.lower(F.substring_index(e, "@", -1))
    above = lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\."))), lambda n: F.call_function("substring_index", h, F.lit("."), -n))
    held = F.flatten(F.array(
        F.transform(F.concat(F.array("phone"), F.coalesce("phones_extra", none)), lambda p: F.concat(F.lit("phone:"), p)), F.transform(mails, lambda e: F.concat(F.lit("email:"), e)),
        F.transform(F.flatten(F.transform(F.filter(mails, lambda e: e.isNotNull()), lambda e: above(host(e)))), lambda d: F.concat(F.lit("domain:"), d)), F.array(F.concat(F.lit("domain:"), "domain")),
    ))
    keys = leads.select("lead_id", held.alias("ks")).select("lead_id", F.explode("ks").alias("k")).where("k is not null")
    return keys.join(gone.select(F.concat_ws(":", "kind", "value").alias("k")).distinct(), "k", "left_semi").select("lead_id").distinct()


def forgotten(leads: DataFrame, raw: DataFrame, listed: DataFrame, suppressions: DataFrame, gone: DataFrame, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leads, raw records and suppressions after forgetting ``gone``.

    ``listed`` (lead_id, source, source_ref) says which raw records a lead came from; they go with it. Suppressions there are kept as they are.
    """
    ids = to_forget(leads, gone)
    records = listed.join(ids, "lead_id", "left_semi").select("source", "source_ref").distinct()
    new = gone.select("kind", "value").distinct().join(suppressions.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("reason", F.lit(reason))
    return leads.join(ids, "lead_id", "left_anti"), raw.join(records, ["source", "source_ref"], "left_anti"), suppressions.select("kind", "value", "reason").unionByName(new)


def forget(leads: DataFrame, raw: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a domain's leads and records."""
    keep = leads.where(~suppressed(F.col("email"), F.col("emails_extra"), F.col("domain"), gone))
    host = F.regexp_extract(F.lower("website_raw"), r"^(?:https?://)?(?:www\.)?([^/?#:]+)", 1)
    hit = (F.coalesce(host, F.lit("")) == gone) | F.exists("emails_raw", lambda e: F.endswith(F.concat(F.lit("."), F.lower(F.substring_index(e, "@", -1))), F.lit("." + gone)))
    return keep, raw.where(~hit)


def purge(raw: DataFrame, runs: DataFrame, leads: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows from ``cutoff`` on or of unfinished runs, and leads seen from ``cutoff`` on."""
    t = F.lit(cutoff).cast("timestamp_ntz")
    open_ = runs.where("run_status in ('partial', 'running')").select("run_id")
    old = raw.where(F.col("fetched_at") < t)
    return raw.where(F.col("fetched_at") >= t).unionByName(old.join(open_, "run_id", "left_semi").select(*raw.columns)), leads.where(F.col("last_seen_at") >= t)


def repoint(links: DataFrame, moves: DataFrame) -> DataFrame:
    """``run_id``, ``lead_id`` with dropped leads replaced by the kept ones, repeats gone."""
    m = moves.select(F.col("drop_id").alias("lead_id"), "keep_id")
    return links.join(m, "lead_id", "left").select("run_id", F.coalesce("keep_id", "lead_id").alias("lead_id")).distinct()


def upsert_plan(grid: DataFrame, rows: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """``key``, ``action``: update what the sheet has, append what is new, skip what a client removed, keep the rest.

    Rows sent before and missing now stay removed unless none of ours is left.
    """
    g = grid.select(key).where(f"{key} <> ''").distinct().withColumn("in_grid", F.lit(True))
    r = rows.select(key).distinct().withColumn("in_rows", F.lit(True))
    s = sent.select(key).distinct().withColumn("in_sent", F.lit(True))
    any_left = g.join(s, key, "left_semi").agg((F.count("*") > 0).alias("any_left")).scalar()
    x = g.join(r, key, "full").join(s, key, "left")
    removed = F.col("in_sent").isNotNull() & any_left
    action = F.when(F.col("in_rows").isNull(), "keep").when(F.col("in_grid").isNotNull(), "update").when(removed, "skip").otherwise("append")
    return x.select(key, action.alias("action"))


def fill_plan(target: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, ``action`` and fields: create what the target lacks, fill only its empty fields."""
    t = target.select(F.col(key), F.lit(True).alias("there"), *(F.col(f).alias(f"t_{f}") for f in fields))
    x = rows.select(key, *fields).join(t, key, "left")
    empty = [F.col(f"t_{f}").isNull() | (F.col(f"t_{f}") == "") for f in fields]
    fills = [e & F.col(f).isNotNull() & (F.col(f) != "") for e, f in zip(empty, fields)]
    some = fills[0]
    for c in fills[1:]:
        some = some | c
    action = F.when(F.col("there").isNull(), "create").when(some, "fill").otherwise("none")
    return x.select(key, action.alias("action"), *(F.when(e, F.col(f)).otherwise(F.col(f"t_{f}")).alias(f) for e, f in zip(empty, fields)))
