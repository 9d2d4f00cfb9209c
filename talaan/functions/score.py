"""Scores, flags, segments and labels of leads. All are JVM expressions over a lead's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talaan.functions import dims
from talaan.functions.web import is_shared, mail_host, registered_domain


def has(c: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def own_domain_email() -> Column:
    return has("email") & has("domain") & ~is_shared(F.col("domain")) & F.coalesce(registered_domain(mail_host(F.col("email"))) == F.col("domain"), F.lit(False))


def score() -> Column:
    p = dims.POINTS
    parts = [
        (has("email"), p["email"]), (own_domain_email(), p["own_domain_email"]), (has("phone"), p["phone"]), (has("website"), p["website"]), (has("facebook"), p["social"]),
        (has("street_key"), p["street"]), (has("opening_hours"), p["hours"]),
    ]
    return F.least(sum((F.when(c, F.lit(n)).otherwise(0) for c, n in parts), F.lit(0)), F.lit(100))


def flags(year: int) -> Column:
    """Sales openings in display order. A site that wasn't read (null facts) gives no site flags; https_ok must be false, not null."""
    facts = F.col("site_signals")
    read = facts.isNotNull()
    stamp = F.get(F.filter(facts, lambda f: f.startswith("copyright:")), F.lit(0))
    old = F.regexp_extract(stamp, r"(\d+)$", 1).try_cast("int") <= year - 3
    tracked = F.exists(facts, lambda f: f.startswith("analytics:") | f.startswith("pixel:"))
    books = F.exists(facts, lambda f: f.startswith("booking:"))
    wanted = F.arrays_overlap(F.coalesce("categories", F.array().cast("array<string>")), F.array(*map(F.lit, dims.BY_APPOINTMENT)))
    tests = [
        ("no_website", ~has("website")), ("social_only", ~has("website") & has("facebook")), ("no_https", F.col("https_ok") == F.lit(False)),
        ("no_mobile_viewport", F.col("mobile_viewport") == F.lit(False)), ("free_email_provider", has("email") & mail_host(F.col("email")).isin(*dims.FREE_MAIL)),
        ("stale_site", read & old), ("no_analytics", read & ~tracked), ("no_online_booking", read & ~books & wanted),
    ]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in tests)))


def email_kind(email: Column, name_key: Column) -> Column:
    """'' without e-mail; business by role or name; personal by the look of a person's name; else unknown."""
    local = F.lower(F.substring_index(email, "@", 1))
    words = F.transform(F.split(local, "[._+-]"), lambda w: F.regexp_replace(w, r"\d+$", ""))
    roles = F.array(*map(F.lit, dims.ROLES))
    named = F.exists(F.split(F.coalesce(name_key, F.lit("")), " "), lambda w: (F.length(w) >= 3) & F.contains(local, w))
    person = r"^(?:dra?\.?)?([a-z]{2,})[._-]([a-z]{2,})(?:[._-][a-z]{1,})?\d*$"
    apart = local.rlike(person) & ~F.regexp_extract(local, person, 1).isin(*dims.ROLES) & ~F.regexp_extract(local, person, 2).isin(*dims.ROLES)
    doctor = local.rlike(r"^dra?[._-]?[a-z]{3,}\d*$")
    return F.when(~has(email), "").when(F.arrays_overlap(words, roles) | named, "business").when(apart | doctor, "personal").otherwise("unknown")


def why_contact(flags_: Column) -> Column:
    """The two first reasons in pitch order, joined, with a capital; '' without any."""
    def said(flag: str) -> Column:
        there = F.array_contains(flags_, flag)
        return there & ~F.array_contains(flags_, "social_only") if flag == "no_website" else there

    line = F.array_join(F.slice(F.array_compact(F.array(*(F.when(said(f), text) for f, text in dims.REASONS))), 1, 2), "; ")
    return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 10_000))


def reachable() -> Column:
    return has("email") | has("phone") | has("website") | has("facebook")


def segments() -> dict[str, Column]:
    """Named predicates over scored leads, in order."""
    f = F.col("flags")
    upgrade = F.arrays_overlap(f, F.array(*map(F.lit, ["no_https", "no_mobile_viewport", "stale_site"])))
    return {
        "no-website": ~has("website"), "facebook-only": F.array_contains(f, "social_only"), "website-upgrade": has("website") & upgrade,
        "no-booking": F.array_contains(f, "no_online_booking"), "business-email": has("email") & (email_kind(F.col("email"), F.col("name_key")) != "personal"),
    }


def share(n: Column, total: Column) -> Column:
    """``n (p%)`` with the percent floored; '0' of nothing."""
    return F.when(total > 0, F.concat(n.cast("string"), F.lit(" ("), F.floor(n * 100 / total).cast("string"), F.lit("%)"))).otherwise("0")
