"""Entity resolution over leads: rules 0 to 4 as equi joins, first match with conflicts, merging, repointing.

Candidates come from equal keys only (source reference, phone, domain and city, name and street and city, grid
cell), so no rule is a nested loop. Rules are ranked per lead by (rule, age, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.functions import names, score, web
from talaan.operators.near import cells, haversine_m, usable

PHONE_NEAR_M, NAME_NEAR_M, SHARED_PHONE_NAMES = 250.0, 100.0, 3
FIELDS = ["business_name", "name_key", "address", "city", "city_key", "province", "street_key", "lat", "lon", "phone", "email", "website", "domain", "facebook", "opening_hours"]
LISTS = ["phones_extra", "emails_extra", "sources", "categories"]


def distance(a: str, b: str) -> Column:
    """Metres between two struct columns, null where a position is unusable."""
    la, lo, lb, lp = (F.col(f"{x}.{c}") for x in (a, b) for c in ("lat", "lon"))
    return F.when(usable(la, lo) & usable(lb, lp), haversine_m(la, lo, lb, lp))


def near_or_unknown(a: str, b: str, metres: float) -> Column:
    return F.coalesce(distance(a, b) <= metres, F.lit(True))


def slim(leads: DataFrame) -> DataFrame:
    """Each lead once, as a struct with what the rules read."""
    cols = ["lead_id", "name_key", "phone", "domain", "city_key", "street_key", "lat", "lon", "first_seen_at"]
    return leads.select(*cols).dropDuplicates(["lead_id"])


def _pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    x = a.where(" and ".join(f"{c} <> ''" for c in on)).select(*on, F.struct(*a.columns).alias("a"))
    y = b.where(" and ".join(f"{c} <> ''" for c in on)).select(*on, F.struct(*b.columns).alias("b"))
    return _apart(x.join(y, on), a)


def _apart(pairs: DataFrame, a: DataFrame) -> DataFrame:
    """Leads are no pair with themselves; rows that stand for several leads may be."""
    return (pairs.where("a.lead_id <> b.lead_id") if "lead_id" in a.columns else pairs).select("a", "b")


def _unshared(leads: DataFrame, of: DataFrame) -> DataFrame:
    """Leads whose phone has fewer than three names: the guard goes before the join, so a switchboard makes no pairs."""
    names_of = of.where("phone <> ''").groupBy("phone").agg(F.countDistinct("name_key").alias("n")).where(F.col("n") >= SHARED_PHONE_NAMES)
    return leads.join(names_of.select("phone"), "phone", "left_anti").select(*leads.columns)


def by_phone(a: DataFrame, b: DataFrame, guard: bool = True) -> DataFrame:
    """Rule 1: one phone, similar names, at most 250 m apart or unknown; the phone has fewer than three names."""
    pairs = _pairs(_unshared(a, b) if guard else a, b, ["phone"])
    return pairs.where(names.similar(F.col("a.name_key"), F.col("b.name_key")) & near_or_unknown("a", "b", PHONE_NEAR_M))


def by_domain_city(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rule 2: one domain of its own and one city; names don't matter."""
    return _pairs(a.where(~web.is_shared(F.col("domain"))), b, ["domain", "city_key"])


def by_name_street_city(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rule 3: equal name, street and city keys, at most 250 m apart or unknown."""
    return _pairs(a, b, ["name_key", "street_key", "city_key"]).where(near_or_unknown("a", "b", PHONE_NEAR_M))


def by_place_and_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rule 4: at most 100 m apart with close names; on grid cells."""
    ok = usable(F.col("lat"), F.col("lon"))
    x = cells(a.where(ok), "lat", "lon", NAME_NEAR_M, reach=False).select("cell", F.struct(*a.columns).alias("a"))
    y = cells(b.where(ok), "lat", "lon", NAME_NEAR_M, reach=True).select("cell", F.struct(*b.columns).alias("b"))
    return _apart(x.join(y, "cell").where((distance("a", "b") <= NAME_NEAR_M) & names.close(F.col("a.name_key"), F.col("b.name_key"))), a)


RULES = {1: by_phone, 2: by_domain_city, 3: by_name_street_city, 4: by_place_and_name}
READS = {1: ["phone", "name_key", "lat", "lon"], 2: ["domain", "city_key"], 3: ["name_key", "street_key", "city_key", "lat", "lon"], 4: ["name_key", "lat", "lon"]}


def matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """``lead_id``, ``other_id``, ``rule``, ``at``: every rule's matches of leads ``a`` among older leads ``b``."""
    parts = []
    for rule, f in RULES.items():
        found = f(a, b).where("b.first_seen_at < a.first_seen_at or (b.first_seen_at = a.first_seen_at and b.lead_id < a.lead_id)")
        parts.append(found.select(F.col("a.lead_id").alias("lead_id"), F.col("b.lead_id").alias("other_id"), F.lit(rule).alias("rule"), F.col("b.first_seen_at").alias("at")))
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def firsts(leads: DataFrame) -> DataFrame:
    """``lead_id``, ``rule``, ``other_id``: the first older lead that each rule matches, by age, then id.

    Leads that a rule can't tell apart are one row, known by its oldest lead, before any join. So a domain, phone or name
    with a third of all rows joins once, not with itself, and no list of all pairs is made.
    """
    one = leads.withColumn("first", F.struct(F.col("first_seen_at").alias("t"), F.col("lead_id").alias("x")))
    parts = []
    for rule, f in RULES.items():
        cols = READS[rule]
        base = _unshared(one, leads) if rule == 1 else one.where(~web.is_shared(F.col("domain"))) if rule == 2 else one
        rows = base.groupBy(*cols).agg(F.min("first").alias("first"))
        kwargs = {"guard": False} if rule == 1 else {}
        met = f(rows, rows, **kwargs).select(*(F.col(f"a.{c}").alias(f"k_{c}") for c in cols), F.col("b.first").alias("other"))
        best = met.groupBy(*(f"k_{c}" for c in cols)).agg(F.min("other").alias("other"))
        same = F.lit(True)
        for c in cols:
            same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
        found = base.join(best, same).where("other.x <> lead_id and (other.t < first.t or (other.t = first.t and other.x < first.x))")
        parts.append(found.select("lead_id", F.lit(rule).alias("rule"), F.col("other.x").alias("other_id")))
    return _all(parts)


def by_source_ref(leads: DataFrame, records: DataFrame) -> DataFrame:
    """Rule 0: ``lead_id``, ``rule``, ``other_id`` of leads (``source``, ``source_ref``) that a source listed before (``records``: the same and ``lead_id``)."""
    known = records.groupBy("source", "source_ref").agg(F.min("lead_id").alias("other_id"))
    return leads.join(known, ["source", "source_ref"]).select("lead_id", F.lit(0).alias("rule"), "other_id")


def first_match(found: DataFrame) -> DataFrame:
    """``lead_id``, ``match_id``, ``rule``, ``conflict_id`` of the rules' first matches (``firsts``, and ``by_source_ref`` if known).

    The lowest rule's match counts; the first match of a later rule that is another lead is the conflict. Rule 0 has none.
    """
    r = found.groupBy("lead_id").agg(F.min(F.struct("rule", "other_id")).alias("m"), F.collect_list(F.struct("rule", "other_id")).alias("all"))  # one per rule at most
    other = F.array_sort(F.filter("all", lambda x: x["other_id"] != F.col("m.other_id")))
    return r.select("lead_id", F.col("m.other_id").alias("match_id"), F.col("m.rule").alias("rule"), F.when(F.col("m.rule") > 0, F.get(other, F.lit(0))["other_id"]).alias("conflict_id"))


def greedy_pairs(leads: DataFrame) -> DataFrame:
    """``keep_id``, ``drop_id``: rule 4 pairs of which no two share a lead, older leads choosing first.

    A pair is taken when it is the smallest open pair of both its leads by (older lead's age, id, other id);
    pairs that touch it are dropped; repeated until none is open. That is the order-dependent choice,
    computed in rounds.
    """
    from talaan.runtime import cut

    p = by_place_and_name(leads, leads).where("a.first_seen_at < b.first_seen_at or (a.first_seen_at = b.first_seen_at and a.lead_id < b.lead_id)")
    age = F.struct(F.col("a.first_seen_at").alias("t"), F.col("a.lead_id").alias("x"), F.col("b.first_seen_at").alias("u"), F.col("b.lead_id").alias("y"))
    open_ = cut(p.select(F.col("a.lead_id").alias("keep_id"), F.col("b.lead_id").alias("drop_id"), age.alias("o")).distinct())
    taken = None
    while not open_.isEmpty():
        best = open_.select(F.explode(F.array("keep_id", "drop_id")).alias("lead"), "o").groupBy("lead").agg(F.min("o").alias("best"))
        k, d = best.select(F.col("lead").alias("keep_id"), F.col("best").alias("bk")), best.select(F.col("lead").alias("drop_id"), F.col("best").alias("bd"))
        now = cut(open_.join(k, "keep_id").join(d, "drop_id").where((F.col("o") == F.col("bk")) & (F.col("o") == F.col("bd"))).select("keep_id", "drop_id"))
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(F.explode(F.array("keep_id", "drop_id")).alias("g"))
        open_ = cut(open_.join(gone, F.col("keep_id") == F.col("g"), "left_anti").join(gone, F.col("drop_id") == F.col("g"), "left_anti"), after=[open_])
    return taken if taken is not None else open_.select("keep_id", "drop_id")


def merged(pairs: DataFrame, leads: DataFrame, same_record: Column | None = None) -> DataFrame:
    """The kept lead of each (keep_id, drop_id): its own values win, empty ones are filled, lists are united in order.

    Where ``same_record`` (over ``k`` and ``d``) holds, the other is the same record of the same source seen again, and its values that
    aren't empty win. A phone or e-mail is never in its own list of others; a changed website makes enrichment pending.
    """
    one = leads.dropDuplicates(["lead_id"])
    k = one.select(F.col("lead_id").alias("keep_id"), F.struct(*one.columns).alias("k"))
    d = one.select(F.col("lead_id").alias("drop_id"), F.struct(*one.columns).alias("d"))
    x = pairs.join(k, "keep_id").join(d, "drop_id")
    types = dict(leads.dtypes)
    present = lambda c: F.nullif(F.col(c), F.lit("")) if types[c[2:]] == "string" else F.col(c)
    again = F.lit(False) if same_record is None else F.coalesce(same_record, F.lit(False))
    fill = {c: F.when(again, F.coalesce(present(f"d.{c}"), F.col(f"k.{c}"))).otherwise(F.coalesce(present(f"k.{c}"), F.col(f"d.{c}"))) for c in FIELDS}
    union = {c: F.array_union(F.coalesce(F.col(f"k.{c}"), F.array().cast("array<string>")), F.coalesce(F.col(f"d.{c}"), F.array().cast("array<string>"))) for c in LISTS}
    for extra, main in (("phones_extra", "phone"), ("emails_extra", "email")):
        union[extra] = F.when(fill[main].isNotNull(), F.array_remove(union[extra], F.coalesce(fill[main], F.lit("")))).otherwise(union[extra])
    changed = ~fill["website"].eqNullSafe(F.col("k.website"))
    return x.select("keep_id", "drop_id", *(v.alias(c) for c, v in (fill | union).items()), F.when(changed, "pending").otherwise(F.col("k.enrich_status")).alias("enrich_status"), "k", "d")


ENRICHED = ["enrich_status", "enriched_at", "https_ok", "tech", "mobile_viewport", "site_signals"]


def absorbed(pairs: DataFrame, leads: DataFrame, year: int) -> DataFrame:
    """The kept leads as rows of ``leads`` after taking in the dropped ones, with ``drop_id``.

    If the website kept is the dropped lead's and that was visited, its findings are taken over, so it isn't visited again. Scores are new.
    """
    m = merged(pairs, leads)
    take = (F.col("website") != "") & (F.col("website") == F.col("d.website")) & (F.col("d.enrich_status") != "pending")
    values = {c: F.when(F.coalesce(take, F.lit(False)), F.col(f"d.{c}")).otherwise(F.col(f"k.{c}") if c != "enrich_status" else F.col(c)) for c in ENRICHED}
    seen = {"last_seen_at": F.greatest("k.last_seen_at", "d.last_seen_at"), "updated_at": F.greatest("k.updated_at", "d.updated_at")}
    own = [c for c in leads.columns if c not in {*FIELDS, *LISTS, *values, *seen}]
    rows = m.select("drop_id", *(F.col(f"k.{c}").alias(c) for c in own), *FIELDS, *LISTS, *(v.alias(c) for c, v in (values | seen).items()))
    return rows.withColumn("score", score.score()).withColumn("flags", score.flags(year)).select("drop_id", *leads.columns)


def merge_location_duplicates(leads: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """The leads after merging rule 4's duplicates until none is left, and all merges (keep_id, drop_id, round).

    Each round takes pairs that share no lead, so a place stored three times takes two. Rounds halve the leads of a place.
    """
    from talaan.runtime import cut

    now, moves, n = cut(leads.dropDuplicates(["lead_id"])), None, 0
    while True:
        pairs = cut(greedy_pairs(slim(now)))
        if pairs.isEmpty():
            return now, moves if moves is not None else pairs.withColumn("round", F.lit(0))
        n += 1
        kept = absorbed(pairs, now, year).drop("drop_id")
        gone = pairs.select(F.explode(F.array("keep_id", "drop_id")).alias("lead_id"))
        now = cut(now.join(gone, "lead_id", "left_anti").select(*leads.columns).unionByName(kept), after=[now])
        step = pairs.withColumn("round", F.lit(n))
        moves = step if moves is None else moves.unionByName(step)
