"""What listings and leads are compared by, as JVM expressions: one schema for both.

``words`` are the folded words of a name up to a dash, comma or bracket. Which of them say what a business is, and not
which, is learned from the records at hand (``learn``). Phones are national digits, websites are hosts, streets are
names without number, unit and type. Contacts are only compared for equality and are kept as 32-bit hashes; a chance
agreement of two hashes is one vote among many.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.functions.text import fold
from talaan.operators.near import haversine_m, usable

NEAR_M, CLOSE_M = 150.0, 50.0
COMMON, AT_LEAST = 1 / 800, 8  # a word is common if at least this share of the records has it, and so many of them
PURE = 0.9  # a common word tells the kind if this share of its labelled records is of one kind

# Words for parts of an address, which never tell one street or city from another.
STREET_TYPES = "st str street ave av avenue blvd boul boulevard rd road ln lane dr drive calle kalye ext extn extension".split()
ADMINISTRATIVE = "city of municipality mun bayan lungsod ng brgy barangay bgy sitio poblacion near area proper capital ph philippines c o".split()
_UNIT = r"^\s*(?:(?:unit|suite|ste|rm|room|stall|space|door|g/f|\d+/f|\d+(?:st|nd|rd|th) floor)\.?\s*#?\d*[a-z]?\s*,\s*|(?:unit|suite|rm|stall|space)\.?\s*\d+[a-z]?\s+)+"
_NUMBER = r"^\s*(?:no\.?|nr\.?|#)?\s*(\d+[a-z]?)\b[.,]?"


# What follows runs for every record: patterns are replaced by one pass each, since split() compiles its pattern and a lambda is interpreted each time.


def _mapped(c: Column, letters: str, to: str) -> Column:
    """translate() where there is a letter to translate; it is slow, and few texts have one."""
    hit = F.contains(c, F.lit(letters[0]))
    for x in letters[1:]:
        hit = hit | F.contains(c, F.lit(x))
    return F.when(hit, F.translate(c, letters, to)).otherwise(c)


def _joined(c: Column) -> Column:
    """Without apostrophes, which separate no words."""
    return _mapped(c, "'’`", "")


def _plain(folded: Column) -> Column:
    """A folded name in which commas and hyphens stand for brackets, bars and dashes."""
    return _mapped(folded, "(|–—", ",,--")


def _head(plain: Column) -> Column:
    """The text before the first comma or spaced hyphen; the whole if nothing is before it."""
    head = F.substring_index(F.substring_index(plain, ",", 1), " - ", 1)
    return F.when(F.trim(head) == "", plain).otherwise(head)


def _words(head: Column) -> Column:
    return F.trim(F.regexp_replace(_joined(head), "[^a-z0-9]+", " "))


def _folded(c: Column) -> Column:
    return fold(F.coalesce(c, F.lit("")))


def _either(tokens: list[str]) -> str:
    """A pattern for one of ``tokens``, by first letter. Whoever uses it bounds the word, so their order says nothing."""
    rest = defaultdict(list)
    for t in tokens:
        rest[t[:1]].append(re.escape(t[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in rest.items())


@dataclass
class Lexicon:
    """Common words, each with the kind of business it tells, or None."""

    kinds: dict[str, str | None]

    def core(self, joined: Column) -> Column:
        """The words that aren't common; all words if none is left."""
        if not self.kinds:
            return joined
        kept = F.ltrim(F.regexp_replace(joined, f"(?:^| )(?:{_either(sorted(self.kinds))})(?![^ ])", ""))
        return F.coalesce(F.nullif(kept, F.lit("")), joined)

    def kind(self, joined: Column, label: Column) -> Column:
        """The kind a record is labelled with, else the one that its first telling word tells."""
        known = {w: k for w, k in self.kinds.items() if k}
        if not known:
            return label
        of = F.create_map(*(F.lit(x) for w in sorted(known) for x in (w, known[w])))
        return F.coalesce(label, F.try_element_at(of, F.regexp_extract(joined, f"(?:^| )({_either(sorted(known))})(?![^ ])", 1)))


def learn(records: DataFrame) -> Lexicon:
    """The lexicon of records with ``words`` and ``label`` (a kind, or null), from counts over all of them.

    A word is kept if one record in 1 / ``COMMON`` has it, so at most (words per name) / ``COMMON`` words reach the driver,
    whatever the size of the table.
    """
    total = records.count()
    own = records.select("label", F.array_distinct(F.split("words", " ")).alias("ws"))
    each = own.select("label", F.explode_outer("ws").alias("w")).where("w <> ''")  # a plain explode would make the words twice, once to filter by their number
    counts = each.groupBy("w", "label").agg(F.count("*").alias("n"))
    known = F.col("label").isNotNull()
    by_word = counts.groupBy("w").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n"))).alias("known"), F.max(F.when(known, F.struct("n", "label"))).alias("top")
    )
    rows = by_word.where(F.col("n") >= max(total * COMMON, AT_LEAST)).collect()
    pure = lambda r: r["known"] is not None and r["known"] >= AT_LEAST and r["top"]["n"] >= PURE * r["known"]
    return Lexicon({r["w"]: r["top"]["label"] if pure(r) else None for r in rows})


def _hashes(text: Column, parts: Column, one: Column, fits) -> Column:
    """The distinct hashes of what fits: of ``parts``, between semicolons, if ``text`` has a semicolon; else, as for most, of ``one``, without lambdas."""
    none = F.array().cast("array<int>")
    several = F.array_distinct(F.transform(F.filter(F.split(parts, ";"), fits), lambda x: F.hash(x)))
    return F.when(F.contains(text, F.lit(";")), several).when(fits(one), F.array(F.hash(one))).otherwise(none)


def _without(tokens: list[str], letters: str) -> str:
    """A pattern for whole words among ``tokens``; words are of ``letters``."""
    return f"(?<![{letters}])(?:{_either(tokens)})(?![{letters}])"


def _digits(values: Column) -> Column:
    """Typed numbers without extensions as digits, semicolons between them."""
    joined = F.array_join(values, ";")
    plain = F.when(joined.rlike("[lexLEX]"), F.regexp_replace(joined, r"(?i)(loc|ext|local)\.?\s*\d+", "")).otherwise(joined)
    return _mapped(F.regexp_replace(plain, "[^0-9;,/|]+", ""), ",/|", ";;;")


def _phone_hashes(digits: Column) -> Column:
    """Country code and trunk 0 go at the start of each number."""
    one = F.ltrim(F.when(F.startswith(digits, F.lit("63")), F.substring(digits, 3, 1 << 30)).otherwise(digits), F.lit("0"))
    return _hashes(digits, F.regexp_replace(digits, "(?<![0-9])(?:63)?0*", ""), one, lambda p: F.length(p) >= 8)


def _addresses(values: Column) -> Column:
    """Typed e-mails in lower case, semicolons between them."""
    return F.regexp_replace(F.replace(F.lower(F.array_join(values, ";")), F.lit("mailto:"), F.lit("")), r"[;,|\s]+", ";")


def _mail_hashes(addresses: Column) -> Column:
    return _hashes(addresses, addresses, addresses, lambda e: F.contains(e, F.lit("@")))


def phones(values: Column) -> Column:
    """Hashes of the national digits of all numbers in a list of typed numbers."""
    return _phone_hashes(_digits(values))


def host(website: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(website)), r"^(?:https?://)?(?:www\.)?([^/?#:\s]+\.[^/?#:\s]+)", 1), F.lit(""))


def emails(values: Column) -> Column:
    return _mail_hashes(_addresses(values))


def handle(facebook: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(facebook)), r"^(?:https?://)?(?:www\.|m\.)?facebook\.com/|^@|/+$", ""), F.lit(""))


def _line(folded: Column) -> Column:
    """A folded street line without its unit."""
    return F.regexp_replace(folded, _UNIT, "")


def _lead(line: Column) -> Column:
    return F.regexp_extract(line, _NUMBER, 1)


def _name(line: Column, lead: Column) -> Column:
    """The street line after its number, up to a comma."""
    return F.substring_index(F.when(lead == "", line).otherwise(F.regexp_replace(F.regexp_replace(line, _NUMBER, ""), _UNIT, "")), ",", 1)


def _kept(name: Column) -> Column:
    return F.nullif(F.regexp_replace(_joined(name), _without(STREET_TYPES, "a-z0-9") + "|[^a-z0-9]+", ""), F.lit(""))


def street_parts(street: Column) -> tuple[Column, Column]:
    """Number and name of a street line."""
    line = _line(_folded(street))
    lead = _lead(line)
    return F.nullif(lead, F.lit("")), _kept(_name(line, lead))


def city_text(city: Column) -> Column:
    kept = F.regexp_replace(_folded(city), _without(ADMINISTRATIVE, "a-z"), "")
    return F.nullif(F.trim(F.regexp_replace(kept, "[^a-z]+", " ")), F.lit(""))


def core(name: str = "name") -> Column:
    """The core as one word."""
    return F.replace(F.col(name), F.lit(" "), F.lit(""))


def _hashed(c: Column) -> Column:
    return F.when(c.isNotNull(), F.hash(c))


def _finish(df: DataFrame) -> DataFrame:
    ok = usable(F.col("lat"), F.col("lon"))
    return df.withColumn("lat", F.when(ok, F.col("lat"))).withColumn("lon", F.when(ok, F.col("lon")))


def _parsed(rows: DataFrame) -> DataFrame:
    """``words``, ``num`` and ``street`` in place of the texts ``name_``, ``number_`` and ``street_``; without ``number_`` the street has the number.

    What a step reads more than once is a column of the step before. Written into one expression it would be copied each time, for a name
    90 times with all the letters that folding knows: a plan of megabytes, of which the driver holds many.
    """
    name, number, street = F.col("name_"), F.col("number_"), F.col("street_")
    own = "number_" in rows.columns
    steps = [
        {"name_": _folded(name), "street_": _line(_folded(street))} | ({"number_": _line(_folded(number))} if own else {}),
        {"name_": _plain(name), "lead_": _lead(street)},
        {"name_": _head(name), "street_": _name(street, F.col("lead_"))},
        {"words": _words(name), "num": F.nullif(_lead(number) if own else F.col("lead_"), F.lit("")), "street": _kept(street)},
    ]
    for s in steps:
        rows = rows.withColumns(s)
    return rows.drop("name_", "number_", "street_", "lead_")


def from_raw(raw: DataFrame) -> DataFrame:
    """Listings; rows without source_ref or name aren't listings. A label is read from the payload's category if there is one."""
    label = F.lit(None).cast("string")
    if "payload" in raw.columns:  # without the word, or an escape that may hide it, there is nothing to parse for
        may = F.contains("payload", F.lit("category")) | F.contains("payload", F.lit("\\"))
        label = F.when(may, F.get_json_object("payload", "$.category"))
    house = F.regexp_extract(F.lower("housenumber"), r"(\d+[a-z]?)", 1)
    x = _parsed(
        raw.where("source_ref is not null and trim(name) <> ''").withColumns({"phones_": _digits(F.col("phones_raw")), "mails_": _addresses(F.col("emails_raw"))}).select(
            F.col("source_ref").alias("key"), F.coalesce("source", F.lit("")).alias("src"), "record_id", F.col("name").alias("name_"), label.alias("label"),
            _phone_hashes(F.col("phones_")).alias("phones"), _hashed(host(F.col("website_raw"))).alias("web"), _mail_hashes(F.col("mails_")).alias("mails"), _hashed(handle(F.col("facebook"))).alias("fb"),
            F.nullif(house, F.lit("")).alias("house"), F.col("street").alias("street_"), city_text(F.col("city")).alias("city"),
            F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        )
    )
    return _finish(x.withColumn("num", F.coalesce("house", "num")).select("key", "src", "record_id", "words", "label", "phones", "web", "mails", "fb", "num", "street", "city", "lat", "lon"))


def from_leads(leads: DataFrame) -> DataFrame:
    """Leads by ``key``, the lead_id; a repeated lead has repeated rows. ``address`` gives the number, ``street_key`` the street."""
    label = F.get("categories", F.lit(0)) if "categories" in leads.columns else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    more = lambda one, rest: F.concat(F.array(F.coalesce(F.col(one), F.lit(""))), F.coalesce(F.col(rest), none))
    x = _parsed(
        leads.where("lead_id is not null").withColumns({"phones_": _digits(more("phone", "phones_extra")), "mails_": _addresses(more("email", "emails_extra"))}).select(
            F.col("lead_id").alias("key"), F.col("business_name").alias("name_"), label.alias("label"), _phone_hashes(F.col("phones_")).alias("phones"),
            _hashed(F.coalesce(F.lower("domain"), host(F.col("website")))).alias("web"), _mail_hashes(F.col("mails_")).alias("mails"), _hashed(handle(F.col("facebook"))).alias("fb"),
            F.col("address").alias("number_"), F.col("street_key").alias("street_"), city_text(F.coalesce("city_key", "city")).alias("city"), F.col("lat").cast("double").alias("lat"),
            F.col("lon").cast("double").alias("lon"), F.col("first_seen_run_id").alias("run"),
        )
    )
    return _finish(x.select("key", "words", "label", "phones", "web", "mails", "fb", "num", "street", "city", "lat", "lon", "run"))


SAME_KIND = "(a.q = b.q or a.q = 0 or b.q = 0)"  # over two rows with kind_code()


def kind_code() -> Column:
    """``q``: a number for the kind, 0 if it isn't known."""
    return F.coalesce(F.hash("kind") * F.when(F.col("kind").isNotNull(), 1), F.lit(0)).alias("q")


COMPARED = ["name", "kind", "phones", "web", "mails", "fb", "num", "street", "city", "lat", "lon"]


def named(records: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``records`` with ``name`` (the core's words) and ``kind`` in place of ``words`` and ``label``."""
    return records.withColumn("name", lexicon.core(F.col("words"))).withColumn("kind", lexicon.kind(F.col("words"), F.col("label"))).drop("words", "label")


def alike(a: Column, b: Column, longest: int = 2) -> Column:
    """Two words that one or two slips keep apart; long ones may differ by more."""
    d = F.levenshtein(a, b, longest)
    return F.when(a == b, True).otherwise((d >= 0) & (d <= F.when(F.least(F.length(a), F.length(b)) >= 6, F.lit(longest)).otherwise(F.lit(1))))


def same_name(a: str, b: str) -> Column:
    """The names' cores agree: alike, one within the other, or an initial for the first word."""
    ca, cb = core(f"{a}.name"), core(f"{b}.name")
    na, nb = F.col(f"{a}.name"), F.col(f"{b}.name")
    head = lambda c: F.substring_index(c, " ", 1)
    tail = lambda c: F.substring_index(c, " ", -1)
    inside = (F.least(F.length(ca), F.length(cb)) >= 7) & (F.contains(ca, cb) | F.contains(cb, ca))
    two = (F.length(na) == F.length(ca) + 1) & (F.length(nb) == F.length(cb) + 1)  # one space
    initial = (F.substring(na, 2, 1) == " ") | (F.substring(nb, 2, 1) == " ")
    short = initial & (F.substring(ca, 1, 1) == F.substring(cb, 1, 1)) & alike(tail(na), tail(nb))
    swapped = F.concat(tail(nb), head(nb)) == ca
    return F.coalesce(alike(ca, cb) | inside | (two & (short | swapped)), F.lit(False))


def near_name(a: str, b: str) -> Column:
    """The shorter core is nearly the head or the tail of the longer: slips in words for the kind, or in both names."""
    ca, cb = core(f"{a}.name"), core(f"{b}.name")
    n = F.least(F.length(ca), F.length(cb))
    slips = F.when(n >= 8, 2).otherwise(1)
    head = F.levenshtein(F.substring(ca, F.lit(1), n), F.substring(cb, F.lit(1), n), 2)
    tail = F.levenshtein(F.substring(ca, F.length(ca) - n + 1, n), F.substring(cb, F.length(cb) - n + 1, n), 2)
    return (n >= 4) & (head.between(0, slips) | tail.between(0, slips))


def _vote(known: Column, agree: Column) -> Column:
    """1 agrees, -1 differs, 0 where a side says nothing."""
    return F.when(F.coalesce(known, F.lit(False)), F.when(F.coalesce(agree, F.lit(False)), 1).otherwise(-1)).otherwise(0).cast("int")


VOTES = ["name", "kind", "phone", "web", "mail", "fb", "place", "street", "num", "city", "spot"]


def votes(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """``keep`` and the matching functions over two struct columns.

    Each says 1, -1 or nothing (0); ``name`` says 2 for equal cores, ``place`` 2 within 50 m and 1 within 150 m.
    One is composed of others: ``spot`` reads position, number and contacts together (a number that differs tells
    neighbours apart unless they share a contact; without positions the address has to agree, or the city and a contact).
    """

    def both(c):
        return F.col(f"{a}.{c}").isNotNull() & F.col(f"{b}.{c}").isNotNull()

    def eq(c):
        return F.col(f"{a}.{c}") == F.col(f"{b}.{c}")

    def sets(c):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        return _vote((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))

    d = haversine_m(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))
    city_a, city_b = F.col(f"{a}.city"), F.col(f"{b}.city")
    street_a, street_b = F.col(f"{a}.street"), F.col(f"{b}.street")
    first = {
        "name": F.when(core(f"{a}.name") == core(f"{b}.name"), 2).when(same_name(a, b), 1).when(near_name(a, b), 0).otherwise(-1).cast("int"),
        "kind": _vote(both("kind"), eq("kind")), "phone": sets("phones"), "web": _vote(both("web"), eq("web")), "mail": sets("mails"), "fb": _vote(both("fb"), eq("fb")),
        "place": F.when(both("lat") & both("lon"), F.when(d <= CLOSE_M, 2).when(d <= NEAR_M, 1).otherwise(-1)).otherwise(0).cast("int"),
        "street": _vote(both("street"), alike(street_a, street_b) | F.contains(street_a, street_b) | F.contains(street_b, street_a)), "num": _vote(both("num"), eq("num")),
        "city": _vote(both("city"), F.contains(city_a, city_b) | F.contains(city_b, city_a) | alike(city_a, city_b)),
    }
    v = {c: F.col(c) for c in first}
    conflict = (v["num"] == -1) | ((v["street"] == -1) & (v["num"] != 1)) | ((v["city"] == -1) & ~((v["street"] == 1) & (v["num"] == 1)))
    address = ((v["street"] == 1) & (v["num"] >= 0) & (v["city"] >= 0)) | ((v["num"] == 1) & ((v["city"] == 1) | (v["street"] == 1)))
    reached = ((v["city"] == 1) & _contact()) | ((v["phone"] == 1) & (v["city"] >= 0))
    spot = (
        F.when(v["place"] >= 1, F.when((v["num"] >= 0) | _contact(), 1).otherwise(-1)).when((v["place"] == -1) | conflict, -1)
        .when(address | reached, 1).otherwise(0).cast("int")
    )
    return pairs.select(*keep, *(c.alias(n) for n, c in first.items())).withColumn("spot", spot)


def _contact() -> Column:
    return (F.col("phone") == 1) | (F.col("web") == 1) | (F.col("mail") == 1) | (F.col("fb") == 1)


def one_business() -> Column:
    """From the votes: one name and kind at one spot."""
    named_ = (F.col("name") >= 1) | ((F.col("name") == 0) & _contact() & (F.col("num") >= 0))
    return named_ & (F.col("kind") >= 0) & (F.col("spot") == 1)
