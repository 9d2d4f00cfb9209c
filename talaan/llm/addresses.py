"""Same postal address written differently: a self-built gazetteer and beam search.

1. **Reading.** Each record, one line or parts, is cut into tokens. Units, floors, landmarks, cross streets,
   barangays and countries go. What remains may be read in several ways: which words are the city, which the
   street, which number is the building's and which a postcode. A beam keeps the ``BEAM`` best readings.
2. **Gazetteer.** The best readings of all records give the street spellings of each locality with their
   counts. Spellings one edit apart are clustered around the one that is far more frequent; its name is the
   street's identifier. A
   misspelling that is alone in its locality is held against the other localities. Only spellings are shuffled, once each, never all pairs of a locality.
3. **Resolution.** Every reading is scored again with the gazetteer's support for its street in its city, and
   each record keeps the best. A street without its type takes the only type that the gazetteer has for
   it with this number, else in this city; a city name of several provinces takes the one whose
   gazetteer has the street.
4. **Join** on city, street, type, extension and number (with its letter, or block and lot). Unit, floor,
   suburb and landmarks don't matter.

A record without a building number, street or city is in no pair. Repeated address ids count once.

Joins are by key on both sides (``_apart``). Spark judges a table by its packed size on disk; unpacked, with the forms of each
spelling, the gazetteer is hundreds of times that, and must not be gathered on the driver to be sent to every task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.functions.text import one_deleted, one_edit
from talaan.runtime import cut

BEAM = 8
RARER = 5  # a misspelling is at least so many times rarer, over all localities, than the spelling it means
MAX_LOCALITIES = 200_000  # the list of localities goes to every task; more than this is refused

# Street types and their spellings, ordinals, and what surrounds an address.
TYPES = {
    "street": "street", "st": "street", "str": "street", "avenue": "avenue", "ave": "avenue", "av": "avenue", "boulevard": "boulevard", "blvd": "boulevard", "boul": "boulevard",
    "road": "road", "rd": "road", "lane": "lane", "ln": "lane", "drive": "drive", "dr": "drive",
}
BEFORE = {"calle": "street", "kalye": "street"}
EXTENSION = {"ext", "extn", "extension"}
UNITS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
ORDINAL = {w: i + 1 for i, w in enumerate(UNITS)} | {f"{t}{s}": 20 + 10 * k + i + 1 for k, t in enumerate(("twenty", "thirty")) for i, s in enumerate(UNITS[:9])} | {"thirtieth": 30}
_PLACE = r"(?:public market|bus terminal|gas station|town hall|covered court|old chapel|[a-z]+)"
_DROP = [
    r"\b(?:beside|near|in front of|back of|at the back of|behind|across|across from|opposite) (?:the )?" + _PLACE,
    r"\b(?:cor|corner)\.? (?:of )?(?:[a-z]+ ){1,2}(?:" + "|".join(TYPES) + r")\b\.?",
    r"\b(?:unit|suite|ste|rm|room|stall|space|door|booth)\b\.? ?#?\d+[a-z]?\b", r"\b\d+(?:st|nd|rd|th) (?:floor|flr|fl)\b\.?", r"\b(?:\d+|g|gf)/f\b\.?", r"\bground floor\b", r"\bphilippines\b",
]
_SUBURB = re.compile(r"\b(?:brgy|barangay|bgy|brg)\b\.? ?[a-z]+")
_DROP = [re.compile(p) for p in _DROP]
_LOT = [
    (re.compile(r"\bbl(?:oc)?k\.? ?(\d+)[, ]*lo?t\.? ?(\d+)\b"), 1, 2), (re.compile(r"\blo?t\.? ?(\d+)[, ]*bl(?:oc)?k\.? ?(\d+)\b"), 2, 1), (re.compile(r"\bb(\d+) l(\d+)\b"), 1, 2),
]
_NUMBER = re.compile(r"(?:(?P<mark>\b(?:no|nr|num)\b\.? ?|#) ?)?(?<![\w/§])(?P<n>\d{1,6})(?:(?: ?- ?| )?(?P<l>[a-z]))?(?![\w/])\.?")


def fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKD", (text or "").lower())
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip()


def one_apart(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


class Reader:
    """Readings of an address; knows the localities' names."""

    def __init__(self, cities: list[tuple]):
        self.city: dict[str, list[tuple[str, str, str]]] = {}
        self.provinces = set()
        for cid, name, former, prov, code in cities:
            for n in (name, former):
                if n:
                    self.city.setdefault(fold(n), []).append((cid, fold(prov), (code or "").strip()))
            if prov:
                self.provinces.add(fold(prov))
        self.by_cut: dict[str, set[str]] = {}
        for n in self.city:
            for i in range(len(n)):
                self.by_cut.setdefault(n[:i] + n[i + 1 :], set()).add(n)

    def _name(self, text: str) -> list[tuple[str, float]]:
        """City names that ``text`` may be."""
        if text in self.city:
            return [(text, 3.0)]
        if len(text) < 5:
            return []
        near = set(self.by_cut.get(text, ()))
        for i in range(len(text)):
            c = text[:i] + text[i + 1 :]
            near |= self.by_cut.get(c, set())
            if c in self.city:
                near.add(c)
        return [(n, 1.5) for n in near if one_apart(n, text)]

    def _localities(self, toks: list[str], whole: bool) -> list[tuple[str, float, int, int]]:
        out = []
        for i in range(len(toks)):
            for n in (3, 2, 1):
                if i + n <= len(toks) and "|" not in toks[i : i + n]:
                    for name, score in self._name(" ".join(toks[i : i + n])):
                        beside = (i >= 2 and toks[i - 2 : i] == ["city", "of"]) + (i + n < len(toks) and toks[i + n] == "city")
                        alone = (i == 0 or toks[i - 1] in ("|", "of")) and (i + n == len(toks) or toks[i + n] in ("|", "city"))
                        out.append((name, score + 0.5 * n + beside + 0.5 * alone, i, i + n))
        out.sort(key=lambda x: -x[1])
        return out[:3] if not whole else out[:1]

    def read(self, address, housenumber, street, suburb, city, province, postcode) -> list[tuple]:
        """(score, city id, number, street, type or '', extension) of the best readings."""
        parts = not (address or "").strip()
        line = fold(", ".join(x for x in (housenumber, street) if x) if parts else address)
        line = re.sub(r"[;,]| - ", " , ", re.sub(r"\s+-\s+", " , ", line))
        for p in _DROP:
            line = p.sub(" , ", line)
        line = _SUBURB.sub(" , ", line)
        lots = []
        for p, b, l in _LOT:
            line = p.sub(lambda m: (lots.append(f"b{int(m[b])}l{int(m[l])}"), " §0 ")[1], line)
        numbers: list[tuple[str, bool, str]] = [(x, True, "") for x in lots[:1]]

        def number(m):
            if re.match(r"(st|nd|rd|th)\b", line[m.end() :]):
                return m[0]
            numbers.append((m["n"].lstrip("0") + (m["l"] or ""), bool(m["mark"]), m["n"]))
            return f" §{len(numbers) - 1} "

        line = _NUMBER.sub(number, line)
        line = re.sub(r"\b(twenty|thirty)[- ](" + "|".join(UNITS[:9]) + r")\b", r"\1\2", line)
        toks = re.findall(r"§\d+|,|[^\W_]+", line.replace("'", ""))
        toks = ["|" if t == "," else t for t in toks]
        province_at: set[int] = set()
        prov = fold(province)
        for i in range(len(toks)):
            for n in (3, 2, 1):
                if " ".join(toks[i : i + n]) in self.provinces and i not in province_at:
                    prov = prov or " ".join(toks[i : i + n])
                    province_at |= set(range(i, i + n))
        codes = {n[2] for n in numbers if len(n[2]) == 4 and not n[1]} | ({postcode.strip()} if postcode else set())
        if parts:
            bare = re.sub(r"\bcity of\b|\bcity\b|[^a-z ]", " ", fold(city))
            places = [(n, s, -1, -1) for n, s in self._name(" ".join(bare.split()))]
        else:
            places = self._localities(toks, False)
        streets = []
        for i, t in enumerate(toks):
            if t in TYPES and i and toks[i - 1] not in ("|",) and toks[i - 1][0] != "§":
                ext = i + 1 < len(toks) and toks[i + 1] in EXTENSION
                o = self._ordinal(toks[i - 1])
                for n in (1,) if o else (2, 1, 3):
                    span = toks[i - n : i] if i >= n else []
                    if span and not any(x == "|" or x[0] == "§" for x in span):
                        streets.append((o or " ".join(span), TYPES[t], ext, i - n, i + 1 + ext, {1: 0.0 if not o else 2.5, 2: 2.0, 3: -0.5}[n]))
            elif t in BEFORE and i + 1 < len(toks):
                for n in (2, 1):
                    span = toks[i + 1 : i + 1 + n]
                    if len(span) == n and not any(x == "|" or x[0] == "§" for x in span):
                        ext = i + 1 + n < len(toks) and toks[i + 1 + n] in EXTENSION
                        streets.append((" ".join(span), BEFORE[t], ext, i, i + 1 + n + ext, 0.5 + n))
        if not streets:
            for i in range(len(toks)):
                for n in (2, 1):
                    span = toks[i : i + n]
                    if len(span) == n and not any(x == "|" or x[0] == "§" or x in ("city", "of") for x in span):
                        beside = (i > 0 and toks[i - 1][0] == "§") or (i + n < len(toks) and toks[i + n][0] == "§")
                        near = beside or (i > 1 and toks[i - 1] == "|" and toks[i - 2][0] == "§")
                        ext = i + n < len(toks) and toks[i + n] in EXTENSION
                        streets.append((" ".join(span), "", ext, i, i + n + ext, (0.8 if beside else 0.5 if near or parts else 0.0) + 0.4 * n))
        out = []
        for name, kind, ext, a, b, s1 in streets:
            if any(i in province_at for i in range(a, b)):
                continue
            for place, s2, c, d in places:
                if c < b and a < d:
                    continue
                for cid, cprov, code in self.city[place]:
                    s3 = (1.0 if prov and prov == cprov else -1.0 if prov else 0.0) + (1.0 if code and code in codes else 0.0)
                    best = [("", 0.0)]
                    for k, (text, mark, digits) in enumerate(numbers):
                        at = toks.index(f"§{k}") if f"§{k}" in toks else -9
                        gap = min(abs(at - a + 1), abs(at - b)) if at >= 0 else 9
                        s4 = 1.0 + mark + (1.0 if gap == 0 else 0.6 if gap == 1 else 0.0) + (0.2 if 0 <= at < a else 0) - (3.0 if digits == code and not mark and len(digits) == 4 and gap > 0 else 1.0 if digits == code and not mark and at > b else 0)
                        best.append((text, s4))
                    best.sort(key=lambda x: -x[1])
                    for text, s4 in best[:2]:
                        out.append((s1 + s2 + s3 + s4, cid, text, name, kind, bool(ext)))
        out.sort(key=lambda x: (-x[0], x[1:]))
        return out[:BEAM]

    @staticmethod
    def _ordinal(tok: str) -> str | None:
        if m := re.fullmatch(r"(\d+)(st|nd|rd|th)", tok):
            return f"#{int(m[1])}"
        return f"#{ORDINAL[tok]}" if tok in ORDINAL else None


READING = "address_id bigint, score double, city_id string, number string, spelling string, kind string, ext boolean"
PARTS = ["address", "housenumber", "street", "suburb", "city", "province", "postcode"]


def readings(records: DataFrame, cities: DataFrame) -> DataFrame:
    rows = cities.select("city_id", "city_name", "former_name", "province", "postcode").limit(MAX_LOCALITIES + 1).collect()
    if len(rows) > MAX_LOCALITIES:
        raise ValueError("too many localities for one task")
    names = [tuple(r) for r in rows]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                found = reader.read(*(x if isinstance(x, str) else None for x in row[1:]))
                out += [(row[0], *r) for r in found]
            yield pd.DataFrame(out, columns=["address_id", "score", "city_id", "number", "spelling", "kind", "ext"], dtype=object)

    return records.select(F.col("address_id").cast("bigint").alias("address_id"), *PARTS).where("address_id is not null").mapInPandas(go, READING)


def _apart(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever its size is taken for."""
    return df.hint("merge")


def gazetteer(reads: DataFrame) -> DataFrame:
    """``city_id``, ``spelling``, ``street_id``, ``support``: the spellings of each locality and the street they mean."""
    best = W.partitionBy("address_id").orderBy(F.desc("score"), "city_id", "spelling", "number")
    top = reads.withColumn("r_", F.row_number().over(best)).where("r_ = 1 and spelling <> ''")
    own = top.groupBy("city_id", "spelling").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "").alias("typed"))
    all_ = own.groupBy("spelling").agg(F.sum("n").alias("everywhere"))
    own = cut(own.join(_apart(all_), "spelling"))
    word = own.where(~F.col("spelling").startswith("#"))
    here = word.select("city_id", "spelling", "n", "everywhere", F.explode(one_deleted(F.col("spelling"))).alias("k"))
    a, b = here.toDF("city_id", "spelling", "n", "ev", "k"), here.toDF("city_id", "s2", "n2", "ev2", "k")
    rarer = (F.col("spelling") != F.col("s2")) & (F.col("ev2") >= RARER * F.col("ev"))
    near = a.join(_apart(b), ["city_id", "k"]).where(rarer & (F.col("n2") >= F.col("n")) & one_edit(F.col("spelling"), F.col("s2")))
    to = near.groupBy("city_id", "spelling").agg(F.max(F.struct("ev2", "n2", "s2"))["s2"].alias("local"))
    # a misspelling that is alone in its locality is held against all localities' spellings
    each = word.select("spelling", "everywhere").distinct().select("spelling", "everywhere", F.explode(one_deleted(F.col("spelling"))).alias("k"))
    c, d = each.toDF("spelling", "ev", "k"), each.toDF("s2", "ev2", "k")
    far = c.join(_apart(d), "k").where(rarer & one_edit(F.col("spelling"), F.col("s2"))).groupBy("spelling").agg(F.max(F.struct("ev2", "s2"))["s2"].alias("other"))
    to = own.join(_apart(to), ["city_id", "spelling"], "left").join(_apart(far), "spelling", "left")
    to = to.select("city_id", "spelling", F.coalesce("local", "other").alias("street_id")).where("street_id is not null")
    return own.join(_apart(to), ["city_id", "spelling"], "left").select(
        "city_id", "spelling", F.coalesce("street_id", "spelling").alias("street_id"), "n", "typed", "everywhere",
        (F.log1p("typed") * 0.3 + F.log1p("everywhere") * 0.15).alias("support"),
    )


def resolved(records: DataFrame, cities: DataFrame) -> DataFrame:
    """``address_id``, ``city_id``, ``street_id``, ``kind``, ``ext``, ``number``, ``score`` of each record that can be read."""
    reads = cut(readings(records, cities))
    names = cut(gazetteer(reads))
    best = W.partitionBy("address_id").orderBy(F.desc("total"), "city_id", "street_id", "number", "kind")
    scored = reads.join(_apart(names.select("city_id", "spelling", "street_id", "support")), ["city_id", "spelling"], "left")
    scored = scored.withColumn("street_id", F.coalesce("street_id", "spelling")).withColumn("total", F.col("score") + F.coalesce("support", F.lit(0.0)))
    one = cut(scored.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_", "spelling", "score", "support"))
    typed = one.where("kind <> ''")
    here = typed.groupBy("city_id", "street_id").agg(F.collect_set("kind").alias("kinds")).select("city_id", "street_id", F.when(F.size("kinds") == 1, F.col("kinds")[0]).alias("only_kind"))
    door = typed.groupBy("city_id", "street_id", "number", "ext").agg(F.collect_set("kind").alias("kinds"))
    door = door.select("city_id", "street_id", "number", "ext", F.when(F.size("kinds") == 1, F.col("kinds")[0]).alias("door_kind"))
    bare = one.where("kind = ''").join(_apart(door), ["city_id", "street_id", "number", "ext"], "left").join(_apart(here), ["city_id", "street_id"], "left")
    bare = bare.withColumn("kind", F.coalesce("door_kind", "only_kind", F.lit(""))).select(*one.columns)
    return typed.unionByName(bare).withColumnRenamed("total", "score")


def same_addresses(records: DataFrame, cities: DataFrame) -> DataFrame:
    """``address_id_a``, ``address_id_b``: each two records of the same building, smaller id first."""
    r = cut(resolved(records, cities).where("number <> ''").select("address_id", F.xxhash64("city_id", "street_id", "kind", "ext", "number").alias("door")))
    a, b = r.select("door", F.col("address_id").alias("address_id_a")), r.select("door", F.col("address_id").alias("address_id_b"))
    return a.join(_apart(b), "door").where("address_id_a < address_id_b").select("address_id_a", "address_id_b").distinct()
