"""Keys of names, streets and cities; similarity of names; addresses. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talaan.functions import dims
from talaan.functions.text import fold, strip, tokens

def name_key(name: Column) -> Column:
    """Folded tokens without legal forms at the end; the first token always stays."""
    joined = F.array_join(tokens(name), " ")
    return F.regexp_replace(joined, f"( ({'|'.join(dims.LEGAL)}))+$", "")


def street_key(street: Column) -> Column:
    """Folded tokens without units, abbreviations spelt out; null if nothing is left."""
    words = F.create_map(*(F.lit(x) for kv in dims.STREET_WORDS.items() for x in kv))
    toks = tokens(F.regexp_replace(fold(street), dims.UNIT, " "))
    return F.nullif(F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(words, t), t)), " "), F.lit(""))


def city_key(city: Column) -> Column:
    """Folded tokens without "City of", "Municipality of" and a trailing "City"."""
    bare = F.regexp_replace(F.trim(fold(city)), r"^(?:city|municipality) of\s+|\s+city$", "")
    return F.nullif(F.array_join(tokens(bare), " "), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words of two keys."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _present(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def similar(a: Column, b: Column) -> Column:
    """Equal, one within the other, or half of the words shared."""
    return F.coalesce(_present(a, b) & (F.contains(a, b) | F.contains(b, a) | (jaccard(a, b) >= 0.5)), F.lit(False))


def close(a: Column, b: Column) -> Column:
    """Equal but for spaces, or 0.6 of the words shared; containment isn't enough."""
    return F.coalesce(_present(a, b) & ((F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))) | (jaccard(a, b) >= 0.6)), F.lit(False))


def address_line(*parts: Column) -> Column:
    """The distinct non-blank parts in order, joined by commas; null if there is none."""
    kept = F.array_distinct(F.filter(F.transform(F.array(*parts), strip), lambda p: p.isNotNull() & (p != "")))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


_HOUSE = r"^\s*(\d+[A-Za-z]?(?:-[A-Za-z0-9]+)?),?\s+(\S.*)$"


def house_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, _HOUSE, 1), F.lit(""))


def house_street(line: Column) -> Column:
    return F.when(line.rlike(_HOUSE), F.regexp_extract(line, _HOUSE, 2)).otherwise(line)


def first_present(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(strip(v), F.lit("")) for v in values))


def slug(text: Column, longest: int = 60) -> Column:
    """A file name: lower case, anything but word characters and hyphens is a hyphen."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\-]+", "-"), "^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("export")), 1, longest)


def tab_title(category: Column, area: Column) -> Column:
    """A sheet's name: forbidden signs are spaces, at most 100 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.concat_ws(" - ", category, area), r"[\[\]*?/\\:']", " "), r"\s+", " ")), 1, 100)
