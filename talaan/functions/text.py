"""Folding and tokens of names, as JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are one plain character with marks, or a wide or styled form of it: by Unicode's compatibility decomposition.
_BARE = {}
for _c in map(chr, (*range(0xA0, 0x2100), *range(0xFF01, 0xFF5F))):
    _d = "".join(x for x in unicodedata.normalize("NFKD", _c) if not unicodedata.combining(x)).lower()
    if len(_d) == 1 and _d != _c and not unicodedata.combining(_c):
        _BARE[_c] = _d
ACCENTED, PLAIN = "".join(_BARE), "".join(_BARE.values())
# UTF-8 read as Latin-1.
MISREAD = [("ã±", "n"), ("ã©", "e"), ("ã¡", "a"), ("ã³", "o"), ("ãº", "u"), ("ã­", "i")]


# Combining marks and invisible characters: translate() drops what has no counterpart.
DROPPED = "".join(map(chr, (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF)))


def fold(c: Column) -> Column:
    """Lower case without accents; invisible characters go."""
    x = F.lower(c)
    read = x
    for a, b in MISREAD:
        read = F.replace(read, F.lit(a), F.lit(b))
    plain = F.octet_length(c) == F.char_length(c)  # ASCII needs no more
    return F.when(plain, x).otherwise(F.translate(F.when(F.contains(x, F.lit("ã")), read).otherwise(x), ACCENTED + DROPPED, PLAIN))


def tokens(c: Column) -> Column:
    """Folded words; "&" is "and", everything but letters and digits separates."""
    x = F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(x), " "), lambda t: t != "")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def one_deleted(c: Column) -> Column:
    """The text and its forms with one character left out: two texts one edit apart share one of them."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), cut))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    d = F.levenshtein(a, b, 2)
    n = F.length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return F.when(d.between(0, 1), True).when((d == 2) & (n == F.length(b)), swapped).otherwise(False)
