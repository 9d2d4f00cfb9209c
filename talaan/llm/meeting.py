"""Rows that meet on a key, as a self-join over one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles of key rows. A pair needs a row that LEADS (a record at its own place, or one without a place) on at least one side;
# FOLLOWS is a record's copy elsewhere. OLD rows meet rows of the batch only; OLD_FOLLOWS meets rows that lead.
LEADS, FOLLOWS, OLD, OLD_FOLLOWS = range(4)
_VALID = sum(1 << (a * 4 + b) for a, b in ((LEADS, LEADS), (LEADS, FOLLOWS), (OLD, LEADS), (OLD, FOLLOWS), (OLD_FOLLOWS, LEADS)))


def met(rows: DataFrame, also: str = "true") -> DataFrame:
    """``id_a``, ``id_b``: each two ids that share a key ``k`` in roles ``t`` that may meet, smaller first, each pair once.

    ``also`` is a condition over the sides ``a`` and ``b``. Roles are tested by one expression over both sides, so that no part of it
    is pushed below the exchange, which is then made once and read twice.
    """
    a, b = rows.alias("a"), rows.alias("b")
    ok = f"(shiftright({_VALID}, a.t * 4 + b.t) & 1) * cast(not (a.t + b.t = {LEADS} and a.i >= b.i) as int) = 1"
    pairs = a.join(b, F.expr(f"a.k = b.k and {ok} and {also} and a.i <> b.i"))
    return pairs.select(F.least("a.i", "b.i").alias("id_a"), F.greatest("a.i", "b.i").alias("id_b")).distinct()


def key(tag: str, *parts: Column, bits: int = 48, known: Column | None = None) -> Column:
    """A hash of ``parts``, null if one of them is, or unless ``known``. Two keys that share a hash make a candidate more, no link less."""
    if known is None:
        known = parts[0].isNotNull()
        for p in parts[1:]:
            known = known & p.isNotNull()
    return F.when(known, F.xxhash64(F.lit(tag), *parts).bitwiseAND(F.lit((1 << bits) - 1)))
