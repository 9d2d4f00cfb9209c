"""Mapping free-entered values to a canonical list: token repair and soft TF-IDF.

1. Values are folded and cut into tokens; each distinct token is repaired against the tokens of the
   list. Two tokens match within one edit (insertion, deletion, substitution, swap of neighbours), found by
   an equi join on their forms with one character left out. Common abbreviations are spelt out, letters
   typed apart are joined, and an entry's name written as one word is a token of the list as well.
2. A candidate entry is found through its rarest token, which any acceptable match must contain, so frequent
   tokens ("san", "city") join nothing.
3. The soft TF-IDF of value and entry is the sum of idf² times similarity over the entry's tokens found in
   the value, over the sum of idf². At least ``ACCEPT`` must be reached.
4. Of several entries the best by score wins, then the one whose province agrees, then the one that stands
   last in the value, then the smallest id. Values whose best entries share one name in several provinces,
   none of which agrees, and values without an entry, are reported as unmatched ('none').

Every distinct value is mapped once and joined back, so repeated values cost nothing and a value that a
third of all rows hold is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.functions.text import fold, one_deleted, one_edit
from talaan.runtime import cut

ACCEPT = 0.8
# Abbreviations at the head of place names.
SHORT = {"sto": ["santo"], "sta": ["santa"], "pto": ["puerto"], "s": ["san", "santo", "santa"], "n": ["new"], "u": ["upper"], "st": ["san", "santo", "santa"]}


def value_tokens(c: Column) -> Column:
    """Tokens of a typed value in order: no digits, and single letters in a row joined to one token."""
    lost = F.regexp_replace(c, r"(?<=\p{L})[?\x{FFFD}](?=\p{L})", "n")  # a letter lost in an encoding, mostly ñ
    x = F.trim(F.regexp_replace(fold(lost), r"[^\p{L}]+", " "))
    apart = F.regexp_replace(x, r"(?<=(^| )\p{L}) (?=\p{L}( |$))", "")
    return F.filter(F.split(apart, " "), lambda t: t != "")


def lexicon(reference: DataFrame, key: str, names: list[str], province: str | None) -> DataFrame:
    """One row per form of an entry: its tokens with their idf² weight, its anchor (rarest token) and province."""
    prov = F.concat_ws(" ", value_tokens(F.col(province))) if province else F.lit(None).cast("string")
    each = reference.select(F.col(key).cast("string").alias("entry"), prov.alias("prov"), F.explode(F.array(*(F.col(n).cast("string") for n in names))).alias("name"))
    each = each.select("entry", "prov", value_tokens(F.col("name")).alias("toks")).where(F.size("toks") > 0)
    joined = each.where(F.size("toks") > 1).select("entry", "prov", F.array(F.array_join("toks", "")).alias("toks"), F.array_join("toks", " ").alias("label"))
    forms = each.select("entry", "prov", "toks", F.array_join("toks", " ").alias("label")).unionByName(joined).distinct()
    n = forms.select("label").distinct().count() + 1
    idf = forms.select("label", F.explode("toks").alias("tok")).distinct().groupBy("tok").agg(F.pow(F.log(F.lit(n) / F.count("*")) + 0.1, 2).alias("w"))
    t = forms.select("*", F.explode("toks").alias("tok")).join(idf, "tok")
    return t.groupBy("entry", "prov", "label", "toks").agg(
        F.max(F.struct("w", "tok"))["tok"].alias("anchor"), F.collect_list(F.struct("tok", "w")).alias("weights"), F.sum("w").alias("total")
    )


def repairs(values: DataFrame, lex: DataFrame) -> DataFrame:
    """``typed``, ``tok``, ``sim``: each distinct typed token with the list tokens it may mean."""
    typed = values.select(F.explode("toks_").alias("typed")).distinct()
    known = lex.select(F.explode("toks").alias("tok")).distinct()
    a = typed.where(F.length("typed") >= 2).select("typed", F.explode(one_deleted(F.col("typed"))).alias("k"))
    b = known.where(F.length("tok") >= 3).select("tok", F.explode(one_deleted(F.col("tok"))).alias("k"))
    close = a.join(b, "k").where(one_edit(F.col("typed"), F.col("tok"))).select("typed", "tok").distinct()
    sim = F.when(F.col("typed") == F.col("tok"), 1.0).otherwise(1 - 1 / F.greatest(F.length("typed"), F.length("tok")))
    exact = typed.join(known, F.col("typed") == F.col("tok")).where(F.length("tok") < 3).select("typed", "tok")
    short = F.create_map(*(x for k, v in SHORT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    spelt = typed.select("typed", F.explode(short[F.col("typed")]).alias("tok"), F.lit(0.95).alias("sim"))
    return close.unionByName(exact).select("typed", "tok", sim.alias("sim")).unionByName(spelt)


def canonical(values: DataFrame, value: str, hint: str | None, reference: DataFrame, key: str, names: list[str], province: str | None) -> DataFrame:
    """``value``, ``hint``, ``entry``, ``score`` of each distinct value (and hint): entry is 'none' where nothing is meant.

    Null values are left out; blank ones are unmatched. An empty list leaves all unmatched.
    """
    h = F.concat_ws(" ", value_tokens(F.coalesce(F.col(hint), F.lit("")))) if hint else F.lit("")
    v = values.select(F.col(value).alias("v_"), h.alias("h_")).where("v_ is not null").distinct()
    v = cut(v.withColumn("toks_", value_tokens(F.col("v_"))))
    lex = cut(lexicon(reference, key, names, province))
    fixed = cut(repairs(v, lex))
    at = v.select("v_", "h_", "toks_", F.posexplode("toks_").alias("at", "typed"))
    found = at.join(fixed, "typed")
    best = found.groupBy("v_", "h_", "toks_").agg(F.collect_set(F.struct("tok", "sim", "at")).alias("found"))
    hit = best.select("*", F.explode(F.array_distinct(F.transform("found", lambda x: x["tok"]))).alias("anchor")).join(lex, "anchor")

    def sim(tok: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter("found", lambda x: x["tok"] == tok), lambda x: x["sim"])), F.lit(0.0))

    score = F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x["w"] * sim(x["tok"])) / F.col("total")
    last = F.array_max(F.transform(F.filter("found", lambda x: x["tok"] == F.col("anchor")), lambda x: x["at"]))
    text = F.concat(F.lit(" "), F.array_join("toks_", " "), F.lit(" "))
    agrees = F.coalesce((F.col("prov") == F.col("h_")) | F.contains(text, F.concat(F.lit(" "), F.col("prov"), F.lit(" "))), F.lit(False)).cast("int")
    ranked = hit.select("v_", "h_", "entry", "label", F.round(score, 6).alias("score"), agrees.alias("agrees"), last.alias("last")).where(F.col("score") >= ACCEPT)
    ranked = ranked.groupBy("v_", "h_", "entry", "label").agg(F.max("score").alias("score"), F.max("agrees").alias("agrees"), F.max("last").alias("last"))
    order = W.partitionBy("v_", "h_").orderBy(F.desc("score"), F.desc("agrees"), F.desc("last"), "entry")
    name = W.partitionBy("v_", "h_", "label", "agrees")
    top = ranked.withColumn("twins", F.count("*").over(name)).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1")
    top = top.select("v_", "h_", F.when((F.col("twins") > 1) & (F.col("agrees") == 0), "none").otherwise(F.col("entry")).alias("entry"), "score")
    return v.select("v_", "h_").join(top, ["v_", "h_"], "left").select(
        F.col("v_").alias("value"), F.col("h_").alias("hint"), F.coalesce("entry", F.lit("none")).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def city_cases(raw: DataFrame, leads: DataFrame, cities: DataFrame) -> DataFrame:
    """``row_key``, ``value``, ``hint``: the rows whose city isn't exactly one entry of the list."""

    def once(c: str) -> DataFrame:
        return cities.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(F.col(c).alias("value"))

    r = raw.select(F.col("record_id").cast("string").alias("row_key"), F.col("city").alias("value"), F.col("province").alias("hint"))
    r = r.where(F.length(F.regexp_replace("value", r"[\s\p{Z}\p{C}]+", "")) > 0).join(once("city_name"), "value", "left_anti")
    k = leads.select(F.col("lead_id").alias("row_key"), F.col("city_key").alias("value"), F.col("province").alias("hint")).where("value is not null")
    k = k.join(once("city_key"), "value", "left_anti")
    return r.unionByName(k.select(*r.columns)).distinct()


def map_cities(raw: DataFrame, leads: DataFrame, cities: DataFrame) -> DataFrame:
    """``row_key``, ``value``, ``entry``, ``score`` of each case."""
    cases = city_cases(raw, leads, cities).withColumn("h_", F.concat_ws(" ", value_tokens(F.coalesce("hint", F.lit("")))))
    mapped = canonical(cases, "value", "hint", cities, "city_id", ["city_name", "former_name"], "province")
    m = mapped.select(F.col("value").alias("v_"), F.col("hint").alias("mh_"), "entry", "score")
    return cases.join(m, (F.col("value") == F.col("v_")) & (F.col("h_") == F.col("mh_"))).select("row_key", "value", "entry", "score")
