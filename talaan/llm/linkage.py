"""Matching entities across sources without keys: label-model linkage.

1. **Candidates.** Listings with positions meet in the grid cells their neighbourhoods touch, with the first, last or
   middle letters of their names' cores, a phone, e-mail, website or page. Two slips can hide both ends of a core, so the letters
   after the third meet too, as far as a slip may shift them; cores of up to six letters meet by their forms with a
   letter left out; two words meet in either order. Two slips in a core of six to eight letters, or a core within another
   without its ends, need a contact. Listings without a position meet any listing by core or its ends together with a
   phone, street, e-mail, website or city. All keys are composite, so a website of a chain, a switchboard or a city with a
   third of all rows makes no group of its own. All key rows are shuffled once, to the key, and joined with themselves.
   Of pairs that meet, those whose names resemble each other at all go on.
2. **Votes.** Eleven matching functions (``business.votes``) speak about each candidate: name, kind, contacts, bands of
   distance, street, number, city, and one that reads position, number and contacts together.
3. **Label model.** A generative model of the votes is fitted without labels by expectation-maximisation. It has a
   table per function and class, and each function also depends on the one it is most correlated with (a
   maximum spanning tree of conditional mutual information), so websites, e-mails
   and pages that agree together don't count as independent evidence. A vote never counts against what it says,
   and about one business no function is taken to be wrong in more than ``WRONG`` of its answers. Only the counts of vote patterns (at most the
   product of the functions' answers) reach the driver. The posterior of the pattern is the confidence.
4. **Decision.** A pair is accepted by its posterior alone, ``ACCEPT`` or more. Accepted pairs are joined to businesses,
   and each two listings of a business from different sources come out.

Which words of a name say what a business is, and not which, is learned from the table (``business.learn``). A listing is
known by a number given when the table of listings is written, so no two listings can share one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.llm import business
from talaan.llm.groups import components
from talaan.llm.meeting import FOLLOWS, LEADS, key, met
from talaan.operators.near import touched_cells
from talaan.runtime import cut

CELL_M = 1_500.0
ACCEPT = 0.5
VOTES = business.VOTES
LOWEST, LEVELS = -1, 4  # answers of the functions: -1, 0, 1, 2
# What a function answers about other businesses and about one, before any data: it is right more often than wrong.
PRIOR = (np.array([0.5, 0.4, 0.05, 0.05]), np.array([0.1, 0.4, 0.25, 0.25]))
AGAINST = 4.0  # at the start, so many votes for a match make up for one against it
WRONG = 0.05  # of the answers that a function gives about one business, so many are wrong at most


class LabelModel:
    """Two classes, votes from ``LOWEST`` up, tree-shaped dependence among the votes in each class."""

    def __init__(self, rounds: int = 60, smooth: float = 8.0, against: float = 1.0, wrong: float = 1.0, relearn: bool = True):
        self.rounds, self.smooth, self.against, self.wrong, self.relearn = rounds, smooth, against, wrong, relearn

    def _pairs(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Mutual information of each two columns under weights."""
        k = x.shape[1]
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                joint = np.full((LEVELS, LEVELS), 1e-9)
                np.add.at(joint, (x[:, i], x[:, j]), w)
                joint /= joint.sum()
                out[i, j] = out[j, i] = float((joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))).sum())
        return out

    def _tree(self, info: np.ndarray) -> list[int]:
        """The parent of each column in a maximum spanning tree; -1 at the root."""
        k = len(info)
        parent, best, inside = [-1] * k, info[0].copy(), {0}
        link = [0] * k
        while len(inside) < k:
            j = max((c for c in range(k) if c not in inside), key=lambda c: (best[c], -c))
            parent[j] = link[j]
            inside.add(j)
            for c in range(k):
                if c not in inside and info[j, c] > best[c]:
                    best[c], link[c] = info[j, c], j
        return parent

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The posterior of a match for each pattern seen ``counts`` times."""
        x, n = patterns.astype(int) - LOWEST, counts.astype(float)
        post = 1 / (1 + np.exp(-((patterns > 0).sum(axis=1) - self.against * (patterns < 0).sum(axis=1) - 0.5)))
        k = x.shape[1]
        for r in range(self.rounds):
            weights = [n * (1 - post), n * post]
            if r == 0 or self.relearn:
                self.parent = self._tree(sum(self._pairs(x, w) * w.sum() for w in weights) / n.sum())
            odds = np.full(len(x), np.log((weights[1].sum() + 1) / (weights[0].sum() + 1)))
            for j in range(k):
                p = self.parent[j]
                given = x[:, p] if p >= 0 else np.zeros(len(x), int)
                logs = []
                for w, prior in zip(weights, PRIOR):
                    alone = np.bincount(x[:, j], w, LEVELS) + self.smooth * prior
                    table = np.tile(self.smooth * alone / alone.sum(), (LEVELS, 1))  # rows seen little fall back on the vote alone
                    np.add.at(table, (given, x[:, j]), w)
                    table /= table.sum(axis=1, keepdims=True)
                    if w is weights[1]:  # about one business a function is wrong at most so often, if it answers
                        table[:, 0] = np.minimum(table[:, 0], self.wrong * (table[:, 0] + table[:, 2:].sum(axis=1)))
                    logs.append(np.log(table)[given, x[:, j]])
                gain = logs[1] - logs[0]
                odds += np.where(patterns[:, j] < 0, np.minimum(gain, 0), np.where(patterns[:, j] > 0, np.maximum(gain, 0), gain))
            new = 1 / (1 + np.exp(np.clip(-odds, -500, 500)))
            if np.abs(new - post).max() < 1e-6:
                post = new
                break
            post = new
        return post


SHORT = 6  # letters of a core within one slip of a core of five


def with_ends(records: DataFrame) -> DataFrame:
    """``records`` with their ``core`` and what keys read of it more than once: ``head`` and ``tail``, its first and last three letters."""
    return records.withColumn("core", business.core()).withColumns({"head": F.substring("core", 1, 3), "tail": F.substring("core", -3, 3)})


ENDS = [("<", "head"), (">", "tail")]


def _each(c: str, first: int) -> list[Column]:
    return [F.get(c, F.lit(i)) for i in range(first)]


def _rest(c: str, first: int, make) -> Column:
    """Keys of the elements of ``c`` beyond the ``first``; few have any."""
    more = F.transform(F.slice(c, first + 1, F.greatest(F.size(c) - first, F.lit(1))), make)
    return F.when(F.size(c) > first, more).otherwise(F.array().cast("array<bigint>"))


def _name_parts() -> dict[str, Column]:
    """What the keys of a listing in a cell read of its name, beside its ends: once for all cells."""
    core, name = F.col("core"), F.col("name")
    n, one, two = F.length(core), F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    return {
        "n": n, "mid4": F.when(n >= 7, F.substring(core, 4, 3)), "mid5": F.when(n >= 7, F.substring(core, 5, 3)),  # one slip before shifts by one at most
        "pair": F.when(F.length(name) == n + 1, F.concat(F.least(one, two), F.greatest(one, two))),
    }


def _placed_keys() -> list[Column]:
    """Arrays of keys of a listing in a cell; unused ones are null."""
    core, cell, n = F.col("core"), F.col("cell"), F.col("n")
    keys = [key(t, cell, F.col(p), known=F.col(p).isNotNull()) for t, p in (*ENDS, ("+", "mid4"), ("+", "mid5"), ("w", "web"), ("f", "fb"), ("=", "pair"))]
    keys.append(key("-", cell, core, known=n.between(1, SHORT)))
    keys += [key("-", cell, F.concat(F.substring(core, 1, i - 1), F.substring(core, i + 1, SHORT)), known=n.between(i, SHORT)) for i in range(1, SHORT + 1)]
    keys += [key(t, cell, p, known=p.isNotNull()) for t, p in (*(("t", p) for p in _each("phones", 2)), *(("m", e) for e in _each("mails", 1)))]
    return [F.array(*keys), _rest("phones", 2, lambda p: key("t", cell, p)), _rest("mails", 1, lambda e: key("m", cell, e))]


def loose_keys() -> list[Column]:
    """Arrays of keys of a listing (with_ends()) that needn't have a position: composite of a name part and another attribute."""
    core, head, tail = F.col("core"), F.col("head"), F.col("tail")
    keys = [key("t" + t, F.col(part), p) for t, part in ENDS for p in _each("phones", 2)] + [key("s" + t, F.col(part), F.col("street")) for t, part in ENDS]
    keys += [key("s", core, F.substring("street", 1, 4), known=core.isNotNull() & F.col("street").isNotNull()), key("c", core, F.col("city")), key("wc", F.col("web"), F.col("city"))]
    keys += [key("m<", head, e) for e in _each("mails", 1)]
    return [F.array(*keys), _rest("phones", 2, lambda p: key("t<", head, p)), _rest("phones", 2, lambda p: key("t>", tail, p)), _rest("mails", 1, lambda e: key("m<", head, e))]


def candidates(listings: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: pairs of listings of different sources worth a look, each once, smaller id first.

    A key row leads if the listing is in its own cell, or has no position.
    """
    slim = with_ends(listings.select("id", F.xxhash64("src").alias("s"), "name", "phones", "mails", "web", "fb", "street", "city", "lat", "lon")).withColumns(_name_parts())
    # arrays are made in a projection of their own: inside explode they would be interpreted. A plain explode would make them twice, once to filter by their size
    none = F.array(F.lit(None).cast("bigint"))  # the last "cell" of a listing, for its keys without a cell
    cells = F.when(F.col("lat").isNull(), none).otherwise(F.concat(touched_cells(F.col("lat"), F.col("lon"), business.NEAR_M, CELL_M), none))
    here = slim.withColumn("cells", cells).drop("name", "lon").select("*", F.posexplode_outer("cells").alias("at", "cell")).drop("cells")
    leads = F.when(F.col("cell").isNull(), F.col("lat").isNull()).otherwise(F.col("at") == 0)
    keys = F.when(F.col("cell").isNull(), F.concat(*loose_keys())).otherwise(F.concat(*_placed_keys()))
    made = here.select("id", "s", F.when(leads, LEADS).otherwise(FOLLOWS).alias("t"), keys.alias("ks"))
    keyed = made.select(F.col("id").alias("i"), "s", "t", F.explode_outer("ks").alias("k")).where("k is not null")
    return met(keyed, "a.s <> b.s")


def voted(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose names resemble each other, with the votes. Both joins read one exchange of the listings."""
    one = listings.select("id", F.struct(*business.COMPARED).alias("l"))
    x = pairs.join(one.select(F.col("id").alias("id_a"), F.col("l").alias("a")), "id_a").join(one.select(F.col("id").alias("id_b"), F.col("l").alias("b")), "id_b")
    v = business.votes(x, "a", "b", ["id_a", "id_b"]).where("name >= 0")
    return v.select("id_a", "id_b", *(F.col(c).cast("tinyint").alias(c) for c in VOTES), _pattern().alias("pattern"))


def _pattern() -> Column:
    """The votes as one number."""
    return sum(((F.col(c) - LOWEST) * LEVELS**i for i, c in enumerate(VOTES)), F.lit(0)).cast("int")


def confident(pairs: DataFrame) -> tuple[DataFrame, LabelModel]:
    """``pairs`` with ``confidence``, and the fitted model."""
    if "pattern" not in pairs.columns:
        pairs = pairs.withColumn("pattern", _pattern())
    seen = pairs.groupBy("pattern").count().collect()  # at most the product of the functions' answers
    model = LabelModel(against=AGAINST, wrong=WRONG, relearn=False)
    if not seen:
        return pairs.withColumn("confidence", F.lit(0.0)).drop("pattern"), model
    codes = np.array(sorted(r["pattern"] for r in seen))
    counts = {r["pattern"]: r["count"] for r in seen}
    x = np.stack([codes // LEVELS**i % LEVELS + LOWEST for i in range(len(VOTES))], axis=1)
    post = model.fit(x, np.array([counts[c] for c in codes]))
    spark = pairs.sparkSession
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "pattern int, confidence double")
    return pairs.join(F.broadcast(table), "pattern").drop("pattern"), model


def listings_of(raw: DataFrame) -> DataFrame:
    """The first record of each listing, parsed, with a dense ``id``: one shuffle by source_ref."""
    rows = business.from_raw(raw)
    first = rows.withColumn("n_", F.row_number().over(W.partitionBy("key").orderBy("record_id"))).where("n_ = 1").drop("n_", "record_id")
    written = cut(first.withColumn("id", F.monotonically_increasing_id()))
    return business.named(written, business.learn(written))


def judged(listings: DataFrame) -> DataFrame:
    """All candidate pairs of listings by id, with votes, confidence and decision."""
    pairs = cut(candidates(listings))  # the key rows' exchange is given back before the listings are shuffled to the pairs
    scored, _ = confident(cut(voted(listings, pairs), after=[pairs]))
    return scored.withColumn("accepted", F.col("confidence") >= ACCEPT)


def links(raw: DataFrame) -> DataFrame:
    """``ref_a``, ``ref_b``, votes, ``confidence`` and ``accepted`` of every candidate pair of two sources.

    Rows without source_ref or name are no listings; of a repeated listing the first record counts; missing
    attributes abstain; a null source is one source. An empty table gives an empty result.
    """
    listings = listings_of(raw)
    key = listings.select("id", "key")
    x = judged(listings).join(key.select(F.col("id").alias("id_a"), F.col("key").alias("ka")), "id_a").join(key.select(F.col("id").alias("id_b"), F.col("key").alias("kb")), "id_b")
    return x.select(F.least("ka", "kb").alias("ref_a"), F.greatest("ka", "kb").alias("ref_b"), *VOTES, "confidence", "accepted")


def same_business(raw: DataFrame) -> DataFrame:
    """``ref_a``, ``ref_b``: each two listings of different sources that are one business at one place."""
    listings = listings_of(raw)
    member = components(judged(listings).where("accepted").select("id_a", "id_b"), "id_a", "id_b").withColumnRenamed("node", "id")
    m = member.join(listings.select("id", "key", "src"), "id").select("group_id", "key", "src")
    a = m.select("group_id", F.col("key").alias("ref_a"), F.col("src").alias("sa"))
    b = m.select("group_id", F.col("key").alias("ref_b"), F.col("src").alias("sb"))
    return a.join(b, "group_id").where("ref_a < ref_b and sa <> sb").select("ref_a", "ref_b")
