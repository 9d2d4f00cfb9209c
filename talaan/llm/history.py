"""Deduplicating new batches against all history: content-defined chunking.

1. A lead is written as lines of bytes (phones, e-mails, website, page, name, the ends of the name, street and number, city). A
   rolling hash over ``WINDOW`` bytes sets the chunk boundaries, and starts afresh on each line, so a slip in one word
   changes the chunks around it and no others. A chunk's id is 48 bits of a hash of its bytes above 16 bits of its length; the
   longest chunk has ``MAX`` bytes.
2. The persistent chunk-to-record table holds the telling chunks of every accepted lead (those of its name and contacts), each
   in the grid cell of the lead's position, in files by zone (a square of a degree). A batch reads the zones it touches, and there meets
   what shares a chunk in a cell. Street and city count for coverage but look nothing up, so a city's name gathers nobody.
3. Leads without a position, and their partners, are looked up by pairs of chunks (a name end with a phone, street or
   e-mail, a name or website with a city), in a second table in files by hash.
4. Coverage decides: the bytes of the chunks that two leads share, and ``PLACE`` bytes if they are near each other, must make up
   ``COVER`` of the smaller lead's bytes. An exact check of name, kind and place follows. Of the history only the records
   that share a telling chunk with the batch are read for this, from the zones they are in.
5. Each lead that repeats a business is paired with the first accepted lead of it, which the folder keeps for every lead that
   isn't the first itself. Then the batch's chunks are appended.

Repeated rows of a lead id count once, and a lead that is in the history already is not taken again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talaan.llm import business, linkage
from talaan.llm.groups import components
from talaan.llm.meeting import FOLLOWS, LEADS, OLD, OLD_FOLLOWS, key, met
from talaan.operators.near import touched_cells
from talaan.runtime import cut, drop, writing

WINDOW = 3
MASK = 7  # a boundary where the rolling hash has these bits 0: chunks of 8 bytes and MIN on average
MIN, MAX = 5, 4096
COVER, PLACE = 0.25, 16
CELL_M, ZONE, SLOTS = 3_000.0, 1.0, 16  # cells in metres, zones in degrees
GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, 256, dtype=np.uint64)
SIZE_BITS = 16
TABLES = {
    "records": "id bigint, key string, at bigint, chunks array<bigint>, others array<bigint>, name string, kind string, phones array<int>, web int, mails array<int>, fb int, num string, "
    "street string, city string, lat double, lon double, zone int",
    "keys": "key string", "near": "k bigint, i bigint, q int, zone int", "far": "k bigint, i bigint, q int, t int, slot int", "firsts": "id bigint, first struct<at: bigint, key: string, id: bigint>",
}


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``; lines end chunks, and the rolling hash doesn't see past a line's start."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    g = GEAR[b]
    newline = b == 10
    h = g.copy()
    fresh = np.cumsum(newline) - newline
    for k in range(1, WINDOW):
        same = np.zeros(len(b), bool)
        same[k:] = fresh[k:] == fresh[:-k]
        shifted = np.zeros(len(b), np.uint64)
        shifted[k:] = g[:-k] << np.uint64(k)
        h += np.where(same, shifted, 0)
    ends = np.flatnonzero(((h >> np.uint64(9)) & np.uint64(MASK)) == 0) + 1
    return np.union1d(np.union1d(ends, np.flatnonzero(newline) + 1), [len(b)])


def batch_chunks(texts: list[str]) -> list[list[int]]:
    """Distinct chunk ids of each text. The boundaries of all texts are found at once: a text is lines, so it starts afresh."""
    from xxhash import xxh64_intdigest

    data = [t.encode("utf-8", "replace") for t in texts]
    whole = b"\n".join(data) + b"\n"
    ends = boundaries(whole).tolist()
    out, k, start = [], 0, 0
    for d in data:
        stop = start + len(d) + 1
        found: dict[int, None] = {}
        at = start
        while k < len(ends) and ends[k] <= stop:
            end = ends[k]
            k += 1
            if end - at < MIN and whole[end - 1] != 10:
                continue
            piece = whole[at:end]
            if piece[-1] == 10:
                piece = piece[:-1]
            at = end
            for i in range(0, len(piece), MAX):
                part = piece[i : i + MAX]
                found[(xxh64_intdigest(part) >> (SIZE_BITS + 1)) << SIZE_BITS | len(part)] = None
        out.append(list(found))
        start = stop
    return out


def chunks(text: str) -> list[int]:
    return batch_chunks([text])[0]


def hexes(c: Column) -> Column:
    """The numbers of an array in hexadecimal; most have one at most, which needs no lambda."""
    return F.when(F.size(c) > 1, F.array_join(F.transform(c, F.hex), "\n")).otherwise(F.coalesce(F.hex(F.get(c, F.lit(0))), F.lit("")))


def telling_lines() -> Column:
    """The lines that look entries up: contacts, the name's core, and its ends."""
    core = F.nullif(business.core(), F.lit(""))
    ends = [F.concat(F.lit("<"), F.substring(core, 1, 3)), F.concat(F.lit(">"), F.substring(core, -3, 3))]
    return F.concat_ws("\n", hexes("phones"), hexes("mails"), F.hex("web"), F.concat(F.hex("fb"), F.lit("@")), core, *ends)


def place_lines() -> Column:
    return F.concat_ws("\n", F.concat_ws(" ", "street", "num"), F.col("city"))


def chunked(leads: DataFrame) -> DataFrame:
    """``leads`` with their ``chunks`` that look entries up and the ``others``, which only count."""

    @F.pandas_udf("chunks array<bigint>, others array<bigint>")
    def ids(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            yield pd.DataFrame({"chunks": batch_chunks(list(a)), "others": batch_chunks(list(b))}, dtype=object)

    return leads.withColumn("c_", ids(telling_lines(), place_lines())).select("*", "c_.chunks", "c_.others").drop("c_")


def size_of(ids: Column) -> Column:
    """Bytes in an array of chunk ids."""
    mask = F.lit((1 << SIZE_BITS) - 1).cast("bigint")
    return F.aggregate(ids, F.lit(0), lambda a, x: a + x.bitwiseAND(mask).cast("int"))


def _zone(lat: Column, lon: Column) -> Column:
    """The square of a degree of a position, as a number; -1 without one."""
    return F.coalesce((F.floor((lat + 90) / ZONE) * int(360 / ZONE) + F.pmod(F.floor((lon + 180) / ZONE), F.lit(int(360 / ZONE)))).cast("int"), F.lit(-1))


def near_entries(records: DataFrame) -> DataFrame:
    """``k``, ``i``, ``t``: the telling chunks of leads with positions by cell; they lead in their own (``at`` 0), follow in those they touch."""
    r = records.where("lat is not null").withColumn("cells", touched_cells(F.col("lat"), F.col("lon"), business.NEAR_M, CELL_M))
    cells = r.select("id", "zone", business.kind_code(), "chunks", F.posexplode_outer("cells").alias("at", "cell"))  # a plain explode would make the cells twice
    each = cells.select("id", "zone", "q", "at", "cell", F.explode_outer("chunks").alias("c")).where("c is not null")
    return each.select(key("n", F.col("cell"), F.col("c")).alias("k"), F.col("id").alias("i"), "q", F.when(F.col("at") == 0, LEADS).otherwise(FOLLOWS).alias("t"), "at", "zone")


def far_entries(records: DataFrame) -> DataFrame:
    """``k``, ``i``, ``t``: pairs of chunks, for look-ups by and of leads without position; those lead."""
    r = linkage.with_ends(records).select("id", business.kind_code(), F.when(F.col("lat").isNull(), LEADS).otherwise(FOLLOWS).alias("t"), F.concat(*linkage.loose_keys()).alias("ks"))
    return r.select("id", "q", "t", F.explode_outer("ks").alias("k")).where("k is not null").select("k", F.col("id").alias("i"), "q", "t")


def repeats(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``id_a``, ``id_b`` of ``pairs`` that share enough bytes and then pass the exact check."""
    packed = records.select("id", F.struct("chunks", "others", *business.COMPARED).alias("l"))
    x = pairs.join(packed.select(F.col("id").alias("id_a"), F.col("l").alias("x")), "id_a").join(packed.select(F.col("id").alias("id_b"), F.col("l").alias("y")), "id_b")
    v = business.votes(x, "x", "y", ["id_a", "id_b", "x", "y"])
    place = F.when(F.col("place") >= 1, PLACE).otherwise(0)
    shared = size_of(F.array_intersect("x.chunks", "y.chunks")) + size_of(F.array_intersect("x.others", "y.others")) + place
    least = F.least(*(size_of(F.col(f"{s}.chunks")) + size_of(F.col(f"{s}.others")) for s in "xy")) + place
    # the votes are cheap and leave few pairs; the bytes are counted for those
    return v.where(business.one_business()).where(shared >= COVER * least).select("id_a", "id_b")


class History:
    """The accepted leads in a folder: records, the two chunk tables, and the first lead of each business.

    ``lexicon`` says which words of a name tell the kind; without one it is learned from the first batch and kept.
    """

    def __init__(self, spark: SparkSession, path: str, lexicon: business.Lexicon | None = None):
        self.spark, self.path, self.lexicon = spark, path, lexicon

    def _batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(str(f.getPath().getName()) for f in fs.listStatus(root)) if fs.exists(root) else []

    def _write(self, df: DataFrame, name: str, batch: str, by: str | None = None) -> None:
        """A batch's part of a table; hot zones are split over tasks."""
        w = (df.hint("rebalance", by) if by else df).write
        with writing(self.spark):
            (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}/{batch}")

    def _read(self, name: str, batches: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{b}") for b in batches]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def add(self, leads: DataFrame, runs: DataFrame) -> DataFrame:
        """Check a batch (of one run or many) and accept it; ``lead_id_a``, ``lead_id_b`` of its repeats and the firsts.

        The order of acceptance is the run's created_at, then lead_id; a lead without a known run comes last.
        A batch is to be later than what is accepted already.
        """
        order = runs.select(F.col("run_id").alias("run"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).groupBy("run").agg(F.min("at").alias("at"))
        before = self._batches()
        batch = f"{len(before):06d}"
        parsed = business.from_leads(leads).join(F.broadcast(order), "run", "left") if self._few(order) else business.from_leads(leads).join(order, "run", "left")
        one = F.row_number().over(W.partitionBy("key").orderBy("at"))  # limits each task's rows before the shuffle
        once = parsed.withColumn("at", F.coalesce("at", F.lit(2**62))).withColumn("n_", one).where("n_ = 1").drop("n_")
        if before or self.lexicon is None:  # else it is read once only
            once = cut(once)
        if self.lexicon is None:
            self.lexicon = self._kept_lexicon(once)
        new = business.named(once, self.lexicon).withColumn("zone", _zone(F.col("lat"), F.col("lon")))
        if before:
            gone = self._read("keys", before).join(new.select("key"), "key", "left_semi")
            new = new.join(gone, "key", "left_anti")
        made = chunked(new).select((F.lit(len(before)).cast("bigint") * (1 << 48) + F.monotonically_increasing_id()).alias("id"), "key", "at", "zone", "chunks", "others", *business.COMPARED)
        self._write(made, "records", batch, "zone")
        drop(once)
        new = self._read("records", [batch])
        self._write(new.select("key"), "keys", batch)
        near, far = near_entries(new), far_entries(new)
        self._write(near.where(F.col("at") == 0).drop("at", "t"), "near", batch, "zone")
        self._write(far.withColumn("slot", F.pmod("k", F.lit(SLOTS)).cast("int")), "far", batch, "slot")
        # what is in the tables is read from them; only the copies in the other cells that a lead touches are made again
        rows = self._read("near", [batch]).select("k", "i", "q", F.lit(LEADS).alias("t")).unionByName(near.where(F.col("at") > 0).select("k", "i", "q", "t"))
        rows = rows.unionByName(self._read("far", [batch]).select("k", "i", "q", "t"))
        if before:
            rows = rows.unionByName(self._old_near(new, before)).unionByName(self._old_far(before))
        pairs = cut(met(rows, business.SAME_KIND))
        everything = new
        if before:
            everything = new.unionByName(self._met_records(pairs, before, len(before)))
        same = cut(repeats(pairs, everything), after=[pairs])
        return self._settle(same, everything.select("id", "key", "at"), before, batch)

    def _few(self, order: DataFrame) -> bool:
        return order.count() <= 100_000

    def _kept_lexicon(self, once: DataFrame) -> business.Lexicon:
        path = f"{self.path}/lexicon"
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return business.Lexicon({r["w"]: r["kind"] for r in self.spark.read.parquet(path).collect()})
        lexicon = business.learn(once)
        self.spark.createDataFrame(sorted(lexicon.kinds.items()), "w string, kind string").coalesce(1).write.parquet(path)
        return lexicon

    def _old_near(self, new: DataFrame, before: list[str]) -> DataFrame:
        """The chunk table's entries in the zones that the batch touches."""
        r = F.array(F.lit(-0.002), F.lit(0.002))
        at = new.where("lat is not null").select("lat", "lon", F.explode(r).alias("dy")).select("lat", "lon", "dy", F.explode(r).alias("dx"))
        wide = F.col("dx") / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
        zones = [x["z"] for x in at.select(_zone(F.col("lat") + F.col("dy"), F.col("lon") + wide).alias("z")).distinct().collect()]  # at most the squares of the grid
        return self._read("near", before).where(F.col("zone").isin(zones)).select("k", "i", "q", F.lit(OLD).alias("t"))

    def _old_far(self, before: list[str]) -> DataFrame:
        return self._read("far", before).select("k", "i", "q", F.when(F.col("t") == LEADS, OLD).otherwise(OLD_FOLLOWS).alias("t"))

    def _met_records(self, pairs: DataFrame, before: list[str], n: int) -> DataFrame:
        """The records of the history that are in a pair."""
        ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).where(F.col("id") < n * (1 << 48)).distinct()
        return cut(self._read("records", before).join(ids, "id", "left_semi"))

    def _settle(self, same: DataFrame, own: DataFrame, before: list[str], batch: str) -> DataFrame:
        """Pair repeats with first leads, and keep the first of each lead that isn't one itself."""
        ids = same.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        member = own.join(ids, "id", "left_semi").withColumn("top", F.struct("at", "key", "id"))
        if before:  # what repeated a lead before stands for that lead's business
            member = member.join(self._firsts(member.select("id"), before), "id", "left").withColumn("top", F.coalesce("first", "top")).drop("first")
        member = cut(member)
        root = member.select("id", F.col("top.id").alias("r"))
        linked = same.join(root.toDF("id_a", "ra"), "id_a").join(root.toDF("id_b", "rb"), "id_b").select("ra", "rb") if before else same.toDF("ra", "rb")
        group = components(linked, "ra", "rb").select(F.col("node").alias("root"), "group_id")
        member = cut(member.withColumn("root", F.col("top.id")).join(group, "root", "left").withColumn("group_id", F.coalesce("group_id", "root")))
        found = member.join(member.groupBy("group_id").agg(F.min("top").alias("first")), "group_id")
        moved = found.where("root <> first.id").select(F.col("root").alias("id"), "first").distinct()
        self._write(moved, "firsts", batch)
        pairs = found.where("key <> first.key").select("id", "key", F.col("first.key").alias("first"))
        pairs = pairs.where(F.col("id") >= len(before) * (1 << 48)) if before else pairs
        return pairs.select(F.least("key", "first").alias("lead_id_a"), F.greatest("key", "first").alias("lead_id_b"))

    def _firsts(self, ids: DataFrame, before: list[str]) -> DataFrame:
        """``id``, ``first`` (at, key and id) of those of ``ids`` that repeat an accepted lead. A first that was joined to an earlier one later is followed."""
        table = self._read("firsts", before)
        known = cut(table.join(ids, "id", "left_semi").groupBy("id").agg(F.min("first").alias("first")))
        later = table.groupBy(F.col("id").alias("f")).agg(F.min("first").alias("earlier"))
        while not known.join(later, F.col("first.id") == F.col("f"), "left_semi").isEmpty():
            known = cut(known.join(later, F.col("first.id") == F.col("f"), "left").select("id", F.coalesce("earlier", "first").alias("first")), after=[known])
        return known
