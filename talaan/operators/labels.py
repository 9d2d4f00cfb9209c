"""Connected groups for the cleaning step: smallest labels spread along edges, with pointer jumps between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.runtime import cut


def spread(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``label``: the smallest node of each node's group. Nodes without edges to others aren't listed."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    lab = cut(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        n = lab.select(F.col("node").alias("v"), "label")
        best = e.join(n, "v").groupBy("u").agg(F.min("label").alias("m"))
        nxt = lab.join(best, lab.node == best.u).select("node", F.least("label", "m").alias("label"))
        up = nxt.select(F.col("node").alias("x"), F.col("label").alias("y"))
        nxt = cut(nxt.join(up, nxt.label == up.x, "left").select("node", F.coalesce("y", "label").alias("label")))
        moved = nxt.join(lab.withColumnRenamed("label", "old"), "node").where("label <> old")
        done = moved.isEmpty()
        lab = nxt
        if done:
            return lab
