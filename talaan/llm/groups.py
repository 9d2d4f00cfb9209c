"""Consolidating pairwise matches into groups: deterministic Borůvka hooking on DataFrames.

A round over the undirected edges between components:

1. Every component selects its smallest outgoing edge, by (smaller end, larger end). This is one
   aggregation with partial sums before the shuffle, so a hub with a third of all edges is reduced first.
2. Each component points to the other end of its edge. Edges are ordered without ties, so the only
   cycles are two components that chose the same edge; the smaller of the two becomes the root.
3. Pointer doubling collapses the trees until every component points to its root.
4. Edges are renamed to roots, loops dropped and repeats removed.

Every component with an edge joins another, so their number at least halves and the rounds are at most
log2 of the largest group. Nothing is collected but counts. Each round's state is a table in the shared
folder. The smallest member names the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talaan.runtime import cut

DOUBLINGS = 2


def _hook(edges: DataFrame) -> DataFrame:
    """``c``, ``p``: each component and where its smallest edge leads; a mutual choice keeps the smaller as root."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))).alias("e")).select("e.*")
    to = both.groupBy("c").agg(F.min("o").alias("p"))  # the smallest edge leads to the smallest other end: edges to smaller ends come before all others
    back = to.select(F.col("c").alias("bc"), F.col("p").alias("bp"))
    mutual = (F.col("bp") == F.col("c")) & (F.col("c") < F.col("p"))
    return to.join(back, F.col("p") == F.col("bc"), "left").select("c", F.when(mutual, F.col("c")).otherwise(F.col("p")).alias("p"))


def _double(tree: DataFrame) -> DataFrame:
    up = tree.select(F.col("c").alias("uc"), F.col("p").alias("up"))
    return tree.join(up, F.col("p") == F.col("uc"), "left").select("c", F.coalesce("up", "p").alias("p"))


def _collapse(tree: DataFrame) -> DataFrame:
    """Pointer doubling until every component points to its root; trees that are flat from the start need none."""
    tree = cut(tree)
    while True:
        up = tree.select(F.col("c").alias("uc"), F.col("p").alias("up"))
        if tree.where("c != p").join(up, F.col("p") == F.col("uc")).where("up != p").isEmpty():
            return tree
        nxt = tree
        for _ in range(DOUBLINGS):
            nxt = _double(nxt)
        tree = cut(nxt, after=[tree])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``group_id`` of every node with an edge to another node; group_id is the smallest node.

    Repeats and both orders count once. A null side or a pair of a node with itself links nothing.
    Other columns are ignored; an empty table gives an empty result.
    """
    u, v = F.col(a), F.col(b)
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), u.isNotNull() & v.isNotNull() & (u != v)).toDF("u", "v", "ok")
    e = cut(e.where("ok").select("u", "v").distinct())
    trees = []
    while not e.isEmpty():
        tree = _collapse(_hook(e))
        trees.append(tree)
        ru = tree.select(F.col("c").alias("u"), F.col("p").alias("ru"))
        rv = tree.select(F.col("c").alias("v"), F.col("p").alias("rv"))
        moved = e.join(ru, "u").join(rv, "v").where("ru != rv")
        e = cut(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), after=[e])
    if not trees:
        return e.select(F.col("u").alias("node"), F.col("u").alias("group_id"))
    roots = trees[-1]
    for tree in reversed(trees[:-1]):
        later = roots.select(F.col("c").alias("p"), F.col("p").alias("r"))
        roots = tree.join(later, "p", "left").select("c", F.coalesce("r", "p").alias("p"))
    roots = cut(roots) if len(trees) > 1 else roots
    least = roots.groupBy("p").agg(F.min("c").alias("group_id"))
    return roots.join(least, "p").select(F.col("c").alias("node"), "group_id")


def lead_key(c: Column) -> Column:
    """A lead id as leads writes it, whatever its case and surrounding white space; blank is null."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", ""))
    return F.nullif(F.regexp_replace(bare, "^l-", "L-"), F.lit(""))


def lead_groups(pairs: DataFrame, a: str = "lead_id_a", b: str = "lead_id_b") -> DataFrame:
    """``lead_id``, ``group_id`` of each lead id that a pair links to another id."""
    e = pairs.select(lead_key(F.col(a)).alias("a"), lead_key(F.col(b)).alias("b"))
    return components(e, "a", "b").select(F.col("node").alias("lead_id"), "group_id")
