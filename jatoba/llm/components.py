"""Connected components of an edge table, without gathering links or components anywhere.

Each round, every vertex hooks onto the least vertex among itself and its neighbours (a map-side
combined minimum), pointers are halved until they are flat, and the edges are rewritten to their ends'
roots; edges inside a root vanish.  Rounds are logarithmic in practice, and each ends in a written
table, so a lost executor repeats a part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least reachable id of every end of ``edges`` (a, b), of any one type with an order."""
    pairs = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels: DataFrame | None = None
    while True:
        both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
        parent = stash(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("p")))
        while True:  # p <- p(p) until flat; paths go downwards, so their lengths halve
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = stash(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            discard(parent)
            flat = not jumped.filter("moved").take(1)
            parent = jumped.select("v", "p")
            parent._stash = jumped._stash
            if flat:
                break
        old = labels
        if labels is None:
            labels = stash(parent.select(F.col("v").alias("id"), F.col("p").alias("component")))
        else:
            up = parent.select(F.col("v").alias("component"), F.col("p").alias("__p"))
            labels = stash(labels.join(up, "component", "left").select("id", F.coalesce("__p", "component").alias("component")))
        root_a = parent.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        root_b = parent.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        left = stash(pairs.join(root_a, "a").join(root_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(old, parent, pairs)
        pairs = left
        if not pairs.take(1):
            discard(pairs)
            return labels
