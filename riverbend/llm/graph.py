"""Connected components by contraction, for edges of any number.

In each round every node follows the neighbour of lowest priority, if that is lower than its own; edges are then
rewritten to what their ends follow and edges inside a node fall away. Priorities are hashes, so paths shrink as
fast as stars and the rounds grow with the logarithm of the nodes. Each round is one aggregation with map-side
combining and two joins; a hub's rows are never gathered in one task, since the joins are ones that Spark may
split. Rounds are cut into the shared folder, so a lost executor costs no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """From (a long, b long) to (node, root): every node with an edge to another, and one node for its whole component.

    Null ends, loops and repeated edges are ignored."""
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    pairs = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = None
    while pairs.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        low = pairs.groupBy("a").agg(F.min(rank("b")).alias("low"))
        follows = cut(low.select(F.col("a").alias("node"), F.least(F.col("low"), rank("a")).getField("n").alias("root")))
        ahead = follows.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        follows = cut(follows.join(ahead, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        if found is None:
            found = follows
        else:
            onward = follows.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = cut(found.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        left = follows.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = follows.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        pairs = pairs.join(left, "a").select("_a", "b")
        pairs = pairs.join(right, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        pairs = cut(pairs.distinct())
    return found if found is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
