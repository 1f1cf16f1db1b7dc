"""Connected components by local contraction: in every round nodes get random ranks (a hash of node and
round), each node moves to the least rank within two steps of it, and edges are rewritten to where their
ends went; edges that became loops or copies go. Ranks are drawn anew each round and have nothing to do
with the ids, so a chain shrinks by half or more a round however its ids run, a star in one round, and no
number of rounds is set. All of it stays in DataFrames, minima are pre-aggregated before the shuffle, and
rounds are cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node reachable.
    Loops and nulls in ``edges`` are dropped; without edges the result is empty."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = written(e, "edges")
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    turn = 0
    while not e.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("v")), F.struct(F.col("b").alias("k"), F.col("a").alias("v")))).alias("x")).select("x.*")
        near = both.groupBy("k").agg(F.min_by("v", rank("v")).alias("v")).select(F.col("k").alias("v"), F.when(rank("k") <= rank("v"), F.col("k")).otherwise(F.col("v")).alias("w"))
        # a neighbour's choice ranks at or below the node itself, so the least of those is the least of both steps
        far = both.join(near, "v").groupBy("k").agg(F.min_by("w", rank("w")).alias("w"))
        far = written(far, "moves")
        labels = written(labels.join(far, labels["root"] == far["k"], "left").select("node", F.coalesce("w", "root").alias("root")), "labels")
        m1, m2 = far.select(F.col("k").alias("k1"), F.col("w").alias("w1")), far.select(F.col("k").alias("k2"), F.col("w").alias("w2"))
        e = e.join(m1, e["a"] == m1["k1"]).join(m2, F.col("b") == m2["k2"])
        e = written(e.select(F.least("w1", "w2").alias("a"), F.greatest("w1", "w2").alias("b")).where("a < b").distinct(), "edges")
    least = labels.groupBy(F.col("root").alias("r")).agg(F.min("node").alias("least"))
    return written(labels.join(least, F.col("root") == F.col("r")).select("node", F.col("least").alias("root")), "components")
