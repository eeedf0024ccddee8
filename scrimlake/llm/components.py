"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a min per node (combined before its shuffle) and a join back with that one row a node, whose other
side, the edges of a node with very many, Spark may split (adaptive skew join). Each round's edges are a written
table. The number of rounds grows with the logarithm of the longest path.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, step: str = "components", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component. After `rounds`, if given, it may still be
    another node of the component.

    edges: columns a and b of one orderable type; direction, repeats and self-loops don't matter.
    No edges: no rows.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, turn = None, 0
    while True:
        seen = Observation(f"{step}{turn}")
        now = now.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        now = scratch.save(now, f"{step}{turn}")
        if turn > 1:
            scratch.drop(f"{step}{turn - 2}")
        state = (seen.get["n"], seen.get["x"])
        if state == before or state[0] == 0:
            break
        if rounds is not None and turn == rounds:
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")))
            return labels.groupBy("node").agg(F.min("root").alias("root"))
        before, turn = state, turn + 1
        now = _small_star(_large_star(now).distinct()).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
