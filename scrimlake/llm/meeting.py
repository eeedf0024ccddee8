"""Links between nodes that meet at keys, without holding all nodes of a key against each other.

In star rounds each node is held against one that the round picks for each key, which joins groups of like nodes, of any size, in a
few rounds of as many rows as there are meetings. Then all pairs that meet and aren't connected yet are held together: the nodes of a
key outside of its largest component against all others there. As links within a component change nothing, the
components are those of all pairs, at keys of any size.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch
from scrimlake.llm.components import connected_components


def met_components(meets: DataFrame, likely: Callable[[DataFrame, bool], DataFrame], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, stars: int = 2, linked: DataFrame | None = None, crowd: int | None = None) -> DataFrame:
    """(node, root) of the nodes that have a link.

    meets: k, node and columns about the node, a row for each key of a node. likely: from (a, about_a, b, about_b), a row for each shared key,
    about being a struct of those columns, and whether those are all keys that the pairs share, as in star rounds they aren't, the distinct pairs (a, b), a < b, that may be linked. verify: the pairs with linked, where those that aren't may be missing. Star rounds end after
    `stars`, once the pairs left are few, once they link few nodes, or once few nodes are left to hold against large components. linked: links (a, b) that are known before, a row for each node a but the least of its component, b. crowd: if given, meets has a column first, and
    in the last round keys with more nodes than that outside of their largest component count for the nodes of which they are first only. No meets or links: no rows.
    """
    spark = meets.sparkSession
    kind = meets.schema["node"].dataType.simpleString()
    flags = [] if crowd is None else ["first"]
    meets = meets.select("k", "node", *flags, F.struct(*[c for c in meets.columns if c not in ("k", "node", *flags)]).alias("about"))
    tried = spark.createDataFrame([], f"a {kind}, b {kind}, linked boolean")
    roots = spark.createDataFrame([], f"node {kind}, root {kind}")
    if linked is not None:
        tried = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("linked"))
        roots = linked.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(linked.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    before, now = 0, meets
    for turn in range(stars + 1):
        labelled = now.withColumn("root", F.col("node"))
        if turn or linked is not None:
            labelled = now.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = labelled.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m"))
        parts = parts.groupBy("k").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = scratch.save(parts.select("k", "main", "most", "of"), f"parts{turn}")
        effort = parts.agg(F.sum(F.col("of").cast("double") * (F.col("of") - F.col("most"))).alias("pairs"), F.sum(F.col("most").cast("double") * (F.col("of") - F.col("most"))).alias("outside"), F.sum("of").alias("rows")).first()
        if not effort["rows"]:
            return roots
        if turn or linked is not None:  # before any link every key that nodes meet at counts
            labelled = scratch.save(labelled.join(parts.select("k"), "k", "left_semi"), f"now{turn}")
            scratch.drop(f"now{turn - 1}")
        now = labelled
        links = tried.where("linked").count()
        last = turn == stars or effort["pairs"] <= 4 * effort["rows"] or turn > 0 and ((links - before) * 2000 < effort["rows"] or effort["outside"] <= 4 * effort["rows"])
        before = links
        if last:
            held = now.join(parts, "k").where(F.col("first") | (F.col("of") - F.col("most") <= crowd) if flags else F.lit(True))
            few = held.where("root <> main").select("k", F.col("node").alias("a"), F.col("root").alias("ra"), "main", F.col("about").alias("about_a"))
            met = few.join(held.select("k", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("about").alias("about_b")), "k").where("ra <> rb and (rb = main or a < b)")
        else:
            pick = now.groupBy("k").agg(F.min_by(F.struct("node", "root", "about"), F.xxhash64("node", "k", F.lit(turn))).alias("p"))
            pick = pick.select("k", F.col("p.root").alias("main"), F.col("p.node").alias("b"), F.col("p.about").alias("about_b"))
            met = now.join(pick, "k").where("root <> main").select(F.col("node").alias("a"), F.col("about").alias("about_a"), "b", "about_b")
        pairs = likely(met.select("a", "about_a", "b", "about_b"), last).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{turn}")
        tried = scratch.save(tried.unionByName(verify(pairs)), f"tried{turn}")
        roots = connected_components(tried.where("linked").select("a", "b"), scratch, f"round{turn}-", None if last else 2)  # labels in between only save comparisons
        scratch.drop(f"parts{turn}", f"pairs{turn}", f"tried{turn - 1}")
        if last:
            scratch.drop(f"now{turn}")
            return roots
