"""Greedy clustering and greedy degree caps as rounds of local decisions.

A greedy pass goes through items in one order; an item's turn depends only on
items that it can meet.  So in every round all items go whose turn comes before
that of all undecided items within reach: the outcome is that of the sequential
pass, and the number of rounds is that of the longest chain of dependence.
Ties of the order go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.tables import written


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim"))


def greedy(items: DataFrame, pairs: DataFrame, near: float = 0.45, least: int = 2) -> DataFrame:
    """(id, cluster) of the items in clusters; ``items`` has (id, weight), ``pairs`` (a, b, sim).

    From the heaviest item on, an item not yet taken takes all such items at
    least ``near``; fewer than ``least`` in all take nobody.  A cluster is
    named by its centre.
    """
    edges = written(_both(pairs.where(F.col("sim") >= near)).select("u", "v"))
    turn = F.struct(F.col("weight").alias("w"), (-F.col("id")).alias("i"))
    state = written(items.select("id", turn.alias("turn"), F.lit(False).alias("done"), F.lit(None).cast(items.schema["id"].dataType).alias("cluster")))
    while True:
        waiting = state.where("NOT done")
        if waiting.isEmpty():
            return state.where("cluster IS NOT NULL").select("id", "cluster")
        # the first turn still to come among the neighbours, then among theirs
        one = edges.join(waiting.select(F.col("id").alias("v"), "turn"), "v").groupBy("u").agg(F.max("turn").alias("m")).withColumnRenamed("u", "id")
        reach = state.join(one, "id", "left").select("id", F.greatest("m", F.when(~F.col("done"), F.col("turn"))).alias("m"))
        two = edges.join(reach.select(F.col("id").alias("v"), "m"), "v").groupBy("u").agg(F.max("m").alias("m2")).withColumnRenamed("u", "id")
        first = F.col("m2").isNull() | (F.col("turn") >= F.col("m2"))
        go = written(waiting.join(two, "id", "left").where(first).select("id", F.col("cluster").isNull().alias("free")))
        free = state.where("cluster IS NULL").select(F.col("id").alias("v"))
        taken = go.where("free").select(F.col("id").alias("u")).join(edges, "u").join(free, "v").select("u", "v")
        big = taken.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select("u")
        named = taken.join(big, "u").select(F.col("v").alias("id"), F.col("u").alias("c")).unionByName(big.select(F.col("u").alias("id"), F.col("u").alias("c")))
        state = written(
            state.join(named, "id", "left").join(go.select("id", F.lit(True).alias("gone")), "id", "left")
            .select("id", "turn", (F.col("done") | F.coalesce("gone", F.lit(False))).alias("done"), F.coalesce("cluster", "c").alias("cluster"))
        )


def merged(clusters: DataFrame, pairs: DataFrame, near: float = 0.45) -> DataFrame:
    """(id, cluster): clusters with any pair of members at least ``near`` are one, named by the least name."""
    from granary.operators.graph import connected

    side = lambda x: clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}"))
    links = pairs.where(F.col("sim") >= near).join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    labels = connected(links).withColumnRenamed("node", "cluster")
    return clusters.join(labels, "cluster", "left").select("id", F.coalesce("label", "cluster").alias("cluster"))


def attached(items: DataFrame, clusters: DataFrame, pairs: DataFrame, near: float = 0.34) -> DataFrame:
    """(id, cluster) with the single items that come ``near`` a member of a cluster, in order of id.

    An item joins the cluster of its most similar member, of equals the later
    one (by name); those that joined before it count as members.
    """
    edges = written(_both(pairs.where(F.col("sim") >= near)))
    state = written(items.select("id").join(clusters, "id", "left").select("id", "cluster", F.col("cluster").isNotNull().alias("done")))
    while True:
        waiting = state.where("NOT done").select("id")
        if waiting.isEmpty():
            return state.where("cluster IS NOT NULL").select("id", "cluster")
        earlier = edges.join(waiting.withColumnRenamed("id", "v"), "v").where("v < u").select(F.col("u").alias("id")).distinct()
        go = written(waiting.join(earlier, "id", "left_anti"))
        members = state.where("cluster IS NOT NULL").select(F.col("id").alias("v"), F.col("cluster").alias("c"))
        best = go.withColumnRenamed("id", "u").join(edges, "u").join(members, "v").groupBy(F.col("u").alias("id")).agg(F.max(F.struct("sim", "c")).alias("b"))
        state = written(
            state.join(best, "id", "left").join(go.select("id", F.lit(True).alias("gone")), "id", "left")
            .select("id", F.coalesce("cluster", "b.c").alias("cluster"), (F.col("done") | F.coalesce("gone", F.lit(False))).alias("done"))
        )


def degree_capped(edges: DataFrame, most: int) -> DataFrame:
    """The edges (a, b, n, w) that a pass from the strongest on keeps: all but those with both ends full.

    A node's first ``most`` edges find it short of ``most`` and stay, and with them it is full.
    So the pass keeps what is among the first ``most`` of either end: no rounds, each end ranks its own.
    """
    ends = edges.select("a", "b", "n", "w", F.explode(F.array("a", "b")).alias("x"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), F.desc("w"), "a", "b"))
    return ends.withColumn("r", place).where(F.col("r") <= most).select("a", "b", "n", "w").distinct()
