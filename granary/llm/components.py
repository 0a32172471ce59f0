"""Connected components by alternating large and small stars, all in DataFrames.

Edge cases: repeated edges and both directions of one count once; loops (u = v)
and edges with a null end are left out; a node without an edge to another has no row; no
edges give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(both: DataFrame, keep) -> DataFrame:
    """(v, least neighbour of u) of the pairs (u, v) that ``keep`` allows.

    The least neighbours are a partial aggregate; the join that follows may
    split a node of very many neighbours.
    """
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (columns u, v); the label is the component's least node."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, F.col("v") > F.col("u")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = cut(small, "small")
        ahead = _state(now)
        if ahead == state:
            break
        state = ahead
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
