"""What changed between two states of a folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.tables import written

#: depth of the folders whose names tell the type of what they hold
CATEGORY_DEPTH = 3
#: files that a folder must gain or lose to be told of (fixed value)
LEAST_CHANGE = 5


def folder_stats(paths: DataFrame) -> DataFrame:
    """(folder, depth, files, subfolders) of every folder on the way to a file of ``paths`` (path, parts joined by "/")."""
    parts = F.split("path", "/")
    own = paths.where("path IS NOT NULL").select(F.slice(parts, 1, F.size(parts) - 1).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    own = written(own.where(F.size("dir") > 0))
    folders = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("dir")), lambda n: F.slice("dir", F.lit(1), n))).alias("dir")).distinct()
    inside = folders.where(F.size("dir") > 1).groupBy(F.slice("dir", F.lit(1), F.size("dir") - 1).alias("dir")).agg(F.count(F.lit(1)).alias("subfolders"))
    rows = folders.join(own, "dir", "left").join(inside, "dir", "left")
    none = F.lit(0).cast("long")
    return rows.select(F.array_join("dir", "/").alias("folder"), F.size("dir").alias("depth"), F.coalesce("files", none).alias("files"), F.coalesce("subfolders", none).alias("subfolders"))


def structure_events(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, folder, was, change) between two tables of ``folder_stats``; ``known`` has the names (name) of known categories.

    Of folders that went and folders that came, those of one parent, depth and
    number of files and subfolders pair off in order of their names as
    ``renamed`` (``was``: the old one).  The others are ``removed`` and ``added``;
    an added folder of the categories' depth with an unknown name is told once
    more as ``unknown_category``.  Of those that stayed, a change of five files or more is ``grew`` or ``shrank``.
    """
    shape = ["parent", "depth", "files", "subfolders"]

    def lone(side: DataFrame, other: DataFrame) -> DataFrame:
        rows = side.join(other.select("folder"), "folder", "left_anti").withColumn("parent", F.regexp_replace("folder", "/?[^/]*$", ""))
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*shape).orderBy("folder")))

    before, after = written(before), written(after)
    gone, fresh = written(lone(before, after)), written(lone(after, before))
    pairs = written(fresh.join(gone.withColumnRenamed("folder", "was"), [*shape, "place"]).select("folder", "was"))
    added = fresh.join(pairs, "folder", "left_anti")
    removed = gone.join(pairs.select(F.col("was").alias("folder")), "folder", "left_anti")
    name = F.regexp_extract("folder", "([^/]*)$", 1)
    strange = added.where(F.col("depth") == CATEGORY_DEPTH).withColumn("name", name).join(known.select("name").distinct(), "name", "left_anti")
    stayed = after.select("folder", F.col("files").alias("now")).join(before.select("folder", "files"), "folder").withColumn("change", F.col("now") - F.col("files"))
    event = lambda rows, kind, was=None, change=None: rows.select(F.lit(kind).alias("kind"), "folder", (was if was is not None else F.lit(None).cast("string")).alias("was"), (change if change is not None else F.lit(0)).cast("long").alias("change"))
    out = event(pairs, "renamed", F.col("was"))
    for rows in (
        event(added, "added", change=F.col("files")), event(strange, "unknown_category", change=F.col("files")), event(removed, "removed", change=-F.col("files")),
        event(stayed.where(F.col("change") >= LEAST_CHANGE), "grew", change=F.col("change")), event(stayed.where(F.col("change") <= -LEAST_CHANGE), "shrank", change=F.col("change")),
    ):
        out = out.unionByName(rows)
    return out
