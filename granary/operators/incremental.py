"""An index that follows snapshots of its sources: versions, a feed of changes, and twins that step in for each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.tables import folder

INDEX = "path string, hash string, status string, twin_of string, state string"


def advanced(index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The next version (path, hash, status, twin_of, state) of ``index`` after a snapshot (path, hash) of all sources.

    Of paths with one content, one is indexed (``ok``) and the others are ``duplicate``s of
    it: the one that was indexed with this content before, else the first by name.
    When it goes or changes, the next one steps in.  States: ``unchanged``, ``new``,
    ``changed``, ``duplicate``, ``promoted`` (a duplicate that is indexed now) and ``deleted``.
    Deleted paths stay as rows without content; a path that comes back is new.
    """
    before = index.select("path", F.col("hash").alias("old_hash"), F.col("status").alias("old"))
    now = snapshot.where("path IS NOT NULL").groupBy("path").agg(F.max("hash").alias("hash")).withColumn("here", F.lit(True))
    both = now.join(before, "path", "full_outer")
    same = F.col("here") & F.col("hash").eqNullSafe(F.col("old_hash")) & (F.col("old") != "deleted")
    both = both.withColumn("same", F.coalesce(same, F.lit(False)))
    # the keeper of each content: who kept it comes before who would
    stays = F.col("same") & (F.col("old") == "ok")
    keepers = both.where("here").groupBy(F.col("hash").alias("kept_hash")).agg(F.min_by("path", F.struct(F.when(stays, 0).otherwise(1), "path")).alias("keeper"))
    found = both.join(keepers, F.col("here") & F.col("hash").eqNullSafe(F.col("kept_hash")), "left")
    kept = F.col("keeper") == F.col("path")
    state = (
        F.when(F.col("here").isNull(), "deleted").when(~kept, "duplicate").when(F.col("same") & (F.col("old") == "ok"), "unchanged")
        .when(F.col("same"), "promoted").when(F.col("old").isNull() | (F.col("old") == "deleted"), "new").otherwise("changed")
    )
    return found.select(
        "path",
        F.when(F.col("here"), F.col("hash")).alias("hash"),
        F.when(F.col("here").isNull(), "deleted").when(kept, "ok").otherwise("duplicate").alias("status"),
        F.when(F.col("here") & ~kept, F.col("keeper")).alias("twin_of"),
        state.alias("state"),
    )


class VersionedIndex:
    """Versions of an index as tables of one folder; version 0 is empty."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.version = spark, path or f"{folder(spark)}/granary-index-{uuid.uuid4().hex}", 0

    def at(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/version={version}")

    def take(self, snapshot: DataFrame) -> int:
        """Write the version after ``snapshot``; a version that was left half written is written again."""
        advanced(self.at(self.version), snapshot).write.mode("overwrite").parquet(f"{self.path}/version={self.version + 1}")
        self.version += 1
        return self.version

    def changes(self, since: int = 0) -> DataFrame:
        """(version, path, state, twin_of) of all that versions after ``since`` changed; a path deleted or a duplicate before and still so is no change."""
        out = None
        for v in range(since + 1, self.version + 1):
            old = self.at(v - 1).select("path", F.col("status").alias("old"), F.col("twin_of").alias("old_twin"))
            rows = self.at(v).join(old, "path", "left")
            still = (F.col("status") == F.col("old")) & F.col("state").isin("deleted", "duplicate") & F.col("twin_of").eqNullSafe(F.col("old_twin"))
            rows = rows.where((F.col("state") != "unchanged") & ~F.coalesce(still, F.lit(False))).select(F.lit(v).alias("version"), "path", "state", "twin_of")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "version int, path string, state string, twin_of string")
