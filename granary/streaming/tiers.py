"""Samples of metrics in tiers that grow coarser, and the end of what is too old."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.tables import folder

# fixed values: seconds between samples, days that they are kept; the coarser tiers are our own
SAMPLE_S, KEEP_DAYS = 30, 30
TIERS = {"sample": SAMPLE_S, "five_minutes": 300, "hour": 3600}


def sampled(readings: DataFrame) -> DataFrame:
    """(name, slot, value): of the readings (name, us, id, value) of each 30 s the last one; ``slot`` counts seconds."""
    slot = F.floor(F.col("us") / (SAMPLE_S * 1_000_000)) * SAMPLE_S
    return readings.groupBy("name", slot.cast("long").alias("slot")).agg(F.max_by("value", F.struct("us", "id")).alias("value"))


def tiered(samples: DataFrame, as_of: int | None = None, days: int = KEEP_DAYS) -> DataFrame:
    """(tier, name, slot, n, low, mean, high) of samples (name, slot, value) in every tier, slots of the last ``days`` before ``as_of`` (seconds) only."""
    if as_of is not None:
        samples = samples.where(F.col("slot") > as_of - days * 86_400)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), (F.floor(F.col("slot") / s) * s).cast("long").alias("at")) for t, s in TIERS.items()])).alias("t")
    rows = samples.select("name", "value", each)
    return rows.groupBy("t.tier", "name", F.col("t.at").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))


class TierStore:
    """Samples of a stream in files by day: every batch is added once, days past their time go as folders."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{folder(spark)}/granary-tiers-{uuid.uuid4().hex}"

    def follow(self, readings: DataFrame, checkpoint: str | None = None):
        """A query over a stream of readings (name, us, id, value) that runs to its end; a batch that runs again replaces its own files."""

        def put(batch: DataFrame, number: int) -> None:
            rows = sampled(batch).withColumn("day", F.floor(F.col("slot") / 86_400).cast("long")).withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/samples")

        query = readings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{self.path}/state")
        return query.trigger(availableNow=True).start()

    def samples(self) -> DataFrame:
        """(name, slot, value): of a slot that several batches brought, the last batch's."""
        rows = self.spark.read.schema("name string, slot long, value double, day long, batch int").parquet(f"{self.path}/samples")
        return rows.groupBy("name", "slot").agg(F.max_by("value", "batch").alias("value"))

    def expire(self, as_of: int, days: int = KEEP_DAYS) -> list[int]:
        """Delete whole days older than ``days`` before ``as_of`` (seconds); the days deleted."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/samples")
        fs = top.getFileSystem(conf)
        gone = []
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("day=") and (int(name[4:]) + 1) * 86_400 <= as_of - days * 86_400:
                fs.delete(status.getPath(), True)
                gone.append(int(name[4:]))
        return sorted(gone)
