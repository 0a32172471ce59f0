"""Event-time windows, in batch and as a stream, by the same expressions.

Streams read files, take a watermark and write each batch to a table; a stream replayed to its end gives what the batch form gives
for all rows that the watermark admits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.operators.tables import folder


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total) in tumbling windows of an hour."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return _hourly(timed)


def _hourly(timed: DataFrame) -> DataFrame:
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")
    ).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def islands(events: DataFrame, gap_us: int) -> DataFrame:
    """(user_id, us, n): events numbered by runs in which no gap passes ``gap_us`` microseconds."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("before", F.lag("us").over(w))
    new = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") > gap_us), 1).otherwise(0)
    return e.withColumn("new", new).select("user_id", "us", F.sum("new").over(w).alias("n"))


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """(user_id, started, events) in session windows; batch or stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", "1 hour")
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("w.start").alias("started"), "events"
    )


def event_stream(spark: SparkSession, path: str, schema: StructType, late: str = "1 hour") -> DataFrame:
    """The event files (a file or a folder of them) as a stream with event time ``at`` and a watermark of ``late``."""
    base, _, leaf = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{base}/{leaf}*")
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def replayed_hourly(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The hourly windows of the files as they stand, by a stream run to its end.

    Each batch writes the windows it changed to a table; of a window the latest counts.
    """
    timed = event_stream(spark, path, schema)
    out = f"{folder(spark)}/granary-hourly-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch-{number}")

    query = _hourly(timed).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema("hour timestamp, event_type string, n long, total double, batch int").parquet(f"{out}/rows")
    last = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.unix_micros("hour").alias("hour"), "event_type", "x.n", "x.total")
