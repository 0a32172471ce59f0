"""Intermediate tables, written once to the folder that the session's executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows up to which a counted side is broadcast
BROADCAST_ROWS = 1_000_000
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that has none gets a folder of its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="granary-tables-")
    return _own[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """A reader of ``df``, which is computed once."""
    spark = df.sparkSession
    path = f"{folder(spark)}/granary-table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the session has cores dealt out to all of them; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def small(df: DataFrame) -> DataFrame:
    """``df`` written, and marked for a broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def clear() -> None:
    """Delete all tables made so far."""
    while _made:
        spark, path = _made.pop()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        clear()
    except Exception:  # the session may have ended first; its scratch folder is the cluster's
        pass
