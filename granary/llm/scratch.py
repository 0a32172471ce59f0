"""Tables that cut lineage, kept in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only a session on one
machine (``local`` master, as in unit tests) that has none gets a folder of its
own; on a cluster a missing setting is an error.  A written table is
preferred to ``DataFrame.checkpoint`` because it computes its input once and
survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: bytes of a row group: what a writing task holds
ROW_GROUP = 16 << 20
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="granary-")
    return _own[app]


def free(columns: list[str], name: str) -> str:
    """``name``, or what comes of it by underscores, that is no column's name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, label: str) -> str:
    """A path of the shared folder for tasks' own files; ``clear`` deletes it with what killed tasks left there."""
    path = f"{shared_dir(spark)}/granary-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def clear(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote and the folders of ``files``; their readers are of no use afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        _, path = _written.pop()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _at_exit() -> None:
    for spark, _ in _written[:1]:
        try:
            clear(spark)
        except Exception:  # the JVM may have gone first; the cluster owns its scratch folder
            pass


atexit.register(_at_exit)
