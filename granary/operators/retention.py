"""Which copies a rolling retention keeps, and the deletion of what is past its days or belongs to people to be forgotten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.operators.tables import folder, written


def rolling(copies: DataFrame, key: str, at: str, order: str, as_of: Column, daily: int, weekly: int, monthly: int) -> DataFrame:
    """``copies`` with ``kept_for``: day, week, month, newest or null (to be deleted).

    Of each ``key``, the newest copy of each of the last ``daily`` days stays;
    of what is left, the newest of each ISO week of ``weekly`` weeks, then of
    each month of ``monthly`` times 31 days; the very newest always stays.
    Later copies come first, equal times by falling ``order``.
    """
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000)
    out = copies.withColumn("kept_for", F.lit(None).cast("string"))
    rules = (
        ("day", F.date_trunc("day", at), daily),
        ("week", F.date_trunc("week", at), weekly * 7),
        ("month", F.date_trunc("month", at), monthly * 31),
    )
    newest_first = (F.col(at).desc(), F.col(order).desc())
    for rule, bucket, days in rules:
        due = F.col("kept_for").isNull() & (age <= days)
        first = F.row_number().over(Window.partitionBy(key, due, bucket).orderBy(*newest_first)) == 1
        out = out.withColumn("kept_for", F.when(due & first, rule).otherwise(F.col("kept_for")))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first)) == 1
    return out.withColumn("kept_for", F.coalesce("kept_for", F.when(newest, "newest")))


# fixed values: days that questions and traces are kept, days after which questions lose their people
QUERY_DAYS, TRACE_DAYS, ANONYMOUS_DAYS = 365, 90, 90
PERSONAL = ("user_id", "user_name", "chat_id")
PARTITION = "day"


class Store:
    """Tables of one folder, dealt out by day; a change rewrites only the days it touches.

    Tables: queries (id, user_id, created_at, ...), feedback (id, query_id, user_id, created_at), traces (id, user_id, ts) and users (user_id).
    """

    times = {"queries": "created_at", "feedback": "created_at", "traces": "ts"}

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{folder(spark)}/granary-store-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    def save(self, name: str, rows: DataFrame) -> None:
        if name in self.times:
            rows = rows.withColumn(PARTITION, F.to_date(self.times[name]))
            self.schemas[name] = rows.schema
            rows.write.mode("overwrite").partitionBy(PARTITION).parquet(f"{self.path}/{name}")
        else:
            self.schemas[name] = rows.schema
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def _rewrite(self, name: str, touched: DataFrame, kept: DataFrame) -> None:
        """Put ``kept`` in place of the days of ``touched``; a day with no row left goes whole."""
        if name not in self.times:
            written(kept).write.mode("overwrite").parquet(f"{self.path}/{name}")
            return
        days = [r[0] for r in touched.select(PARTITION).distinct().collect()]  # a row a day
        if not days:
            return
        dated = F.col(PARTITION).isin([d for d in days if d is not None]) | (F.col(PARTITION).isNull() & F.lit(None in days))
        fresh = written(kept.where(dated))
        left = {r[0] for r in fresh.select(PARTITION).distinct().collect()}
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(f"{self.path}/{name}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for day in set(days) - left:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{PARTITION}={day or '__HIVE_DEFAULT_PARTITION__'}")
            p.getFileSystem(conf).delete(p, True)
        self.spark.catalog.refreshByPath(f"{self.path}/{name}")

    def _drop(self, name: str, gone: DataFrame, key: str, dry: bool) -> int:
        """Delete the rows whose ``key`` is in ``gone``; their number."""
        rows = self.table(name)
        hit = rows.join(gone.select(key).distinct(), key, "left_semi")
        n = hit.count()
        if n and not dry:
            self._rewrite(name, hit, rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns))
        return n

    def clean(self, as_of: Column, query_days: int = QUERY_DAYS, trace_days: int = TRACE_DAYS, dry: bool = False) -> dict[str, int]:
        """Delete questions and traces past their days, and feedback on such questions; 0 days keep all.  ``dry`` only counts."""
        out = {"queries": 0, "feedback": 0, "traces": 0}
        if query_days:
            old = written(self.table("queries").where(F.col("created_at") < as_of - F.make_dt_interval(F.lit(query_days))).select("id"))
            out["feedback"] = self._drop("feedback", old.select(F.col("id").alias("query_id")), "query_id", dry)
            out["queries"] = self._drop("queries", old, "id", dry)
        if trace_days:
            old = written(self.table("traces").where(F.col("ts") < as_of - F.make_dt_interval(F.lit(trace_days))).select("id"))
            out["traces"] = self._drop("traces", old, "id", dry)
        return out

    def forget(self, users: DataFrame, keep_questions: bool = False, dry: bool = False) -> dict[str, int]:
        """Delete all that belongs to ``users`` (user_id); with ``keep_questions`` their questions stay, without the people."""
        users = written(users.select("user_id").distinct())
        own = written(self.table("queries").join(users, "user_id", "left_semi").select("id"))
        feedback = self.table("feedback")
        hit = feedback.join(users, "user_id", "left_semi").select("id")
        if not keep_questions:
            hit = hit.union(feedback.join(own.select(F.col("id").alias("query_id")), "query_id", "left_semi").select("id"))
        out = {"feedback": self._drop("feedback", written(hit.distinct()), "id", dry)}
        if keep_questions:
            out["anonymized"] = self._blanked("queries", self.table("queries").join(users, "user_id", "left_semi"), own, dry)
        else:
            out["queries"] = self._drop("queries", own, "id", dry)
        out["traces"] = self._drop("traces", users, "user_id", dry)
        out["users"] = self._drop("users", users, "user_id", dry)
        return out

    def _blanked(self, name: str, touched: DataFrame, ids: DataFrame, dry: bool) -> int:
        """Take the people out of the rows of ``ids``; how many named one."""
        n = touched.where("user_id IS NOT NULL").count()
        if n and not dry:
            rows = self.table(name)
            marked = rows.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
            blank = {c: F.when(F.col("__hit"), None).otherwise(F.col(c)).alias(c) for c in PERSONAL if c in rows.columns}
            self._rewrite(name, touched, marked.select(*[blank.get(c, F.col(c)) for c in rows.columns]))
        return n

    def anonymize(self, as_of: Column, days: int = ANONYMOUS_DAYS, dry: bool = False) -> dict[str, int]:
        """Questions and traces older than ``days`` lose their people, texts stay."""
        out = {}
        for name, at in (("queries", "created_at"), ("traces", "ts")):
            old = self.table(name).where((F.col(at) < as_of - F.make_dt_interval(F.lit(days))) & F.col("user_id").isNotNull())
            out[name] = self._blanked(name, old, written(old.select("id")), dry)
        return out
