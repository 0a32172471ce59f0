"""A pair of tables in buckets of one key, each table and bucket one sorted Parquet file.

``write_numbered`` writes rows into numbered files: rows are clustered by their
number, each number in a task of its own, sorted in full, and written by a writer
with dynamic ``partitionBy(table, number)`` folders and no limit of records a file.
A number of more than ``SPLIT_ROWS`` rows is clustered by ranges of the whole sort
key instead, so many tasks sort it and its folder gets one sorted part each.
A distributed step then flattens the folders, a task for some of them: a
folder's single part is renamed to the final file; several parts are streamed,
row group by row group in order, into one file, for one whole file is asked for.

``rewrite_pair`` takes a pair of tables written so (in any numbers) and leaves the
final files: rows go by the bucket of their key, rows whose key the first table
lacks and rows without a key to two buckets of their own.  A starting file
that holds just the rows of a final file stays as it is.

What the driver sees is a row a file (their number is a parameter, not the
input's size); nothing is broadcast.  The join with the first table's keys is a
sort-merge join, which Spark splits where one key has very many rows.

Losing executors: the writer commits whole jobs; a rename or a merge that runs
again finds the final file in place, or begins anew from parts that are removed only after
the final file has its name.

Edge cases: empty tables give no files; null keys, nulls in any column, repeated
rows and keys are kept; files hold the tables' own columns in their order, names may clash
with those used here; nulls sort first, strings by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.scratch import cut, free, shared_dir
from granary.llm.shared_files import opened

BUCKETS = 150
SALT = "pair"
SPLIT_ROWS = 500_000
BATCH_ROWS = 1 << 17


def full_order(columns: list[str], key: str) -> list[Column]:
    """The key descending, then the other columns as they stand, ascending; nulls first."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in columns}
    return [F.desc_nulls_first(quoted[key]), *(F.asc_nulls_first(x) for c, x in quoted.items() if c != key)]


def _moved(store: fs.FileSystem, source: str, target: str) -> None:
    try:
        store.move(source, target)
    except OSError:
        if store.get_file_info(target).type != fs.FileType.File:  # else another attempt was first
            raise


def flatten(folder: str, target: str) -> None:
    """Make the parts of ``folder`` the one file ``target``; may run any number of times."""
    store, source = opened(folder)
    goal = opened(target)[1]
    if store.get_file_info(goal).type == fs.FileType.File:
        return
    store.create_dir(goal.rpartition("/")[0], recursive=True)
    parts = sorted(x.path for x in store.get_file_info(fs.FileSelector(source)) if x.is_file and x.base_name.endswith(".parquet"))
    if len(parts) == 1:
        _moved(store, parts[0], goal)
        return
    whole = f"{source}/whole-{uuid.uuid4().hex}"
    writer = None
    for part in parts:  # ranges of the order, by number
        with store.open_input_file(part) as file:
            rows = pq.ParquetFile(file)
            writer = writer or pq.ParquetWriter(whole, rows.schema_arrow, filesystem=store, compression="snappy")
            for batch in rows.iter_batches(BATCH_ROWS):
                writer.write_batch(batch)
    writer.close()
    _moved(store, whole, goal)


def _in_tasks(spark: SparkSession, rows: list[tuple], columns: str, work: Callable, schema: str) -> DataFrame:
    """``work`` over the rows of a bounded list, dealt out evenly."""
    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(k % tasks, *r) for k, r in enumerate(rows)], f"task int, {columns}")
    return listed.repartitionById(tasks, F.col("task")).drop("task").mapInArrow(work, schema)


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            flatten(row["folder"], row["target"])
        yield batch.select(["target"])


def write_numbered(df: DataFrame, number: str, order: list[Column], folder: str, table: str, counts: dict[int, int], name: Callable[[int], str], split_rows: int = SPLIT_ROWS) -> dict[int, str]:
    """Write the rows of every number (column ``number``, left out) as one sorted file of ``folder``; number -> path."""
    spark, staging = df.sparkSession, f"{folder}/_staging-{uuid.uuid4().hex}"
    if not counts:
        return {}
    own = free(df.columns, "table")
    # not a plain literal: the optimizer would take it out of the sort, and the writer then sorts anew by its folders alone
    df = df.withColumn(own, F.coalesce(F.when(F.col(number) >= 0, F.lit(table)), F.lit(table)))
    large = [n for n, rows in counts.items() if rows > split_rows]
    whole = counts.keys() - large

    def put(part: DataFrame, sub: str) -> None:
        part.write.partitionBy(own, number).option("maxRecordsPerFile", 0).parquet(f"{staging}/{sub}")

    if whole:  # a task for each number
        dealt = df.where(~F.col(number).isin(large)) if large else df
        put(dealt.repartitionById(max(whole) + 1, F.col(number)).sortWithinPartitions(own, number, *order), "whole")
    if large:  # many tasks sort each
        tasks = sum(-(-counts[n] // split_rows) for n in large) + len(large)
        ranged = df.where(F.col(number).isin(large)).repartitionByRange(tasks, F.col(number), *order)
        put(ranged.sortWithinPartitions(own, number, *order), "split")
    paths = {n: f"{folder}/{name(n)}" for n in counts}
    moves = [(f"{staging}/{'whole' if n in whole else 'split'}/{own}={table}/{number}={n}", path) for n, path in paths.items()]
    done = _in_tasks(spark, moves, "folder string, target string", _flattened, "target string").collect()
    assert len(done) == len(moves)
    _removed(spark, [staging])
    return paths


def _removed(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def crc_of(value: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned crc32 of ``salt`` followed by the decimal value, modulo the number of buckets; null for null."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), value.cast("string"))), F.lit(buckets)).cast("int")


def _counted(df: DataFrame, number: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(number).count().collect()}


class Pair:
    """Two tables with a common key in a folder of their own: ``parent`` has the keys, ``child`` refers to them."""

    def __init__(self, spark: SparkSession, parent: str, child: str, key: str, buckets: int = BUCKETS, salt: str = SALT, folder: str | None = None, split_rows: int = SPLIT_ROWS):
        self.spark, self.names, self.key, self.buckets, self.salt, self.split_rows = spark, (parent, child), key, buckets, salt, split_rows
        self.folder = folder or f"{shared_dir(spark)}/granary-pair-{uuid.uuid4().hex}"
        self.schemas: dict = {}
        self.starting: dict[str, dict[int, str]] = {}

    def bucket(self) -> Column:
        """The bucket of a row by its key alone; rows without one have the last."""
        return F.coalesce(crc_of(F.col(self.key), self.buckets, self.salt), F.lit(self.buckets + 1))

    def start(self, table: str, rows: DataFrame, file: Column) -> None:
        """Write ``rows`` into numbered starting files of ``table``; ``file`` gives each row's number."""
        number = free(rows.columns, "number")
        self.schemas[table] = rows.schema
        numbered = rows.withColumn(number, file)
        self.starting[table] = write_numbered(
            numbered, number, full_order(rows.columns, self.key), self.folder, table, _counted(numbered, number), lambda n: f"{table}/start-{n:05d}.parquet", self.split_rows
        )

    def _read(self, table: str, number: str) -> DataFrame:
        """The rows of all starting files with their files' numbers."""
        if not self.starting[table]:
            return self.spark.createDataFrame([], self.schemas[table]).withColumn(number, F.lit(0))
        rows = self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{table}")
        return rows.withColumn(number, F.regexp_extract(F.col("_metadata.file_name"), r"start-(\d+)\.parquet$", 1).cast("int"))

    def rewrite(self) -> DataFrame:
        """(table_name, path, columns, bucket, n_rows, n_joined, rewritten, lineage) of every final file; ``lineage`` lists (starting file, rows).

        The folder then holds the final files only.
        """
        parent, child = self.names
        file = {t: free(self.schemas[t].names, "file_number") for t in self.names}
        home = {t: free([*self.schemas[t].names, file[t]], "home_bucket") for t in self.names}
        joins = free([*self.schemas[child].names, file[child], home[child]], "partners")
        key = F.col(self.key)
        first = self._read(parent, file[parent]).withColumn(home[parent], self.bucket())
        ids = cut(first.where(key.isNotNull()).groupBy(key.alias("parent_key")).agg(F.count(F.lit(1)).alias(joins)), "pair-keys")
        second = self._read(child, file[child]).join(ids.hint("merge"), F.col(self.key) == F.col("parent_key"), "left").drop("parent_key")
        second = second.withColumn(home[child], F.when(key.isNotNull() & F.col(joins).isNull(), self.buckets).otherwise(self.bucket()))
        placed = {parent: first, child: cut(second, "pair-placed")}
        tally = None
        for t in self.names:
            partners = F.coalesce(F.sum(joins), F.lit(0)) if t == child else F.lit(0).cast("long")
            own = placed[t].groupBy(F.col(home[t]).alias("bucket"), F.col(file[t]).alias("file")).agg(F.count(F.lit(1)).alias("n"), partners.alias("partners"))
            own = own.select(F.lit(t).alias("table_name"), "*")
            tally = own if tally is None else tally.unionByName(own)
        tally = cut(tally, "pair-tally")  # a row a table, bucket and starting file
        alone = tally.groupBy("table_name", "file").agg(F.count(F.lit(1)).alias("buckets"))
        finals = tally.join(alone, ["table_name", "file"]).groupBy("table_name", "bucket").agg(
            F.sum("n").alias("n_rows"),
            F.array_sort(F.collect_list(F.struct("file", "n"))).alias("lineage"),
            (F.count(F.lit(1)) + F.max("buckets") == 2).alias("stays"),
            F.min("file").alias("file"),
        )
        finals = cut(finals, "pair-finals")
        joined = tally.groupBy("bucket").agg(F.sum("partners").alias("n_joined"))
        rows = []
        for t in self.names:
            plan = finals.where(F.col("table_name") == t).select("bucket", "n_rows", "stays", "file").collect()
            new = {r["bucket"]: r["n_rows"] for r in plan if not r["stays"]}
            kept = {r["bucket"]: self.starting[t][r["file"]] for r in plan if r["stays"]}
            moving = placed[t].where(~F.col(file[t]).isin([r["file"] for r in plan if r["stays"]])) if kept else placed[t]
            drop = [file[t]] + [joins] * (t == child)
            written = write_numbered(
                moving.drop(*drop), home[t], full_order(self.schemas[t].names, self.key), self.folder, t, new, lambda n, t=t: f"{t}/bucket-{n:05d}.parquet", self.split_rows
            )
            _removed(self.spark, sorted({*self.starting[t].values()} - {*kept.values()}))
            names = ",".join(self.schemas[t].names)
            rows += [(t, b, path, names, b in written) for b, path in sorted((kept | written).items())]
        listed = self.spark.createDataFrame(rows, "table_name string, bucket int, path string, columns string, rewritten boolean")
        return listed.join(finals.select("table_name", "bucket", "n_rows", "lineage"), ["table_name", "bucket"]).join(joined, "bucket", "left")


def _digested(key: str):
    """The final files' keys in file order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                store, at = opened(path)
                digest, rows = hashlib.sha256(), 0
                with store.open_input_file(at) as file:
                    for part in pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=[key]):
                        text = ",".join("" if x is None else str(x) for x in part.column(0).to_pylist())
                        digest.update(("," * (rows > 0) + text).encode())
                        rows += part.num_rows
                out.append((path, digest.hexdigest(), rows))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["path", "ids_sha256", "read_rows"])

    return run


def digests(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """(path, ids_sha256, read_rows) of files: the digest of their keys in file order."""
    return _in_tasks(spark, [(p,) for p in paths], "path string", _digested(key), "path string, ids_sha256 string, read_rows long")


def op12(sales: DataFrame, lines: DataFrame, buckets: int = BUCKETS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    spark = sales.sparkSession
    pair = Pair(spark, "sales", "sale_lines", "sale_id", buckets, split_rows=split_rows)
    home = pair.bucket()
    pair.start("sales", sales, F.when(home % 5 == 1, home - 1).otherwise(home))
    pair.start("sale_lines", lines, F.coalesce(crc_of(F.col("item_id"), buckets), F.lit(0)))
    files = cut(pair.rewrite(), "pair-files")
    paths = [r[0] for r in files.select("path").collect()]
    read = digests(spark, paths, "sale_id") if paths else spark.createDataFrame([], "path string, ids_sha256 string, read_rows long")
    lineage = F.array_join(F.transform("lineage", lambda x: F.concat_ws(":", x["file"].cast("string"), x["n"].cast("string"))), ",")
    return files.join(read, "path").select(
        "table_name",
        "path",
        "columns",
        "ids_sha256",
        F.sha2(lineage, 256).alias("lineage_sha256"),
        F.col("bucket").cast("long").alias("bucket"),
        F.col("read_rows").alias("n_rows"),
        F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"),
        "rewritten",
    )
