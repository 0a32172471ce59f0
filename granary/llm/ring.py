"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells.  Every shard owns ``vnodes`` virtual nodes, each
standing on a cell of its own; the cells from one virtual node (exclusive) back
to the one before it form its arc, so a row belongs to the first virtual node
clockwise from its cell.  A row's cell is a hash of its id and text.

A shard takes at most ``n // shards`` rows, the first ``n % shards`` shards one
more.  Rows of its own arcs come first, arc by arc from cell 0; the rows that
find their shard full walk on clockwise to the next virtual node whose shard
has room.  Loads are therefore at most one row apart, and a row moves only if
its shard is full.

Only the count of each cell (a fixed number of cells, whatever the input) goes
to the driver, which decides how many rows of a cell go where.  Rows find their
place from their rank inside the cell, so no task holds a shard or an arc; rows
equal in id and text are counted first, and dealt out again by stretches of slots.

Edge cases: null text counts as empty; a null id leaves the text to place the
row; rows equal in id and text are interchangeable; an empty table gives no
rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
STRETCH = 1 << 16
ROW_OVERHEAD = 16


def ring_nodes(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of all virtual nodes; a taken cell passes a node on to the next free one."""
    if shards * vnodes > cells:
        raise ValueError("more virtual nodes than cells")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"node:{shard}:{v}".encode()).digest()
            cell = int.from_bytes(digest[:8], "big") % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def allot(counts: np.ndarray, nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, lo, hi, shard, slot): ranks lo..hi-1 of a cell go to ``shard``, slots from ``slot``."""
    n = int(counts.sum())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    at = [c for c, _ in nodes]
    ranges: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []

    def put(cell: int, lo: int, want: int, shard: int) -> int:
        take = min(want, room[shard])
        if take:
            ranges.append((cell, lo, lo + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return take

    for cell in np.flatnonzero(counts).tolist():
        home = bisect.bisect_left(at, cell) % len(nodes)
        total = int(counts[cell])
        took = put(cell, 0, total, nodes[home][1])
        if took < total:
            left.append((cell, took, home))
    for cell, lo, home in left:
        node = home
        while lo < int(counts[cell]):
            node = (node + 1) % len(nodes)
            lo += put(cell, lo, int(counts[cell]) - lo, nodes[node][1])
    return ranges


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("__hash"),
    ).withColumn("__cell", F.shiftrightunsigned("__hash", 48).cast("int"))
    counted = rows.groupBy("__cell").count().collect()  # at most CELLS rows
    counts = np.zeros(CELLS, dtype=np.int64)
    for cell, n in counted:
        counts[cell] = n
    ranges = allot(counts, ring_nodes(shards, vnodes), shards)
    table = pd.DataFrame(ranges, columns=["__cell", "__lo", "__hi", "shard", "__slot"]).astype(
        {"__cell": "int32", "__lo": "int64", "__hi": "int64", "shard": "int32", "__slot": "int64"}
    )
    places = spark.createDataFrame(table, "__cell int, __lo long, __hi long, shard int, __slot long")
    # rows equal in all of these are one row and its number: they are interchangeable, however many
    own = ["__cell", "__hash", "doc_id", "text_crc32", "size"]
    equal = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__cell").orderBy("__hash", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # CELLS plus one row for each further shard that a cell spills to: a fixed size
    meets = (F.col("__first") < F.col("__hi")) & (F.col("__first") + F.col("__n") > F.col("__lo"))
    placed = ranked.join(F.broadcast(places.withColumnRenamed("__cell", "__c")), (F.col("__cell") == F.col("__c")) & meets)
    begin, end = F.greatest("__first", "__lo"), F.least(F.col("__first") + F.col("__n"), F.col("__hi"))
    slots = placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__slot") + begin - F.col("__lo")).alias("__a"), (F.col("__slot") + end - F.col("__lo") - 1).alias("__b")
    )
    # very many equal rows are dealt to tasks by stretches of slots
    stretches = slots.select("*", F.explode(F.sequence("__a", "__b", F.lit(STRETCH).cast("long"))).alias("__s")).repartition("shard", "__s")
    last = F.least(F.col("__s") + STRETCH - 1, F.col("__b"))
    return stretches.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("__s"), last)).alias("slot"))


def op9(docs: DataFrame) -> DataFrame:
    """The contract's rows: law ``rows``, so no grown shard."""
    out = shard_documents(docs)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
