"""Silence of components, and leases on resources: state machines with timers, in batch and as streams.

A component that sends no sign of life for ``timeout`` is silent from then on,
until it comes back.  A lease on a resource is granted to the first holder that
asks, lives on by its signs of life, and expires when they fail to come; then the next one that asks takes it over.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.folds import folded
from granary.operators.tables import folder

# fixed values: seconds until a component counts as silent, a running job as stale, and the time a place in the queue is held
SILENT_S, STALE_S = 600, 180


def silences(beats: DataFrame, timeout_us: int, as_of: Column) -> DataFrame:
    """(key, since, back) of beats (key, us): every silence that began by ``as_of``, ``back`` null while it lasts."""
    following = F.lead("us").over(Window.partitionBy("key").orderBy("us"))
    gaps = beats.where(F.col("us") <= as_of).withColumn("back", following).withColumn("since", F.col("us") + timeout_us)
    return gaps.where(F.coalesce("back", as_of) > F.col("since")).select("key", "since", "back")


def silences_stream(beats: DataFrame, timeout_us: int) -> DataFrame:
    """The same on a stream (key, at; with a watermark): a silence comes out once it is sure, and once more with ``back``.

    Beats wait until the watermark is past them, so late ones within it are taken in their order; the timer is the next
    beat that waits, or the end of the time allowed.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, waiting = state.get if state.exists else (-1, False, [])
        mark = state.getCurrentWatermarkMs() * 1000
        waiting = sorted([*waiting, *(int(x) for f in frames for x in f["us"])])
        out: list[tuple[int, int | None]] = []
        while waiting and waiting[0] <= mark:
            us = waiting.pop(0)
            if last >= 0 and us - last > timeout_us:
                out.append((last + timeout_us, us))
            last, told = max(last, us), False
        if last >= 0 and not told and mark - last > timeout_us:
            out.append((last + timeout_us, None))
            told = True
        state.update((last, told, waiting))
        due = waiting[:1] + [last + timeout_us + 1] * (last >= 0 and not told)
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000) - 1, mark // 1000 + 1))
        yield pd.DataFrame({"key": [key[0]] * len(out), "since": [a for a, _ in out], "back": pd.array([b for _, b in out], "Int64")})

    kind = beats.schema["key"].dataType.simpleString()
    rows = beats.select("key", "at", F.unix_micros("at").alias("us"))
    return rows.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, since long, back long", "last long, told boolean, waiting array<long>", "update", GroupStateTimeout.EventTimeTimeout
    )


def replayed(spark: SparkSession, made: DataFrame, last_of: list[str], values: list[str]) -> DataFrame:
    """The rows of a stream run to its end, the latest batch's of each ``last_of``; batches are written to the shared folder."""
    out, kinds = f"{folder(spark)}/granary-replay-{uuid.uuid4().hex}", {f.name: f.dataType.simpleString() for f in made.schema}

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch-{number}")

    query = made.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", batch int"
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{out}/rows")
    order = F.struct("batch", *[F.col(v).isNotNull() for v in values])
    return rows.groupBy(*last_of).agg(F.max_by(F.struct(*values), order).alias("x")).select(*last_of, *[f"x.{v}" for v in values])


class Lease:
    """The lease on one resource: ``holder`` until ``until``; ``lost`` if the last one ran out."""

    def __init__(self, ttl_us: int, as_of: int | None = None) -> None:
        self.ttl, self.as_of, self.holder, self.until, self.lost = ttl_us, as_of, None, 0, False

    def expired(self, now: int) -> list[tuple[int, str, str]]:
        if self.holder is None or now < self.until:
            return []
        out = [(self.until, self.holder, "expired")]
        self.holder, self.lost = None, True
        return out

    def take(self, us: int, holder: str, action: str) -> list[tuple[int, str, str]]:
        out = self.expired(us)
        own = self.holder == holder
        if action == "acquire" and self.holder is None:
            out.append((us, holder, "taken_over" if self.lost else "granted"))
            self.holder, self.until, self.lost = holder, us + self.ttl, False
        elif action in ("acquire", "beat") and own:
            self.until = us + self.ttl
            out += [(us, holder, "renewed")] * (action == "acquire")
        elif action == "release" and own:
            self.holder = None
            out.append((us, holder, "released"))
        else:
            out.append((us, holder, "refused" if action == "acquire" else "ignored"))
        return out

    def close(self) -> list[tuple[int, str, str]]:
        return self.expired(self.as_of) if self.as_of is not None else []


def leases(requests: DataFrame, ttl_us: int, as_of: int | None = None) -> DataFrame:
    """(key, us, holder, event) of requests (key, us, id, holder, action) in order of ``us``, then ``id``.

    Actions are acquire, beat and release; events granted, taken_over, renewed, refused,
    released, ignored (a beat or release of a lease one does not have) and expired,
    the last at the time the lease ran out, for open ones if that is by ``as_of``.
    """
    order = [F.col("us"), F.col("id")]
    return folded(requests, "key", order, ["us", "holder", "action"], lambda: Lease(ttl_us, as_of), "us long, holder string, event string")


def leases_stream(requests: DataFrame, ttl_us: int) -> DataFrame:
    """The same on a stream (key, at, id, holder, action; with a watermark): the timer of a lease is its end."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease, waiting = Lease(ttl_us), []
        if state.exists:
            holder, lease.until, lease.lost, us, ids, holders, actions = state.get
            lease.holder = holder or None
            waiting = list(zip(us, ids, holders, actions))
        mark = state.getCurrentWatermarkMs() * 1000
        for f in frames:
            waiting += list(f[["us", "id", "holder", "action"]].itertuples(index=False, name=None))
        waiting = sorted((int(a), int(b), c, d) for a, b, c, d in waiting)
        out = []
        while waiting and waiting[0][0] <= mark:
            us, _, holder, action = waiting.pop(0)
            out += lease.take(us, holder, action)
        out += lease.expired(mark)
        us, ids, holders, actions = ([x[k] for x in waiting] for k in range(4))
        state.update((lease.holder or "", lease.until, lease.lost, us, ids, holders, actions))
        due = us[:1] + [lease.until] * (lease.holder is not None)
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000) - 1, mark // 1000 + 1))
        yield pd.DataFrame({"key": [key[0]] * len(out), "us": [x[0] for x in out], "holder": [x[1] for x in out], "event": [x[2] for x in out]})

    kind = requests.schema["key"].dataType.simpleString()
    held = "holder string, until long, lost boolean, us array<long>, ids array<long>, holders array<string>, actions array<string>"
    rows = requests.select("key", "at", F.unix_micros("at").alias("us"), "id", "holder", "action")
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, us long, holder string, event string", held, "append", GroupStateTimeout.EventTimeTimeout)
