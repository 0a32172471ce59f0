"""Memory of conversations with a time to live, alerts, and a watched folder, as streams with batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.tables import written

# fixed values: signatures of models, words that say nothing, words for properties, minutes that a memory lasts
SIGNATURE = r"(?iU)\b[0-9]+(?:[.,][0-9]+)?(?:[/\-][0-9]+(?:[.,][0-9]+)?)+\b|\b[0-9]{4,8}(?:\.[A-ZА-Я0-9]{1,3})?\b|\b[A-Za-z]+[0-9]+[\w\-]*\b"
FILLER = (
    "а и но же ну как что какой какая какое какие сколько есть ли у на в по для не него неё нее них этой этого это эта тот той такой такая цена "
    "стоимость стоит почём"
).split()
PROPERTIES = (
    "напор подача производительность расход давление мощность вес масса гарантия размер диаметр температура обороты шум ресурс комплект "
    "комплектация погружение погружения глубина длина высота ток напряжение артикул срок службы материал защита класс паспорт сертификат"
).split()
MINUTES, ENTITIES = 15, 6


def entities(text: Column, brands: Column) -> Column:
    """Signatures in order, each once in any case, then known brands in order of the alphabet; six at most."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIGNATURE), F.lit(0))
    lowered = F.transform(found, lambda x: F.lower(x))
    first = F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.slice(F.concat(first, F.array_sort(F.array_intersect(words, brands))), 1, ENTITIES)


def follows_up(text: Column, own: Column) -> Column:
    """No subject of its own, and nothing said but words for properties."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    said = F.filter(words, lambda w: ~w.isin(*FILLER) & (F.length(w) > 2))
    return (F.size(own) == 0) & F.forall(said, lambda w: w.isin(*PROPERTIES))


def marked(turns: DataFrame, brands: Column) -> DataFrame:
    """Turns (chat, at, question) with ``entities`` and ``follow_up``."""
    out = turns.withColumn("entities", entities(F.col("question"), brands))
    return out.withColumn("follow_up", follows_up(F.col("question"), F.col("entities")))


def inherited(turns: DataFrame, brands: Column, minutes: int = MINUTES) -> DataFrame:
    """(chat, at, asked): a follow-up question gets the entities of the last turn that had any, if within the time to live."""
    w = Window.partitionBy("chat").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.size("entities") > 0, F.struct("at", "entities")), ignorenulls=True).over(w)
    rows = marked(turns, brands).withColumn("last", last)
    fresh = F.col("follow_up") & F.col("last").isNotNull() & (F.unix_micros("at") - F.unix_micros("last.at") <= minutes * 60_000_000)
    asked = F.when(fresh, F.concat("question", F.lit(" ("), F.array_join("last.entities", " "), F.lit(")"))).otherwise(F.col("question"))
    return rows.select("chat", "at", asked.alias("asked"))


def inherited_stream(turns: DataFrame, brands: Column, minutes: int = MINUTES) -> DataFrame:
    """The same on a stream with a watermark on ``at``: a chat's state is its last entities, dropped at the end of their time to live."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        when, held = state.get if state.exists else (None, "")
        rows = pd.concat(list(frames)).sort_values("at", ignore_index=True)
        asked = []
        for r in rows.itertuples():
            us = int(pd.Timestamp(r.at).value // 1000)
            live = r.follow_up and when is not None and held and us - when <= minutes * 60_000_000
            asked.append(f"{r.question} ({held})" if live else r.question)
            if r.found:
                when, held = us, r.found
        if when is not None:
            state.update((when, held))
            state.setTimeoutTimestamp(max(when // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"chat": key[0], "at": rows["at"], "asked": asked})

    kind = turns.schema["chat"].dataType.simpleString()
    rows = marked(turns, brands).select("chat", "at", "question", F.array_join("entities", " ").alias("found"), "follow_up")
    return rows.groupBy("chat").applyInPandasWithState(
        step, f"chat {kind}, at timestamp, asked string", "at long, entities string", "append", GroupStateTimeout.EventTimeTimeout
    )


def alerts(reports: DataFrame, checks: DataFrame, again_hours: int = 12) -> DataFrame:
    """(code, opened, last_seen, notices, resolved) of each alert.

    ``checks`` (at) are the times of all checks, ``reports`` (code, at) what each found.  An
    alert is open while every check reports it; the first check without it resolves it.
    Notices go out at the opening and then every ``again_hours``.
    """
    # checks get their numbers by days: those of the days before, and the place in the day
    times = written(checks.select("at").where("at IS NOT NULL").distinct().withColumn("day", F.to_date("at")))
    days = times.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a day
    place = F.row_number().over(Window.partitionBy("day").orderBy("at"))
    numbered = written(times.withColumn("place", place).join(days.select("day", earlier.alias("earlier")), "day").select("at", (F.col("earlier") + F.col("place")).alias("n")))
    following = numbered.select((F.col("n") - 1).alias("last"), F.col("at").alias("resolved"))
    by_code = Window.partitionBy("code").orderBy("n")
    seen = reports.select("code", "at").distinct().join(numbered, "at").withColumn("run", F.col("n") - F.row_number().over(by_code))
    runs = seen.groupBy("code", "run").agg(F.min("at").alias("opened"), F.max("at").alias("last_seen"), F.max("n").alias("last"))
    notices = F.floor((F.unix_micros("last_seen") - F.unix_micros("opened")) / (again_hours * 3_600_000_000)) + 1
    return runs.join(following, "last", "left").select("code", "opened", "last_seen", notices.cast("long").alias("notices"), "resolved")


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """A running query that hands every new file of ``folder`` (path, modificationTime, length, content) to ``handle`` once.

    With ``seconds`` it polls for ever; without, it takes what is there and stops.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = stream.option("recursiveFileLookup", "true").load(folder)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
