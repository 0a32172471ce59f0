"""Answer analytics: funnel, histogram, threshold advice, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.common import at_ranks, common_share


def funnel(questions: DataFrame, feedback: DataFrame) -> DataFrame:
    """(ord, step, n, share, kept, lost, loss) of the six steps, from one pass over the questions.

    The steps are independent predicates, so ``kept`` may pass 1 and ``lost``
    may be negative.
    """
    rated = feedback.groupBy("query_id").agg(F.max((F.col("verdict") == "up").cast("int")).alias("up"))
    one = questions.join(rated, F.col("id") == F.col("query_id"), "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("stage").isNotNull() & (F.col("stage") != "nothing_found")).alias("found"),
        F.count_if(F.col("stage") == "answered").alias("confident"),
        F.count_if(F.col("answered")).alias("answered"),
        F.count_if(F.col("query_id").isNotNull()).alias("rated"),
        F.count_if(F.col("up") == 1).alias("good"),
    )
    names = ["total", "found", "confident", "answered", "rated", "good"]
    steps = one.select(
        "total",
        F.posexplode(F.array(*[F.struct(F.lit(x).alias("step"), F.col(x).alias("n")) for x in names])).alias("ord", "s"),
    ).select("ord", "total", "s.step", "s.n")
    before = F.lag("n").over(Window.orderBy("ord"))  # six rows
    out = steps.withColumn("before", before)
    loss = (
        F.when(F.col("step").isin("found", "confident", "answered"), F.col("n") < F.col("before"))
        .when(F.col("step") == "rated", F.col("n") < 0.05 * F.col("before"))
        .otherwise(F.lit(False))
    )
    return out.select(
        F.col("ord").cast("long").alias("ord"),
        "step",
        "n",
        common_share(F.col("n"), F.col("total")).alias("share"),
        F.when(F.col("before").isNull(), common_share(F.col("n"), F.col("total"))).otherwise(common_share(F.col("n"), F.col("before"))).alias("kept"),
        F.coalesce(F.col("before") - F.col("n"), F.lit(0)).alias("lost"),
        loss.alias("loss"),
    )


def breakdown(questions: DataFrame, by: str) -> DataFrame:
    """(by, n, ok, avg_ms, share): count, answered, mean value and share of the total."""
    g = questions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("answered")).alias("ok"), F.round(F.avg("value"), 4).alias("avg_ms")
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few groups
    return g.withColumn("share", F.round(F.col("n") / total, 4))


def latest_verdict(feedback: DataFrame) -> DataFrame:
    """(query_id, verdict) of each question's last feedback."""
    return feedback.groupBy("query_id").agg(F.max_by("verdict", "id").alias("verdict"))


def histogram(scores: DataFrame, bins: int = 24) -> DataFrame:
    """Equal-width bins over [min, max] of ``score`` with counts by ``verdict``; the last bin is closed, empty bins stay."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select(
        "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1e-6).alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    placed = scores.join(F.broadcast(ends)).withColumn(  # one row
        "bin", F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    )
    counts = placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "up").alias("up"),
        F.count_if(F.col("verdict") == "down").alias("down"),
    )
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", width.alias("w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return grid.join(counts, "bin", "left").select(
        "bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("from"), zero("n"), zero("up"), zero("down")
    )


def threshold_advice(scores: DataFrame, qs=(0.05, 0.10, 0.15, 0.20, 0.30, 0.40)) -> DataFrame:
    """For the floor-index quantiles as thresholds: what each cuts, and which is best (bad - 3 * good, first wins)."""
    names = [f"q{k}" for k in range(len(qs))]
    ranks = {name: (lambda n, q=q: F.least(F.floor(n * q), n - 1)) for name, q in zip(names, qs)}
    found = at_ranks(scores, "score", ranks, [])  # one row
    cuts = (
        found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("score")) for k, name in enumerate(names)])).alias("g"))
        .groupBy(F.round("g.score", 5).alias("threshold"))
        .agg(F.min("g.k").alias("k"))
    )
    hit = F.col("score") < F.col("threshold")
    found = scores.join(F.broadcast(cuts)).groupBy("threshold", "k").agg(  # at most len(qs) thresholds
        F.count_if(hit).alias("cuts"),
        F.count_if(hit & (F.col("verdict") == "up")).alias("cuts_good"),
        F.count_if(hit & (F.col("verdict") == "down")).alias("cuts_bad"),
    )
    gain = F.col("cuts_bad") - 3 * F.col("cuts_good")
    rated = (F.col("cuts_bad") + F.col("cuts_good")) > 0
    order = Window.partitionBy(F.lit(1)).orderBy(F.when(rated, gain).desc_nulls_last(), "k")
    return found.select(
        "threshold", "cuts", "cuts_good", "cuts_bad", ((F.row_number().over(order) == 1) & rated).alias("best")
    )


def score_summary(scores: DataFrame, below: float) -> DataFrame:
    """Upper median (element n // 2), extremes, and what lies on the wrong side of a threshold."""
    low = F.col("score") < below
    middle = at_ranks(scores, "score", {"median": lambda n: F.floor(n / 2)}, [])  # one row
    counted = scores.agg(
        F.min("score").alias("least"),
        F.max("score").alias("most"),
        F.count_if(low).alias("below"),
        F.count_if(low & (F.col("verdict") == "up")).alias("good_below"),
        F.count_if(~low & (F.col("verdict") == "down")).alias("bad_above"),
    )
    return counted.join(F.broadcast(middle), F.lit(True), "left").select("median", "least", "most", "below", "good_below", "bad_above")


def channel_shares(questions: DataFrame) -> DataFrame:
    """(channels, n, share, avg_score, verdict) of each combination of channels."""
    g = questions.groupBy(F.coalesce("channels", F.lit("—")).alias("channels")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_score")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("share", F.round(share, 4)).withColumn(
        "verdict", F.when(share < 0.03, "useless").when(share < 0.15, "weak").otherwise("works")
    )


# fixed values: categories of what is wrong with a library, in the words of its table
UNTYPED, UNDATED, BAD_NAME, COPY, BRAND_TWINS, GAP = "без типа", "без даты", "плохое имя", "дубль", "бренды-двойники", "пробел покрытия"


def problems(docs: DataFrame, mandatory: list[str], replaceable: list[str]) -> DataFrame:
    """(category, path, detail): everything to mend in a library, in one table.

    ``docs`` has rel_path, brand, doc_type, effective_date, content_hash, hint (of its type), mtime_hint and bad_word ("" if its name
    is fine).  Documents without a type, ``replaceable`` ones without a date, bad
    names, copies but the first by path, brands that differ only in case and
    signs, and brands that lack a ``mandatory`` type.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = lambda df, category, path, detail: df.select(F.lit(category).alias("category"), path.alias("path"), detail.alias("detail"))
    path = F.col("rel_path")
    copies = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first")).where("n > 1")
    others = docs.join(copies, "content_hash").where("rel_path <> first")
    named = docs.where("brand IS NOT NULL")
    plain = F.regexp_replace(F.lower("brand"), "[^0-9a-zа-я]", "")
    twins = named.select("brand", plain.alias("plain")).distinct().groupBy("plain").agg(F.array_sort(F.collect_list("brand")).alias("names")).where(F.size("names") > 1)
    lacking = F.array_except(F.array(*[F.lit(x) for x in mandatory]), F.collect_set("doc_type"))
    gaps = named.groupBy("brand").agg(lacking.alias("missing")).where(F.size("missing") > 0)
    out = row(docs.where("doc_type IS NULL"), UNTYPED, path, text("hint"))
    for more in (
        row(docs.where(F.col("effective_date").isNull() & F.col("doc_type").isin(*replaceable)), UNDATED, path, text("mtime_hint")),
        row(docs.where("bad_word <> ''"), BAD_NAME, path, F.col("bad_word")),
        row(others, COPY, path, F.concat(F.lit("копий: "), F.col("n").cast("string"))),
        row(twins, BRAND_TWINS, F.array_join("names", " | "), F.lit("")),
        row(gaps, GAP, F.col("brand"), F.array_join("missing", ", ")),
    ):
        out = out.unionByName(more)
    return out


def problem_lines(found: DataFrame) -> DataFrame:
    """The table's lines: fields in quotation marks (doubled inside), joined by semicolons."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return found.select(F.concat_ws(";", quoted("category"), quoted("path"), quoted("detail")).alias("line"))
