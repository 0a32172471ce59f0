"""Retrieval quality: ranks, hit rate, reciprocal ranks, run differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import patterns
from granary.operators.tables import written


def first_ranks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, rank): the first rank of a true document, null if none; every query of ``truth`` has a row."""
    found = hits.join(truth, ["query", "doc_id"], "left_semi").groupBy("query").agg(F.min("rank").alias("rank"))
    return truth.select("query").distinct().join(found, "query", "left")


def quality(ranks: DataFrame) -> DataFrame:
    """One row: number of questions, hit rate and mean reciprocal rank, to three places."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 3).alias("hit"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"),
    )


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query, change) between two runs of (query, rank): broken, fixed, worse, better or same."""
    b = before.select("query", F.col("rank").alias("b"))
    a = after.select("query", F.col("rank").alias("a"))
    change = (
        F.when(F.col("b").isNotNull() & F.col("a").isNull(), "broken")
        .when(F.col("b").isNull() & F.col("a").isNotNull(), "fixed")
        .when(F.col("a") > F.col("b"), "worse")
        .when(F.col("a") < F.col("b"), "better")
        .otherwise("same")
    )
    return b.join(a, "query", "full_outer").select("query", change.alias("change"))


def audit(dataset: DataFrame, paths: DataFrame, least: int = 20, share: int = 10) -> DataFrame:
    """(line, problem, detail, n): what keeps a question set from telling right documents from wrong ones.

    ``dataset`` (line, question, expect_files, expect_text, reject_files,
    reject_text) is held against all ``paths`` (rel_path).  Problems of a line:
    ``duplicate`` (n: the last earlier line of the same question in any case),
    ``no_expects``, ``dead`` (a pattern that no path holds) and ``broad`` (one in n
    paths, over ``least`` and over a ``share``-th of all).  Problems of the set
    have no line: ``no_texts`` (n questions that check no answer) and ``no_rejects``.
    """
    full = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    rows = written(dataset)
    asked = rows.select("line", F.lower(F.btrim(F.coalesce("question", F.lit("")))).alias("asked"))
    before = asked.withColumn("n", F.lag("line").over(Window.partitionBy("asked").orderBy("line"))).where("n IS NOT NULL")
    wanted = rows.select("line", F.explode("expect_files").alias("detail")).withColumn("pattern", F.lower("detail"))
    hits = patterns.counted(wanted, patterns.held(paths.select("rel_path"), "rel_path", wanted, any_case=True))
    total = paths.where("rel_path IS NOT NULL").agg(F.count(F.lit(1)).alias("total")).scalar()
    broad = F.col("n") > F.greatest(F.lit(least).cast("long"), F.floor(total / share))
    problem = F.when((F.col("n") == 0) & (total > 0), "dead").when(broad, "broad")
    files = wanted.join(hits, "pattern").select("line", problem.alias("problem"), "detail", "n").where("problem IS NOT NULL")
    whole = rows.agg(
        F.count_if(~full("expect_text") & ~full("reject_text")).alias("no_texts"), F.count_if(full("reject_files") | full("reject_text")).alias("rejects")
    )
    line, none = F.lit(None).cast(rows.schema["line"].dataType).alias("line"), F.lit(None).cast("string").alias("detail")
    out = before.select("line", F.lit("duplicate").alias("problem"), none, F.col("n").cast("long").alias("n"))
    out = out.unionByName(rows.where(~full("expect_files")).select("line", F.lit("no_expects").alias("problem"), none, F.lit(0).cast("long").alias("n")))
    out = out.unionByName(files)
    out = out.unionByName(whole.where("no_texts > 0").select(line, F.lit("no_texts").alias("problem"), none, F.col("no_texts").alias("n")))
    return out.unionByName(whole.where("rejects = 0").select(line, F.lit("no_rejects").alias("problem"), none, F.lit(0).cast("long").alias("n")))


# fixed values: the signature of a model, and what stands for a neighbour's
SIGNATURE = r"\d+(?:[.,]\d+)?(?:[/\-]\d+(?:[.,]\d+)?)+"
NEIGHBOUR = "«МОДЕЛЬ-СОСЕД»"


def twins(dataset: DataFrame) -> DataFrame:
    """Of every question one for a neighbouring model: its signatures and expectations become what the answer must not hold."""
    asked = F.coalesce("question", F.lit(""))
    none = F.array().cast("array<string>")
    own = lambda c: F.coalesce(c, none)
    return dataset.select(
        "line", F.regexp_replace(asked, SIGNATURE, NEIGHBOUR).alias("question"), none.alias("expect_files"), none.alias("expect_text"),
        own("expect_files").alias("reject_files"), F.concat(own("expect_text"), F.regexp_extract_all(asked, F.lit(SIGNATURE), F.lit(0))).alias("reject_text"),
    )


def neighbours(signatures: DataFrame) -> DataFrame:
    """(a, b): all pairs of different ``signature``s at one edit, both ways.

    Two texts at one edit share the text itself or what is left of each without
    one character, so pairs meet on these and are then held against the edit
    distance; no text meets all others.
    """
    own = signatures.select("signature").where("signature IS NOT NULL").distinct()
    less = F.transform(F.sequence(F.lit(1), F.length("signature")), lambda k: F.concat(F.substring("signature", F.lit(1), k - 1), F.substring("signature", k + 1, F.length("signature"))))
    keys = own.select("signature", F.explode(F.array_distinct(F.concat(F.array("signature"), F.when(F.length("signature") > 0, less).otherwise(F.array().cast("array<string>"))))).alias("key"))
    keys = written(keys)
    pairs = keys.select(F.col("signature").alias("a"), "key").join(keys.select(F.col("signature").alias("b"), "key"), "key").where("a <> b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") == 1)


def sweep(candidates: DataFrame, truth: DataFrame, weights: list[float], alphas: list[float], tops: list[int]) -> DataFrame:
    """(weight, alpha, top, hit, mrr, best): how settings of the ranking do on one set of candidates.

    ``candidates`` (query, doc_id, base, fresh, rr) are searched once: every variant is
    a mix of the base score, aged by ``alpha`` (``fresh`` from 0 to 1), and the re-ranker's
    ``rr`` (weight 0: none), so all share postings, candidates and one shuffle by question.  ``best`` marks the
    greatest mrr, ties by smaller weight, greater alpha, smaller top.
    """
    settings = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(float(a)).alias("alpha")) for w in weights for a in alphas])).alias("s")
    rows = candidates.select("query", "doc_id", "base", "fresh", "rr", settings).select("query", "doc_id", "s.weight", "s.alpha", "base", "fresh", "rr")
    rows = rows.withColumn("aged", F.col("alpha") * F.col("base") + (1 - F.col("alpha")) * F.col("base") * F.col("fresh") * 2)
    own = Window.partitionBy("query", "weight", "alpha")
    lo, hi = F.min("aged").over(own), F.max("aged").over(own)
    flat = F.when(hi > lo, (F.col("aged") - lo) / (hi - lo)).otherwise(0.5)
    mix = (1 - F.col("weight")) * flat + F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rr")))
    placed = rows.withColumn("mix", F.round(mix, 6)).withColumn("place", F.row_number().over(own.orderBy(F.desc("mix"), "doc_id")))
    first = placed.join(truth, ["query", "doc_id"], "left_semi").groupBy("query", "weight", "alpha").agg(F.min("place").alias("place"))
    asked = truth.agg(F.countDistinct("query").alias("n")).scalar()
    each = F.explode(F.array(*[F.lit(k) for k in tops])).alias("top")
    inside = F.col("place") <= F.col("top")
    sums = first.select("weight", "alpha", "place", each).groupBy("weight", "alpha", "top").agg(F.count_if(inside).alias("hits"), F.sum(F.when(inside, 1.0 / F.col("place")).otherwise(0.0)).alias("gain"))
    out = sums.select("weight", "alpha", "top", F.round(F.col("hits") / asked, 3).alias("hit"), F.round(F.col("gain") / asked, 3).alias("mrr"))
    first_of = F.row_number().over(Window.orderBy(F.desc("mrr"), "weight", F.desc("alpha"), "top"))  # a row a variant
    return out.withColumn("best", first_of == 1)
