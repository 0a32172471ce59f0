"""Site maps, robot rules and a breadth-first crawl over stored pages; question sets as JSON lines; graphs as JSON."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.tables import written

#: one question a line; lines that begin with // are comments
QUESTION = "question string, expect_files array<string>, expect_text array<string>, reject_files array<string>, reject_text array<string>"


def sitemap_links(xml: Column) -> Column:
    """The addresses a site map lists."""
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def allowed(robots: Column, url: Column, agent: str) -> Column:
    """Whether robot rules (text; null allows all) let ``agent`` fetch an address."""

    @F.pandas_udf(T.BooleanType())
    def check(rules: pd.Series, urls: pd.Series) -> pd.Series:
        read: dict[str | None, RobotFileParser] = {}
        out = []
        for text, u in zip(rules, urls):
            if text not in read:
                read[text] = RobotFileParser()
                read[text].parse((text or "").splitlines())
            out.append(read[text].can_fetch(agent, u))
        return pd.Series(out, dtype="bool")

    return check(robots, url)


def crawl(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(url, depth) reached from seeds (url) over links (src, dst), breadth first, ties by address, at most ``most`` (the visit cap)."""
    seen = written(seeds.select("url").distinct().orderBy("url").limit(most).withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        last = seen.where(F.col("depth") == depth)
        left = most - seen.count()
        new = last.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        new = written(new.orderBy("url").limit(max(left, 0)).withColumn("depth", F.lit(depth + 1)))
        if new.isEmpty():
            return seen
        seen, depth = written(seen.unionByName(new)), depth + 1


def questions(lines: DataFrame) -> DataFrame:
    """Rows of ``QUESTION`` from text lines (value); blanks and comments go, a line that is no JSON gives nulls."""
    said = lines.select(F.btrim("value").alias("line")).where("line <> '' AND NOT startswith(line, '//')")
    return said.select(F.from_json("line", QUESTION).alias("q")).select("q.*")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions(spark.read.text(path))


def payload(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, graph): the graph of each group as compact JSON; both tables have the column ``by``; nodes have ``id``, edges ``a`` and ``b``."""
    n = nodes.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in nodes.columns if c != by]))).alias("nodes"))
    e = edges.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in edges.columns if c != by]))).alias("edges"))
    return n.join(e, by, "left").select(by, F.to_json(F.struct("nodes", F.coalesce("edges", F.array()).alias("edges"))).alias("graph"))
