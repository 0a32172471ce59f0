"""Document graph and clustering: edges, roll-ups, connected components, question groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.tables import written


def chain_edges(docs: DataFrame, folder: str, node: str, most: int = 60, weight: float = 0.2) -> DataFrame:
    """Edges between documents that follow on each other in a folder, among its first ``most``."""
    w = Window.partitionBy(folder).orderBy(node)
    ranked = docs.select(folder, node, F.row_number().over(w).alias("r")).where(F.col("r") <= most)
    return ranked.withColumn("b", F.lead(node).over(w)).where("b IS NOT NULL").select(F.col(node).alias("a"), "b", F.lit(weight).alias("w"))


#: levels of the graph, from the coarsest to single documents
LEVELS = ("section", "brand", "category", "doc")


def _keys() -> Column:
    """(level, key) of a node at every level."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = {"section": text("section"), "brand": F.concat(text("section"), F.lit(" / "), text("brand")), "category": text("category"), "doc": text("id")}
    return F.array(*[F.struct(F.lit(x).alias("level"), keys[x].alias("key")) for x in LEVELS])


def level_nodes(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(level, key, n, and each of ``sums`` added up) of all four levels, by grouping sets over one pass of ``nodes`` (id, section, brand, category, sums)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = nodes.select(text("id"), text("section"), text("brand"), text("category"), *sums)
    sets = [["section"], ["section", "brand"], ["category"], ["id"]]
    grouped = rows.groupingSets(sets, "id", "section", "brand", "category").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    # bits of (id, section, brand, category) that a set leaves out
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0b1011, "section", 0b1001, "brand", 0b1110, "category", 0b0111, "doc")]), F.col("g").cast("int"))
    key = F.when(level == "section", F.col("section")).when(level == "brand", F.concat("section", F.lit(" / "), "brand")).when(level == "category", F.col("category")).otherwise(F.col("id"))
    return grouped.select(level.alias("level"), key.alias("key"), "n", *sums)


def level_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, a, b, n, w): edges (a, b, w) between the groups of every level, undirected, without loops.

    Both ends get their keys once; each edge then counts at the levels at which they differ.
    """
    side = lambda x: nodes.select(F.col("id").alias(x), _keys().alias(f"k{x}"))
    both = edges.select("a", "b", "w").join(side("a"), "a").join(side("b"), "b")
    pairs = F.explode(F.zip_with("ka", "kb", lambda x, y: F.struct(x["level"].alias("level"), F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))).alias("p")
    return both.select("w", pairs).where("p.a <> p.b").groupBy("p.level", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): each node's least reachable node, by label exchange until nothing changes.

    Labels jump along labels each round, so long chains take few rounds.  Each
    round is a written table.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = written(both)
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label")
    labels = written(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("j"))
        new = labels.join(near, "node").join(jump, "label", "left").select("node", F.least("label", "m", F.coalesce("j", "label")).alias("label"), F.col("label").alias("old"))
        new = written(new)
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def weighted_terms(terms: DataFrame) -> DataFrame:
    """(id, term, w, df) of questions (id, term; distinct): weight ln(n / (1 + df)) + 1."""
    n = terms.agg(F.countDistinct("id").alias("n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(df.join(F.broadcast(n)).select("term", "df", (F.ln(F.col("n") / (1 + F.col("df"))) + 1).alias("w")), "term").select("id", "term", "w", "df")


def question_pairs(terms: DataFrame, least: float = 0.45) -> DataFrame:
    """(a, b, sim) of questions (id, term; distinct): shared weight over the smaller total, a < b, ``sim`` at least ``least``.

    A pair shares ``least`` of the lighter question's weight only if they share one of
    its rarer terms: those before what is left weighs less.  So only these are
    joined with all terms, and common terms make no pairs.
    """
    own = written(weighted_terms(terms))
    total = own.groupBy("id").agg(F.sum("w").alias("total"))
    rest = F.sum("w").over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")))
    rare = own.withColumn("rest", rest).join(total, "id").where(F.col("rest") >= least * F.col("total") - 1e-9).select(F.col("id").alias("u"), "term", F.col("total").alias("tu"))
    other = own.join(total, "id").select(F.col("id").alias("v"), "term", F.col("total").alias("tv"))
    heavier = (F.col("tv") > F.col("tu")) | ((F.col("tv") == F.col("tu")) & (F.col("v") > F.col("u")))
    found = rare.join(other, "term").where(heavier).select("u", "v", "tu").distinct()
    mine, theirs = own.select(F.col("id").alias("u"), "term", "w"), own.select(F.col("id").alias("v"), "term")
    shared = found.join(mine, "u").join(theirs, ["v", "term"]).groupBy("u", "v", "tu").agg(F.sum("w").alias("shared"))
    sim = F.col("shared") / F.col("tu")
    return shared.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), sim.alias("sim")).where(F.col("sim") >= least)


def cluster_summaries(clusters: DataFrame, questions: DataFrame, weights: DataFrame, stages: list[str], terms: int = 6) -> DataFrame:
    """(cluster, size, top, a column for each stage, last_at) of clusters (id, cluster).

    ``questions`` has (id, stage, at), ``weights`` (id, term, w).  ``top`` are the ``terms`` heaviest words of the cluster, ties by word.
    """
    own = clusters.join(weights, "id").groupBy("cluster", "term").agg(F.round(F.sum("w"), 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    best = own.withColumn("r", place).where(F.col("r") <= terms).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t"))
    counts = clusters.join(questions, "id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.count_if(F.col("stage") == s).alias(s) for s in stages], F.max("at").alias("last_at")
    )
    return counts.join(best, "cluster").select("cluster", "size", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("top"), *stages, "last_at")
