"""How a question is answered: by a curated answer, the price lists, the documents or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import ARTICLE, PRICE_QUESTION, articles
from granary.operators.tables import written

# fixed values: products of an answer, the least confidence of documents
PRODUCTS, CONFIDENCE = 8, 0.08


def asks_price(question: Column) -> Column:
    """Whether the question is for a price, or names an article."""
    return question.rlike(PRICE_QUESTION) | question.rlike(ARTICLE)


def product_matches(questions: DataFrame, products: DataFrame, most: int = PRODUCTS) -> DataFrame:
    """(id, product, file, n): at most ``most`` products of each question (id, question) for a price, by its articles in order.

    ``products`` has (product, article, file).  An article found as it stands (in any case) counts; only if it is not, its
    variants "article.x" do.
    """
    asked = questions.where(asks_price(F.col("question"))).select("id", F.posexplode(articles(F.col("question"))).alias("place", "article")).withColumn("article", F.lower("article"))
    asked = written(asked)
    own = products.select("product", "file", F.lower("article").alias("article"))
    exact = asked.join(own, "article").withColumn("product_article", F.col("article"))
    rest = asked.join(exact.select("id", "place").distinct(), ["id", "place"], "left_anti")
    cut = own.where(F.contains("article", F.lit("."))).select("product", "file", F.col("article").alias("product_article"), F.explode(_stems("article")).alias("article"))
    variants = rest.join(cut, "article")
    both = exact.unionByName(variants).groupBy("id", "product", "file").agg(F.min(F.struct("place", "product_article")).alias("at"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("at", "product"))
    return both.withColumn("n", n).where(F.col("n") <= most).select("id", "product", "file", "n")


def _stems(article: str) -> Column:
    """What stands before each full stop of an article."""
    parts = F.split(article, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def routed(questions: DataFrame, golden: DataFrame, products: DataFrame, hits: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """(id, route, stage, confidence) of every question (id).

    Each question leaves at its first hit: a curated answer (``golden``: id),
    products (id), documents (``hits``: id, doc_id, score, rank) of a confidence of ``least``
    or more; what has documents but less confidence is answered by none of them, the rest found nothing.
    """
    found = hits.groupBy("id").agg(F.max("score").alias("confidence"))
    left = written(questions.select("id").join(found, "id", "left"))
    out = None
    for route, sure in (("golden", golden), ("price", products)):
        sure = sure.select("id").distinct()
        taken = left.join(sure, "id", "left_semi").select("id", F.lit(route).alias("route"), F.lit("answered").alias("stage"), "confidence")
        left = left.join(sure, "id", "left_anti")
        out = taken if out is None else out.unionByName(taken)
    stage = F.when(F.col("confidence").isNull(), "nothing_found").when(F.col("confidence") < least, "low_confidence").otherwise("answered")
    route = F.when(F.col("confidence").isNull(), "none").otherwise("documents")
    return out.unionByName(left.select("id", route.alias("route"), stage.alias("stage"), "confidence"))


def sources(routes: DataFrame, products: DataFrame, hits: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """(id, n, kind, source) of every answered question's numbered sources: files of prices first, then documents.

    Files come in the order of their first product; documents in theirs, and only if they are sure enough.
    """
    open_ = routes.where("stage = 'answered' AND route <> 'golden'")
    files = products.join(open_.where("route = 'price'").select("id"), "id", "left_semi").groupBy("id", F.col("file").alias("source")).agg(F.min("n").alias("at"))
    docs = hits.join(open_.where(F.col("confidence") >= least).select("id"), "id", "left_semi").select("id", F.col("doc_id").cast("string").alias("source"), F.col("rank").alias("at"))
    both = files.select("id", F.lit("price").alias("kind"), "source", "at").unionByName(docs.select("id", F.lit("document").alias("kind"), "source", "at"))
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.when(F.col("kind") == "price", 0).otherwise(1), "at", "source"))
    return both.select("id", n.alias("n"), "kind", "source")
