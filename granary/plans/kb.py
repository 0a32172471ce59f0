"""The knowledge-base relations, as views of the given tables.

Each has a twin in SQL text (``*_SQL``) that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC_TYPES = ("price list", "catalogue", "passport", "certificate", "manual")


def questions(events: DataFrame) -> DataFrame:
    """Asked questions: an event's type tells how its answer went."""
    stage = (
        F.when(F.col("event_type") == "error", "nothing_found")
        .when(F.col("event_type") == "view", "low_confidence")
        .when(F.col("event_type") == "click", "answered")
    )
    return events.where(F.col("event_type").isin("error", "view", "click")).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.col("value"),
        stage.alias("stage"),
        (F.col("event_type") == "click").alias("answered"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


QUESTIONS_SQL = """q AS (SELECT event_id AS id, user_id, ts AS created_at, value,
  CASE event_type WHEN 'error' THEN 'nothing_found' WHEN 'view' THEN 'low_confidence' WHEN 'click' THEN 'answered' END AS stage,
  event_type = 'click' AS answered, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events WHERE event_type IN ('error', 'view', 'click'))"""


def feedback(events: DataFrame) -> DataFrame:
    """Verdicts: each is on the event before it."""
    return events.where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("id"),
        (F.col("event_id") - 1).alias("query_id"),
        "user_id",
        F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("verdict"),
    )


FEEDBACK_SQL = """fb AS (SELECT event_id AS id, event_id - 1 AS query_id, user_id,
  CASE event_type WHEN 'purchase' THEN 'up' ELSE 'down' END AS verdict
  FROM events WHERE event_type IN ('purchase', 'signup'))"""


def library(documents: DataFrame) -> DataFrame:
    """The document register, with path, type, dates and version keys derived from the id."""
    kinds = F.array(*[F.lit(x) for x in DOC_TYPES])
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit("_v2 01.02.2021.txt"))).alias("rel_path"),
        F.col("source").alias("brand"),
        F.col("lang").alias("section"),
        F.col("n_chars").alias("text_chars"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("doc_type"),
        F.when(F.col("doc_id") % 7 != 0, F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("doc_id") % 1500).cast("int"))).alias("effective_date"),
        F.concat_ws("|", "source", "lang", (F.col("doc_id") % 3).cast("string")).alias("version_key"),
        F.when(F.col("n_chars") >= 60, "ok").otherwise("error").alias("status"),
    )


LIBRARY_SQL = """d AS (SELECT doc_id AS id, source || '/' || lang || '/Doc_' || doc_id || '_v2 01.02.2021.txt' AS rel_path,
  source AS brand, lang AS section, n_chars AS text_chars, text, sha256(text) AS content_hash,
  ['price list', 'catalogue', 'passport', 'certificate', 'manual'][CAST(doc_id % 5 AS INTEGER) + 1] AS doc_type,
  CASE WHEN doc_id % 7 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) END AS effective_date,
  source || '|' || lang || '|' || (doc_id % 3) AS version_key,
  CASE WHEN n_chars >= 60 THEN 'ok' ELSE 'error' END AS status FROM documents)"""
