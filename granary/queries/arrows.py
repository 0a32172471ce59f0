"""Queries on functions that run in Arrow batches or fold in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import arrow as ar
from granary.functions import text as tx
from granary.operators import retention
from granary.queries.registry import query
from granary.streaming import segments as sg


@query("txt_13", "SELECT p_partkey, nfc_normalize('e' || chr(769) || p_name) AS name FROM part")
def txt_13(t):
    return t.part.select("p_partkey", ar.nfc(F.concat(F.lit("é"), "p_name")).alias("name"))


@query(
    "win_10",
    """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value / 10 AS b FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS i FROM s),
nx AS (SELECT x.user_id, x.i, x.a, min(y.i) AS j FROM i x LEFT JOIN i y ON y.user_id = x.user_id AND y.i >= x.i AND y.b - x.a >= 86400 GROUP BY 1, 2, 3),
g AS (SELECT user_id, i, a, j FROM nx WHERE i = 1 UNION ALL SELECT nx.user_id, nx.i, nx.a, nx.j FROM g JOIN nx ON nx.user_id = g.user_id AND nx.i = g.j + 1),
l AS (SELECT user_id, max(i) AS last FROM i GROUP BY user_id)
SELECT g.user_id, round(g.a, 3) AS first, round(e.b, 3) AS last, coalesce(g.j, l.last) - g.i + 1 AS n FROM g JOIN l USING (user_id) JOIN i e ON e.user_id = g.user_id AND e.i = coalesce(g.j, l.last)""",
)
def win_10(t):
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    segments = t.events.select("user_id", us.alias("start"), (us + F.col("value") / 10).alias("end"))
    return sg.grouped(segments, "user_id", 86_400.0).select("user_id", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")


@query("src_10", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'п' || p_name END AS text FROM part")
def src_10(t):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.encode("p_name", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("EF")), F.encode("p_name", "UTF-8")))
    return t.part.select("p_partkey", ar.decode_text(raw).alias("text"))


@query("vec_01")
def vec_01(t):
    return t.documents.select("doc_id", ar.hash_embedding(F.col("text")).alias("embedding"))


@query(
    "win_09",
    """WITH e AS (SELECT event_id, user_id, ts, floor(epoch(max(ts) OVER ()) / 86400 - epoch(ts) / 86400 + 1e-9) AS age FROM events),
d AS (SELECT *, age <= 7 AND row_number() OVER (PARTITION BY user_id, age <= 7, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1 AS day FROM e),
w AS (SELECT *, NOT day AND age <= 14 AND row_number() OVER (PARTITION BY user_id, NOT day AND age <= 14, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) = 1 AS week FROM d),
m AS (SELECT *, NOT day AND NOT week AND age <= 62 AND row_number() OVER (PARTITION BY user_id, NOT day AND NOT week AND age <= 62, date_trunc('month', ts) ORDER BY ts DESC, event_id DESC) = 1 AS month FROM w)
SELECT event_id, CASE WHEN day THEN 'day' WHEN week THEN 'week' WHEN month THEN 'month' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'newest' END AS kept_for FROM m""",
)
def win_09(t):
    copies = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    dated = copies.crossJoin(F.broadcast(copies.agg(F.max("ts").alias("as_of"))))  # one row
    return retention.rolling(dated, "user_id", "ts", "event_id", F.col("as_of"), 7, 2, 2).select("event_id", "kept_for")


@query(
    "txt_29",
    """SELECT p_partkey, '• ' || p_name || ' — арт. ' || p_partkey || ', ' || replace(format('{:,.2f}', p_retailprice), ',', ' ') || ' ₽'
|| E'\\n   type: ' || p_type || '; size: ' || p_size AS line FROM part""",
)
def txt_29(t):
    attributes = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    line = tx.product_line(F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_retailprice"), F.lit(None).cast("string"), attributes)
    return t.part.select("p_partkey", line.alias("line"))
