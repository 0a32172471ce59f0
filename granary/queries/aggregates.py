"""AGG and WIN queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import analytics as an
from granary.operators.common import floor_quantiles, newest
from granary.plans import kb
from granary.queries.registry import Tables, query

Q, FB, D = kb.QUESTIONS_SQL, kb.FEEDBACK_SQL, kb.LIBRARY_SQL


def q(t: Tables):
    return kb.questions(t.events)


def fb(t: Tables):
    return kb.feedback(t.events)


def lib(t: Tables):
    return kb.library(t.documents)


@query("agg_01", f"""WITH {Q}, {FB}, r AS (SELECT query_id, max(CASE verdict WHEN 'up' THEN 1 ELSE 0 END) AS up FROM fb GROUP BY query_id),
o AS (SELECT count(*) AS total, count(*) FILTER (stage <> 'nothing_found') AS found, count(*) FILTER (stage = 'answered') AS confident,
 count(*) FILTER (answered) AS answered, count(r.query_id) AS rated, count(*) FILTER (up = 1) AS good FROM q LEFT JOIN r ON q.id = r.query_id),
s AS (SELECT 0 AS ord, 'total' AS step, total AS n, total, NULL AS before FROM o UNION ALL SELECT 1, 'found', found, total, total FROM o
 UNION ALL SELECT 2, 'confident', confident, total, found FROM o UNION ALL SELECT 3, 'answered', answered, total, confident FROM o
 UNION ALL SELECT 4, 'rated', rated, total, answered FROM o UNION ALL SELECT 5, 'good', good, total, rated FROM o)
SELECT CAST(ord AS BIGINT) AS ord, step, n, round(CASE WHEN total > 0 THEN n / total ELSE 0 END, 3) AS share,
 round(CASE WHEN before IS NULL THEN (CASE WHEN total > 0 THEN n / total ELSE 0 END) WHEN before > 0 THEN n / before ELSE 0 END, 3) AS kept,
 coalesce(before - n, 0) AS lost,
 CASE WHEN step IN ('found', 'confident', 'answered') THEN n < before WHEN step = 'rated' THEN n < 0.05 * before ELSE FALSE END AS loss FROM s""")
def agg_01(t):
    return an.funnel(q(t), fb(t))


@query("agg_02", f"WITH {Q} SELECT stage, count(*) AS n, count(*) FILTER (answered) AS ok, round(avg(value), 4) AS avg_ms, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM q GROUP BY stage")
def agg_02(t):
    return an.breakdown(q(t), "stage")


SCORES = f"{Q}, {FB}, lv AS (SELECT query_id, arg_max(verdict, id) AS verdict FROM fb GROUP BY query_id), sc AS (SELECT value AS score, verdict FROM q LEFT JOIN lv ON q.id = lv.query_id WHERE value > 0)"


def scores(t):
    verdicts = an.latest_verdict(fb(t))
    return q(t).join(verdicts, F.col("id") == F.col("query_id"), "left").where("value > 0").select(F.col("value").alias("score"), "verdict")


@query("agg_03", f"""WITH {SCORES}, e AS (SELECT min(score) AS lo, CASE WHEN max(score) > min(score) THEN max(score) ELSE min(score) + 1e-6 END AS hi FROM sc),
b AS (SELECT least(CAST(floor((score - lo) / ((hi - lo) / 24)) AS BIGINT), 23) AS bin, verdict FROM sc, e)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 24), 6) AS "from", count(b.bin) AS n, count(*) FILTER (verdict = 'up') AS up, count(*) FILTER (verdict = 'down') AS down
FROM (SELECT unnest(range(24)) AS bin) g CROSS JOIN e LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin, lo, hi""")
def agg_03(t):
    return an.histogram(scores(t))


@query("agg_04", f"""WITH {SCORES}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM sc),
g AS (SELECT unnest([0,1,2,3,4,5]) AS k, unnest([0.05::DOUBLE,0.10,0.15,0.20,0.30,0.40]) AS qv),
c AS (SELECT round(score, 5) AS threshold, min(k) AS k FROM r, g WHERE i = least(CAST(floor(n * qv) AS BIGINT), n - 1) GROUP BY 1),
f AS (SELECT threshold, k, count(*) FILTER (score < threshold) AS cuts, count(*) FILTER (score < threshold AND verdict = 'up') AS cuts_good,
 count(*) FILTER (score < threshold AND verdict = 'down') AS cuts_bad FROM sc, c GROUP BY threshold, k)
SELECT threshold, cuts, cuts_good, cuts_bad, cuts_good + cuts_bad > 0 AND
 row_number() OVER (ORDER BY CASE WHEN cuts_good + cuts_bad > 0 THEN cuts_bad - 3 * cuts_good END DESC NULLS LAST, k) = 1 AS best FROM f""")
def agg_04(t):
    return an.threshold_advice(scores(t))


@query("agg_05", f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM sc)
SELECT max(score) FILTER (i = n // 2) AS median, min(score) AS least, max(score) AS most, count(*) FILTER (score < 20) AS below,
 count(*) FILTER (score < 20 AND verdict = 'up') AS good_below, count(*) FILTER (score >= 20 AND verdict = 'down') AS bad_above FROM r""")
def agg_05(t):
    return an.score_summary(scores(t), 20.0)


@query("agg_06", f"""WITH {Q}, c AS (SELECT CASE k % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' WHEN 2 THEN 'bm25,dense' END AS channels, value FROM q)
SELECT coalesce(channels, '—') AS channels, count(*) AS n, round(avg(value), 4) AS avg_score, round(count(*) / sum(count(*)) OVER (), 4) AS share,
 CASE WHEN count(*) / sum(count(*)) OVER () < 0.03 THEN 'useless' WHEN count(*) / sum(count(*)) OVER () < 0.15 THEN 'weak' ELSE 'works' END AS verdict FROM c GROUP BY 1""")
def agg_06(t):
    k = F.col("k") % 4
    return an.channel_shares(q(t).withColumn("channels", F.when(k == 0, "bm25").when(k == 1, "dense").when(k == 2, "bm25,dense")))


@query("agg_07", f"""WITH {D} SELECT brand, count(*) FILTER (doc_type = 'price list') AS price_list, count(*) FILTER (doc_type = 'catalogue') AS catalogue,
 count(*) FILTER (doc_type = 'passport') AS passport, count(*) FILTER (doc_type = 'certificate') AS certificate, count(*) FILTER (doc_type = 'manual') AS manual,
 array_to_string(list_sort(list_filter(['price list', 'catalogue', 'passport', 'certificate', 'manual'], lambda x: NOT list_contains(list(DISTINCT doc_type), x))), ',') AS missing
 FROM d WHERE status = 'ok' GROUP BY brand""")
def agg_07(t):
    ok = lib(t).where("status = 'ok'")
    counts = ok.groupBy("brand").pivot("doc_type", list(kb.DOC_TYPES)).count().fillna(0).withColumnRenamed("price list", "price_list")
    have = ok.groupBy("brand").agg(F.collect_set("doc_type").alias("have"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in kb.DOC_TYPES]), "have")), ",")
    return counts.join(have.select("brand", missing.alias("missing")), "brand")


@query("agg_08", f"WITH {D} SELECT content_hash, count(*) AS n, count(*) - 1 AS extra, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM d GROUP BY content_hash HAVING count(*) > 1")
def agg_08(t):
    return lib(t).groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - 1).alias("extra"),
        F.array_join(F.array_sort(F.collect_list("rel_path")), "|").alias("paths"),
    ).where("n > 1")


@query("agg_11", f"""WITH {D} SELECT version_key, count(*) AS n, string_agg(rel_path || ' [' || coalesce(CAST(effective_date AS VARCHAR), '—') || ']', '; ' ORDER BY rel_path) AS paths
 FROM d WHERE status = 'ok' GROUP BY version_key HAVING count(*) > 1""")
def agg_11(t):
    item = F.concat("rel_path", F.lit(" ["), F.coalesce(F.col("effective_date").cast("string"), F.lit("—")), F.lit("]"))
    return lib(t).where("status = 'ok'").groupBy("version_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_path", item.alias("i")))), lambda x: x["i"]), "; ").alias("paths"),
    ).where("n > 1")


@query("agg_12", """SELECT CAST(floor(quantile_cont(n_chars, 0.5)) AS BIGINT) AS median, CAST(floor(quantile_cont(n_chars, 0.05)) AS BIGINT) AS p05,
 CAST(floor(quantile_cont(n_chars, 0.95)) AS BIGINT) AS p95, count(*) FILTER (n_chars < 150) AS short, count(*) FILTER (n_chars > 4000) AS long FROM documents""")
def agg_12(t):
    at = lambda p: F.floor(F.percentile("n_chars", p)).cast("long")
    return t.documents.agg(
        at(F.lit(0.5)).alias("median"), at(F.lit(0.05)).alias("p05"), at(F.lit(0.95)).alias("p95"),
        F.count_if(F.col("n_chars") < 150).alias("short"), F.count_if(F.col("n_chars") > 4000).alias("long"),
    )


@query("agg_13", """SELECT count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS asr, count(*) FILTER (doc_id % 3 = 0) AS vision, count(*) FILTER (doc_id % 5 = 0) AS ocr,
 count(*) FILTER (doc_id % 6 = 0) AS asr_vision, count(*) FILTER (n_chars = 0) AS empty, count(*) FILTER (lang IS NULL) AS no_lang,
 count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (n_chars > 1000) AS long FROM documents""")
def agg_13(t):
    marks = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "asr"), F.when(F.col("doc_id") % 3 == 0, "vision"), F.when(F.col("doc_id") % 5 == 0, "ocr")), lambda x: x.isNotNull())
    has = lambda m: F.array_contains("enriched", m)
    return t.documents.withColumn("enriched", marks).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has("asr")).alias("asr"), F.count_if(has("vision")).alias("vision"),
        F.count_if(has("ocr")).alias("ocr"), F.count_if(has("asr") & has("vision")).alias("asr_vision"),
        F.count_if(F.col("n_chars") == 0).alias("empty"), F.count_if(F.col("lang").isNull()).alias("no_lang"),
        F.count_if(F.col("source").isNull()).alias("no_source"), F.count_if(F.col("n_chars") > 1000).alias("long"),
    )


@query("agg_14", """SELECT coalesce(event_type, '(all)') AS model, count(*) AS calls, round(sum(value), 3) AS total_ms, round(avg(value), 3) AS avg_ms, max(value) AS max_ms,
 sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / (sum(value) / 1000), 3) AS tokens_per_s
 FROM events GROUP BY ROLLUP (event_type)""")
def agg_14(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.rollup("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 3).alias("total_ms"), F.round(F.avg("value"), 3).alias("avg_ms"),
        F.max("value").alias("max_ms"), F.sum("k").alias("tokens"), F.round(F.sum("k") / (F.sum("value") / 1000), 3).alias("tokens_per_s"),
    ).select(F.coalesce("event_type", F.lit("(all)")).alias("model"), "calls", "total_ms", "avg_ms", "max_ms", "tokens", "tokens_per_s")


@query("agg_15", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = least(CAST(floor(n * 0.5::DOUBLE) AS BIGINT), n - 1)) AS p50, max(value) FILTER (i = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) AS p95,
 max(value) FILTER (i = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)) AS p99, count(*) AS n, round(avg(value), 4) AS mean FROM r GROUP BY event_type""")
def agg_15(t):
    ps = floor_quantiles(t.events, "value", [0.5, 0.95, 0.99], ["event_type"])
    return ps.join(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")), "event_type")


@query("agg_15_hour", f"WITH {Q} SELECT CAST(hour(created_at) AS BIGINT) AS hour, count(*) AS n, round(count(*) FILTER (answered) / count(*), 4) AS rate FROM q GROUP BY 1")
def agg_15_hour(t):
    return q(t).groupBy(F.hour("created_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("answered") / F.count(F.lit(1)), 4).alias("rate"))


@query("agg_16", f"""WITH {Q}, {D}, s AS (SELECT q.id, unnest([q.id % 100, (q.id * 7) % 100]) AS doc FROM q)
SELECT split_part(d.rel_path, '/', 1) AS section, count(*) AS hits FROM s JOIN d ON d.id = s.doc GROUP BY 1""")
def agg_16(t):
    used = q(t).select(F.explode(F.array(F.col("id") % 100, (F.col("id") * 7) % 100)).alias("doc"))
    return used.join(lib(t), F.col("doc") == F.col("id")).groupBy(F.split("rel_path", "/")[0].alias("section")).agg(F.count(F.lit(1)).alias("hits"))


@query("agg_17", f"""WITH {D} SELECT section, count(*) AS docs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(DISTINCT brand) AS brands,
 count(DISTINCT content_hash) AS contents, sum(text_chars)::BIGINT AS chars, count(*) FILTER (effective_date IS NULL) AS undated, max(text_chars) AS longest FROM d GROUP BY section""")
def agg_17(t):
    return lib(t).groupBy("section").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"),
        F.countDistinct("brand").alias("brands"), F.countDistinct("content_hash").alias("contents"), F.sum("text_chars").alias("chars"),
        F.count_if(F.col("effective_date").isNull()).alias("undated"), F.max("text_chars").alias("longest"),
    )


@query("agg_18", f"WITH {D} SELECT brand, count(*) AS docs FROM d WHERE brand NOT IN (SELECT 'src' || r_regionkey FROM region) GROUP BY brand")
def agg_18(t):
    roles = t.region.select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("brand"))
    return lib(t).join(roles, "brand", "left_anti").groupBy("brand").agg(F.count(F.lit(1)).alias("docs"))


@query("agg_19", r"""SELECT substr(split_part(trim(text, E' \n'), E'\n', 1), 1, 160) AS error, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, error LIMIT 12""")
def agg_19(t):
    first = F.substring(F.split(F.btrim("text", F.lit(" \n")), "\n")[0], 1, 160)
    return t.documents.where("text IS NOT NULL").groupBy(first.alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(12)


@query("agg_20", """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, count(*) AS total, round(avg(value), 4) AS avg_wait, max(value) FILTER (i = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) AS p95,
 count(*) FILTER (event_type = 'error') AS refused FROM r GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10""")
def agg_20(t):
    g = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("value"), 4).alias("avg_wait"), F.count_if(F.col("event_type") == "error").alias("refused"))
    return g.join(floor_quantiles(t.events, "value", [0.95], ["user_id"]), "user_id").orderBy(F.desc("total"), "user_id").limit(10)


@query("agg_21", f"""WITH {D} SELECT count(*) AS total, round_even(100.0::DOUBLE * count(section) / count(*), 1) AS section_pct, round_even(100.0::DOUBLE * count(*) FILTER (text_chars > 500) / count(*), 1) AS long_pct,
 round_even(100.0::DOUBLE * count(effective_date) / count(*), 1) AS dated_pct FROM d""")
def agg_21(t):
    pct = lambda c: F.bround(F.lit(100.0) * c / F.count(F.lit(1)), 1)
    return lib(t).agg(
        F.count(F.lit(1)).alias("total"), pct(F.count("section")).alias("section_pct"),
        pct(F.count_if(F.col("text_chars") > 500)).alias("long_pct"), pct(F.count("effective_date")).alias("dated_pct"),
    )


@query("agg_22", """WITH b AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS brand FROM part), q AS (SELECT lower(p_name) AS question FROM part)
SELECT brand, count(*) AS n FROM q, b WHERE contains(question, brand) GROUP BY brand ORDER BY n DESC, brand LIMIT 10""")
def agg_22(t):
    words = t.part.select(F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("brand"))
    brands = t.part.select(F.split(F.lower("p_name"), " ")[1].alias("brand")).distinct()
    return words.join(brands, "brand").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand").limit(10)


@query("agg_23", r"""WITH v AS (SELECT DISTINCT p_name AS v FROM part UNION SELECT DISTINCT upper(replace(p_name, ' ', '-')) FROM part)
SELECT regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS key, count(*) AS variants, string_agg(v, '|' ORDER BY v) AS names FROM v GROUP BY 1 HAVING count(*) > 1""")
def agg_23(t):
    names = t.part.select(F.col("p_name").alias("v")).union(t.part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))).distinct()
    return names.groupBy(F.regexp_replace(F.lower("v"), "[^a-z0-9]", "").alias("key")).agg(
        F.count(F.lit(1)).alias("variants"), F.array_join(F.array_sort(F.collect_list("v")), "|").alias("names")
    ).where("variants > 1")


@query("agg_24", """SELECT lower(p_name) AS question, count(*) AS n, max(p_partkey) AS last_at, min(p_size) AS least FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 45)
 GROUP BY 1 ORDER BY n DESC, question LIMIT 30""")
def agg_24(t):
    known = t.part.where("p_size > 45").select(F.lower("p_name").alias("question")).distinct()
    return t.part.withColumn("question", F.lower("p_name")).join(known, "question", "left_anti").groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("last_at"), F.min("p_size").alias("least")
    ).orderBy(F.desc("n"), "question").limit(30)


@query("agg_26", """SELECT count(*) AS chunks, CAST((sum(n_chars) + 600 * count(*)) / 3.2 AS BIGINT) AS tokens, round(count(*) / 3600, 4) AS hours FROM documents""")
def agg_26(t):
    n = F.count(F.lit(1))
    return t.documents.agg(n.alias("chunks"), F.round((F.sum("n_chars") + 600 * n) / 3.2).cast("long").alias("tokens"), F.round(n / 3600, 4).alias("hours"))


@query("agg_27", """SELECT count(*) FILTER (n_chars >= 1000) AS done, sum(n_chars // 1800) FILTER (n_chars >= 1000)::BIGINT AS pages, count(*) FILTER (n_chars < 100) AS queue,
 count(*) FILTER (n_chars BETWEEN 100 AND 199) AS weak, round(avg(n_chars) FILTER (n_chars >= 1000), 3) AS quality FROM documents""")
def agg_27(t):
    done = F.col("n_chars") >= 1000
    return t.documents.agg(
        F.count_if(done).alias("done"), F.sum(F.when(done, F.floor(F.col("n_chars") / 1800))).alias("pages"), F.count_if(F.col("n_chars") < 100).alias("queue"),
        F.count_if(F.col("n_chars").between(100, 199)).alias("weak"), F.round(F.avg(F.when(done, F.col("n_chars"))), 3).alias("quality"),
    )


@query("agg_28", """SELECT s.status, count(c.c_custkey) AS n FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('BLOCKED')) s(status) LEFT JOIN customer c ON c.c_mktsegment = s.status GROUP BY s.status""")
def agg_28(t):
    states = t.spark.createDataFrame([(x,) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "BLOCKED")], "status string")
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_29", """WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events), d AS (SELECT count(*) AS n, count(*) FILTER (n_chars < 100) AS backlog FROM documents)
SELECT 'refusals' AS key, 'warn' AS level, round(bad / n, 4) AS value FROM e WHERE bad / n > 0.15 UNION ALL SELECT 'ocr_backlog', 'info', CAST(backlog AS DOUBLE) FROM d WHERE backlog > 5""")
def agg_29(t):
    e = t.events.agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("v")).where("v > 0.15").select(F.lit("refusals").alias("key"), F.lit("warn").alias("level"), F.round("v", 4).alias("value"))
    d = t.documents.agg(F.count_if(F.col("n_chars") < 100).cast("double").alias("v")).where("v > 5").select(F.lit("ocr_backlog").alias("key"), F.lit("info").alias("level"), F.col("v").alias("value"))
    return e.unionByName(d)


@query("agg_31", f"WITH {Q}, {FB}, {D} SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(DISTINCT user_id) FROM q) AS users, (SELECT count(*) FROM fb) AS verdicts, (SELECT count(*) FROM d WHERE status = 'ok') AS docs")
def agg_31(t):
    one = q(t).agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("user_id").alias("users"))
    return one.join(fb(t).agg(F.count(F.lit(1)).alias("verdicts"))).join(lib(t).agg(F.count_if(F.col("status") == "ok").alias("docs")))


@query("agg_32", """SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
 UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents""")
def agg_32(t):
    parts = [getattr(t, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("name"), "n") for x in ("region", "nation", "customer", "orders", "lineitem", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# windows


@query("win_02", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE r <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def win_02(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("win_03", f"""WITH {D}, v AS (SELECT id, version_key, effective_date, row_number() OVER w AS r, first_value(id) OVER w AS newest FROM d
 WHERE status = 'ok' AND effective_date IS NOT NULL AND doc_type IN ('price list', 'catalogue', 'passport', 'certificate') WINDOW w AS (PARTITION BY version_key ORDER BY effective_date DESC, id DESC))
SELECT id, r = 1 AS is_current, CASE WHEN r > 1 THEN newest END AS superseded_by FROM v""")
def win_03(t):
    w = Window.partitionBy("version_key").orderBy(F.desc("effective_date"), F.desc("id"))
    live = lib(t).where("status = 'ok' AND effective_date IS NOT NULL").where(F.col("doc_type").isin(*kb.DOC_TYPES[:4]))
    return live.select("id", F.row_number().over(w).alias("r"), F.first("id").over(w).alias("newest")).select(
        "id", (F.col("r") == 1).alias("is_current"), F.when(F.col("r") > 1, F.col("newest")).alias("superseded_by")
    )


@query("win_04", """WITH m AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS run, round(avg(o_totalprice), 4) AS mrr FROM orders GROUP BY 1)
SELECT run, mrr, lag(mrr) OVER (ORDER BY run) AS before, round(mrr - lag(mrr) OVER (ORDER BY run), 3) AS delta FROM m""")
def win_04(t):
    m = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("mrr"))
    before = F.lag("mrr").over(Window.orderBy("run"))  # one row a year
    return m.select("run", "mrr", before.alias("before"), F.round(F.col("mrr") - before, 3).alias("delta"))


@query("win_05", """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(o_totalprice) FILTER (i = least(CAST(floor(n * 0.05::DOUBLE) AS BIGINT), n - 1)) AS p05, max(o_totalprice) FILTER (i = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1)) AS p90 FROM r GROUP BY 1""")
def win_05(t):
    return floor_quantiles(t.orders, "o_totalprice", [0.05, 0.9], ["o_orderpriority"])


@query("win_06", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS last_hour,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS last_day FROM events""")
def win_06(t):
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us")
    back = lambda hours: F.count(F.lit(1)).over(w.rangeBetween(-(hours * 3_600_000_000 - 1), -1))
    return e.select("event_id", back(1).alias("last_hour"), back(24).alias("last_day"))


@query("win_07", """WITH r AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, user_id FROM events)
SELECT user_id, event_id, value FROM r WHERE i % greatest(1, n // 10) = 0""")
def win_07(t):
    w = Window.partitionBy("user_id")
    r = t.events.select("user_id", "event_id", "value", (F.row_number().over(w.orderBy("event_id")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0).select("user_id", "event_id", "value")


@query("win_08", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def win_08(t):
    last = t.events.agg(F.max("event_id").alias("last"))
    return t.events.join(F.broadcast(last), F.col("event_id") > F.col("last") - 500).select("event_id", "event_type")


@query("top_05", """SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey LIMIT 40""")
def top_05(t):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t.orders.orderBy(rank, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority").limit(40)


@query("top_06", """WITH busy AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem JOIN busy USING (l_suppkey, l_partkey) WHERE l_orderkey = o_orderkey) ORDER BY o_orderpriority, o_orderkey LIMIT 1""")
def top_06(t):
    """The first order that needs no supplier's part which a running order holds."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey")
    running = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    busy = lines.join(running, "l_orderkey").select("l_suppkey", "l_partkey").distinct()
    clash = lines.join(busy, ["l_suppkey", "l_partkey"]).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.where("o_orderstatus = 'O'").join(clash, "o_orderkey", "left_anti").orderBy("o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority").limit(1)


@query("top_07", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead,
 count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 AS admitted FROM orders""")
def top_07(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.count(F.lit(1)).over(w)
    return t.orders.select("o_orderkey", ahead.alias("ahead"), (ahead < 3).alias("admitted"))


@query("snk_01", "SELECT p_brand, arg_max(p_name, p_partkey) AS p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def snk_01(t):
    return newest(t.part, ["p_brand"], [F.desc("p_partkey")]).select("p_brand", "p_name", "p_partkey")
