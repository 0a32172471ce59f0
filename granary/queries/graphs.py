"""GR and CL queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import graph as gr
from granary.plans import kb
from granary.queries.registry import query
from granary.operators import vectors as vc
from granary.queries.retrieval import PAIRS
from granary.queries.texts import STOP_SQL, TOKENS

D = kb.LIBRARY_SQL
N = lambda: F.count(F.lit(1))


def lib(t):
    return kb.library(t.documents)


@query("gr_01", f"""WITH {D}, n AS (SELECT content_hash, count(*) AS n FROM d GROUP BY content_hash), s AS (SELECT section, dense_rank() OVER (ORDER BY count(*) DESC, section) AS colour FROM d GROUP BY section)
SELECT id, n > 1 AS dup, id % 7 = 0 AS used, doc_type AS category, CAST(year(effective_date) AS BIGINT) AS year, colour FROM d JOIN n USING (content_hash) JOIN s USING (section)""")
def gr_01(t):
    d = lib(t)
    copies = d.groupBy("content_hash").agg((N() > 1).alias("dup"))
    colours = d.groupBy("section").agg(N().alias("n")).select("section", F.dense_rank().over(Window.orderBy(F.desc("n"), "section")).cast("long").alias("colour"))
    return d.join(copies, "content_hash").join(F.broadcast(colours), "section").select("id", "dup", (F.col("id") % 7 == 0).alias("used"), F.col("doc_type").alias("category"), F.year("effective_date").cast("long").alias("year"), "colour")


CHAIN = f"{D}, f AS (SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY id) AS r FROM d), ch AS (SELECT id AS a, lead(id) OVER (PARTITION BY brand ORDER BY id) AS b, 0.2::DOUBLE AS w FROM f WHERE r <= 60)"


def chain(t):
    return gr.chain_edges(lib(t).select("brand", "id"), "brand", "id")


@query("gr_02", f"WITH {CHAIN} SELECT a, b, w FROM ch WHERE b IS NOT NULL")
def gr_02(t):
    return chain(t)


@query("gr_03", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM pr WHERE s >= 0.3) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM r WHERE r <= 6")
def gr_03(t):
    return vc.alike(t.embeddings, 0.3, 6).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@query("gr_04", f"WITH {PAIRS} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT x FROM pr WHERE s >= 0.3) AND vec_id NOT IN (SELECT y FROM pr WHERE s >= 0.3)")
def gr_04(t):
    linked = vc.alike(t.embeddings, 0.3, 1).select(F.col("x").alias("vec_id"))
    return t.embeddings.select("vec_id").join(linked, "vec_id", "left_anti")


@query("gr_05", f"WITH {D} SELECT section, count(*) AS nodes, count(*) FILTER (status = 'ok') AS ok, count(DISTINCT brand) AS brands FROM d GROUP BY section")
def gr_05(t):
    return lib(t).groupBy("section").agg(N().alias("nodes"), F.count_if(F.col("status") == "ok").alias("ok"), F.countDistinct("brand").alias("brands"))


LEVEL_KEYS = "lk AS (SELECT id, unnest([{l: 'section', k: section}, {l: 'brand', k: section || ' / ' || brand}, {l: 'category', k: doc_type}, {l: 'doc', k: CAST(id AS VARCHAR)}]) AS x FROM (SELECT id, coalesce(section, '') AS section, coalesce(brand, '') AS brand, doc_type FROM d))"


def graph_nodes(t):
    return lib(t).select("id", "section", "brand", F.col("doc_type").alias("category"), F.col("text_chars").alias("chars"), F.col("effective_date").isNull().cast("int").alias("undated"), (F.col("status") == "error").cast("int").alias("failed"))


@query("gr_06", f"WITH {CHAIN}, {LEVEL_KEYS} SELECT x.x.l AS level, least(x.x.k, y.x.k) AS a, greatest(x.x.k, y.x.k) AS b, count(*) AS n, max(w) AS w FROM ch JOIN lk x ON x.id = ch.a JOIN lk y ON y.id = ch.b AND y.x.l = x.x.l WHERE x.x.k <> y.x.k GROUP BY 1, 2, 3")
def gr_06(t):
    return gr.level_edges(chain(t), graph_nodes(t))


@query("gr_06_nodes", f"WITH {D}, {LEVEL_KEYS} SELECT x.l AS level, x.k AS key, count(*) AS n, CAST(sum(text_chars) AS BIGINT) AS chars, count(*) FILTER (effective_date IS NULL) AS undated, count(*) FILTER (status = 'error') AS failed FROM lk JOIN d USING (id) GROUP BY 1, 2")
def gr_06_nodes(t):
    return gr.level_nodes(graph_nodes(t), ["chars", "undated", "failed"])


@query("gr_07", f"WITH {D} SELECT id, CASE WHEN status <> 'ok' THEN 'error' WHEN id % 11 = 0 THEN 'superseded' WHEN effective_date IS NULL THEN 'undated' WHEN id % 7 = 0 THEN 'used' ELSE 'idle' END AS state FROM d")
def gr_07(t):
    state = F.when(F.col("status") != "ok", "error").when(F.col("id") % 11 == 0, "superseded").when(F.col("effective_date").isNull(), "undated").when(F.col("id") % 7 == 0, "used").otherwise("idle")
    return lib(t).select("id", state.alias("state"))


@query("gr_08", f"WITH {D} SELECT id FROM d WHERE section = 'en' AND brand = 'src3' AND doc_type <> 'manual'")
def gr_08(t):
    return lib(t).where("section = 'en' AND brand = 'src3' AND doc_type <> 'manual'").select("id")


QT = f"qt AS (SELECT id, w AS term FROM (SELECT DISTINCT item_id AS id, unnest({TOKENS}) AS w FROM benchmark) WHERE length(w) >= 3 AND w NOT IN {STOP_SQL})"
SIM = f"{QT}, n AS (SELECT count(DISTINCT id) AS n FROM qt), wt AS (SELECT term, ln(n / (1 + count(*))) + 1 AS w FROM qt, n GROUP BY term, n), ow AS (SELECT id, term, w FROM qt JOIN wt USING (term)), tt AS (SELECT id, sum(w) AS total FROM ow GROUP BY id), sh AS (SELECT a.id AS a, b.id AS b, sum(a.w) AS shared FROM ow a JOIN ow b USING (term) WHERE a.id < b.id GROUP BY 1, 2), sm AS (SELECT a, b, round(shared / least(x.total, y.total), 6) AS sim FROM sh JOIN tt x ON x.id = a JOIN tt y ON y.id = b)"


def pairs(t, least):
    terms = t.benchmark.select(F.col("item_id").alias("id"), F.explode(tx.keywords(F.col("text"))).alias("term"))
    return gr.question_pairs(terms, least - 1e-6).withColumn("sim", F.round("sim", 6)).where(F.col("sim") >= least)


@query("cl_01_pairs", f"WITH {SIM} SELECT a, b, sim FROM sm WHERE sim >= 0.12")
def cl_01_pairs(t):
    return pairs(t, 0.12)


@query("cl_02", f"WITH RECURSIVE {SIM}, ed AS (SELECT a, b FROM sm WHERE sim >= 0.12 UNION SELECT b, a FROM sm WHERE sim >= 0.12), rc AS (SELECT a AS node, a AS reach FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.reach) SELECT node, min(reach) AS label FROM rc GROUP BY node")
def cl_02(t):
    return gr.connected(pairs(t, 0.12).select("a", "b"))


@query("cl_04", f"""WITH RECURSIVE {SIM}, ed AS (SELECT a, b FROM sm WHERE sim >= 0.12 UNION SELECT b, a FROM sm WHERE sim >= 0.12), rc AS (SELECT a AS node, a AS reach FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.reach), cl AS (SELECT node AS id, min(reach) AS cluster FROM rc GROUP BY node),
tw AS (SELECT cluster, term, round(sum(w), 6) AS weight FROM ow JOIN cl USING (id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r FROM tw), tp AS (SELECT cluster, string_agg(term, ' ' ORDER BY r) AS top FROM r WHERE r <= 6 GROUP BY cluster)
SELECT cluster, count(*) AS size, top, count(*) FILTER (id % 3 = 0) AS nothing_found, count(*) FILTER (id % 3 = 1) AS low_confidence, count(*) FILTER (id % 3 = 2) AS disliked, max(id) AS last_at FROM cl JOIN tp USING (cluster) GROUP BY cluster, top""")
def cl_04(t):
    """Summaries of the clusters of CL-02; a question's stage goes by its id."""
    terms = t.benchmark.select(F.col("item_id").alias("id"), F.explode(tx.keywords(F.col("text"))).alias("term"))
    labels = gr.connected(pairs(t, 0.12).select("a", "b")).select(F.col("node").alias("id"), F.col("label").alias("cluster"))
    stage = F.when(F.col("id") % 3 == 0, "nothing_found").when(F.col("id") % 3 == 1, "low_confidence").otherwise("disliked")
    asked = t.benchmark.select(F.col("item_id").alias("id"), stage.alias("stage"), F.col("item_id").alias("at"))
    return gr.cluster_summaries(labels, asked, gr.weighted_terms(terms), ["nothing_found", "low_confidence", "disliked"])
