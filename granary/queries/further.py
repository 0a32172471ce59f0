"""Queries of the sequential operators: clusters, caps, contexts, pieces, decomposition, memory, alerts, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import spoken as sp
from granary.functions import text as tx
from granary.operators import clusters as cl
from granary.operators import latent
from granary.operators import retrieval as rt
from granary.operators import vectors as vc
from granary.operators.common import dot
from granary.operators.graph import weighted_terms
from granary.operators.tables import written
from granary.plans import kb
from granary.queries.graphs import CHAIN, chain, pairs
from granary.queries.registry import query
from granary.queries.retrieval import lexical
from granary.sources import files, html, web
from granary.streaming import dialog

D = kb.LIBRARY_SQL
NEAR, ATTACH, LEAST = 0.12, 0.09, 2  # invented prose shares little


def groups(t):
    """(items, pairs, greedy clusters) of the questions."""
    terms = t.benchmark.select(F.col("item_id").alias("id"), F.explode(tx.keywords(F.col("text"))).alias("term"))
    items = weighted_terms(terms).groupBy("id").agg(F.round(F.sum("w"), 6).alias("weight"))
    near = written(pairs(t, ATTACH))
    return items, near, cl.greedy(items, near, NEAR, LEAST)


@query("cl_01")
def cl_01(t):
    return groups(t)[2]


@query("cl_03")
def cl_03(t):
    items, near, found = groups(t)
    return cl.attached(items, cl.merged(found, near, NEAR), near, ATTACH)


@query("top_08")
def top_08(t):
    """The cap keeps each end's six strongest edges, so weaker ones are not made."""
    best = vc.alike(t.embeddings, 0.3, 6).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1).alias("n"), F.col("s").alias("w"))
    return cl.degree_capped(best.distinct(), 6)


@query("txt_24", "SELECT p_partkey, 'напор ' || p_size || ' метров , источник 2 подача 3.6 кубометров в час у дабл-ю ар пи тире эй 55/75' AS said FROM part")
def txt_24(t):
    text = F.concat(F.lit("**напор** "), F.col("p_size").cast("string"), F.lit(" м, [2] подача 3.6 м3/ч у <b>WRP-A</b> 55/75"))
    return t.part.select("p_partkey", sp.said(text).alias("said"))


@query("txt_27")
def txt_27(t):
    """Places of the first six documents that make up each question's context."""
    hits = lexical(t, 6).join(t.documents.select("doc_id", "text", "source"), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source").alias("header"))))
    rows = hits.groupBy("query").agg(ordered.alias("h")).select("query", F.transform("h", lambda x: x["text"]).alias("t"), F.transform("h", lambda x: x["header"]).alias("s"))
    return rows.select("query", sp.context_places(F.col("t"), F.col("s")).alias("places"))


@query("txt_30")
def txt_30(t):
    """Word pieces of whole texts by a vocabulary of letters and frequent endings."""
    letters = [chr(97 + k) for k in range(26)]
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *[f"##{x}" for x in letters], *"th an in er on the and ing tion".split(), "##th", "##an", "##ing", "##tion", ",", "."]
    ids = sp.framed(sp.pieces(F.col("text"), vocabulary), vocabulary, (1 << 31) - 1)
    return t.documents.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("digest"))


@query("vec_03")
def vec_03(t):
    model = latent.decompose_rows(*rt.weighted_rows(t.documents, size=4096), 16)
    rows = [(k, round(float(v), 3)) for k, v in enumerate(model.singular)]
    return t.spark.createDataFrame(rows, "k int, singular double")


@query("vec_04", "SELECT doc_id, 1.0::DOUBLE AS norm FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\-./]+')) AS term FROM documents) WHERE term IN (SELECT term FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\-./]+')) AS term FROM documents)) GROUP BY term HAVING (count(*) >= 2 OR regexp_matches(term, '[0-9]')) AND count(*) < 0.6 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 4096))))")
def vec_04(t):
    """Every text with a term of the vocabulary has a vector of length one."""
    rows, terms = rt.weighted_rows(t.documents, size=4096)
    out = latent.projected_rows(rows, latent.decompose_rows(rows, terms, 16))
    return out.select("doc_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 3).alias("norm"))


@query("src_04", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(coalesce(text, '')) WHEN 1 THEN sha256('SUMMARY:' || source) ELSE sha256('Заголовок STEP: ' || chr(39) || source || chr(39)) END AS digest FROM documents")
def src_04(t):
    """Texts wrapped as files of three formats and taken out again."""
    ext = F.element_at(F.array(F.lit("txt"), F.lit("ics"), F.lit("step")), (F.col("doc_id") % 3 + 1).cast("int"))
    ics = F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:"), "source", F.lit("\nUID:1"))
    step = F.concat(F.lit("ISO-10303-21;\nFILE_NAME('"), "source", F.lit("');\nENDSEC;"))
    content = F.when(F.col("doc_id") % 3 == 0, F.coalesce("text", F.lit(""))).when(F.col("doc_id") % 3 == 1, ics).otherwise(step)
    made = t.documents.select(F.concat_ws(".", F.col("doc_id").cast("string"), ext).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return files.extracted(made).select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), F.sha2(F.array_join("pages", "\n"), 256).alias("digest"))


@query("src_22")
def src_22(t):
    """The pages reached from the first one over links of the same host."""
    links = html.links(t.pages).where("same_host AND NOT is_pdf").join(t.pages.select("page_id", "url"), "page_id").select(F.col("url").alias("src"), F.col("link").alias("dst"))
    return web.crawl(t.pages.agg(F.min("url").alias("url")), links, 1_000_000)


@query("src_28", "SELECT text AS question, ['a' || item_id] AS expect_files FROM benchmark WHERE text IS NOT NULL")
def src_28(t):
    said = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.concat(F.lit("a"), F.col("item_id").cast("string"))).alias("expect_files")))
    lines = t.benchmark.where("text IS NOT NULL").select(said.alias("value")).unionByName(t.spark.createDataFrame([("// note",), ("",)], "value string"))
    return web.questions(lines).select("question", "expect_files")


@query("snk_05", f"""WITH {CHAIN}, n AS (SELECT brand, list(struct_pack(id := id, section := section) ORDER BY id) AS nodes FROM d GROUP BY brand), e AS (SELECT d.brand, list(struct_pack(a := ch.a, b := ch.b) ORDER BY ch.a) AS edges FROM ch JOIN d ON d.id = ch.a WHERE ch.b IS NOT NULL GROUP BY d.brand)
SELECT brand, sha256(to_json(struct_pack(nodes := nodes, edges := edges))::VARCHAR) AS digest FROM n JOIN e USING (brand)""")
def snk_05(t):
    d = kb.library(t.documents)
    edges = chain(t).join(d.select(F.col("id").alias("a"), "brand"), "a").select("brand", "a", "b")
    made = web.payload(d.select("brand", "id", F.coalesce("section", F.lit(None).cast("string")).alias("section")), edges, "brand")
    return made.where("brand IS NOT NULL").select("brand", F.sha2("graph", 256).alias("digest"))


DAYS = "days AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events))"


@query("st_04_alerts", f"""WITH {DAYS}, r AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS d FROM events WHERE event_type = 'error'), s AS (SELECT user_id, r.d, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM r JOIN days ON days.d = r.d),
g AS (SELECT user_id, run, min(d) AS opened, max(d) AS last_seen, max(n) AS n FROM s GROUP BY 1, 2)
SELECT user_id, epoch_us(opened) AS opened, epoch_us(last_seen) AS last_seen, CAST(floor((epoch_us(last_seen) - epoch_us(opened)) / 43200000000) AS BIGINT) + 1 AS notices, epoch_us(x.d) AS resolved FROM g LEFT JOIN days x ON x.n = g.n + 1""")
def st_04_alerts(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")
    reports = t.events.where("event_type = 'error'").select(F.col("user_id").alias("code"), day)
    out = dialog.alerts(reports, t.events.select(day))
    us = lambda c: F.unix_micros(c).alias(c)
    return out.select(F.col("code").alias("user_id"), us("opened"), us("last_seen"), "notices", us("resolved"))


@query("st_06")
def st_06(t):
    """Users' turns, four minutes apart, with what they inherit."""
    at = F.timestamp_seconds(F.col("conv_id") * 100_000 + F.col("turn") * 240)
    turns = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("chat"), at.alias("at"), F.col("text").alias("question"))
    return dialog.inherited(turns, F.array(F.lit("grundfos"), F.lit("wilo"))).select("chat", F.unix_micros("at").alias("at"), F.sha2("asked", 256).alias("digest"))
