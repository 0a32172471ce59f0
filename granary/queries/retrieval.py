"""RET, VEC, TOP and further WIN queries, with the vector joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import arrow as ar
from granary.functions import stem as st
from granary.functions import text as tx
from granary.operators import retrieval as rt
from granary.operators import routing as ro
from granary.operators import vectors as vc
from granary.operators.common import dot, rrf, unit
from granary.operators.tables import written
from granary.plans import kb
from granary.queries.registry import query
from granary.queries.texts import ASKED_SQL, STOP_SQL, TOKENS

N = lambda: F.count(F.lit(1))
AS_OF = "2025-01-01"

FIELDED_SQL = f"""{kb.LIBRARY_SQL}, fx AS (SELECT id AS doc_id, text, section AS heading, concat_ws(', ', brand, doc_type, '«' || section || '»') AS context, brand, doc_type, split_part(rel_path, '/', -1) AS file_name FROM d)"""


def bm25_sql(fields: dict[str, float]) -> str:
    """CTEs up to ``bm`` (query, doc_id, score) over the weighted fields of ``documents``; prefixes are terms of their own."""
    union = " UNION ALL ".join(rf"SELECT doc_id, unnest(regexp_extract_all(lower({f}), '[\p{{L}}\p{{N}}_]+')) AS term, {w}::DOUBLE AS w FROM fx" for f, w in fields.items())
    return f"""{ASKED_SQL}, {FIELDED_SQL}, tk AS ({union}), sz AS (SELECT doc_id, count(*) AS size FROM tk GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS avg_size),
kinds AS (SELECT DISTINCT term, is_prefix FROM qa), hit AS (SELECT doc_id, kinds.term, is_prefix, w FROM tk JOIN kinds ON NOT is_prefix AND tk.term = kinds.term UNION ALL SELECT doc_id, kinds.term, is_prefix, w FROM tk JOIN kinds ON is_prefix AND tk.term[1:4] = kinds.term[1:4] AND starts_with(tk.term, kinds.term)),
po AS (SELECT doc_id, term, is_prefix, sum(w) AS tf FROM hit GROUP BY doc_id, term, is_prefix), df AS (SELECT term, is_prefix, count(*) AS df FROM po GROUP BY term, is_prefix),
bm AS (SELECT query, po.doc_id, sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6 END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / avg_size))) AS score
 FROM po JOIN df USING (term, is_prefix) JOIN sz USING (doc_id) JOIN qa USING (term, is_prefix) CROSS JOIN st GROUP BY query, po.doc_id),
lex AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""


#: weights of the six fields
FIELDS = {"text": 6.0, "heading": 3.0, "context": 1.5, "brand": 2.0, "doc_type": 1.0, "file_name": 2.0}
BM = bm25_sql(FIELDS)


def fielded(t):
    """The documents with the fields that are searched."""
    context = F.concat_ws(", ", "brand", "doc_type", F.concat(F.lit("«"), "section", F.lit("»")))
    name = F.element_at(F.split("rel_path", "/"), -1)
    return kb.library(t.documents).select(F.col("id").alias("doc_id"), "text", F.col("section").alias("heading"), context.alias("context"), "brand", "doc_type", name.alias("file_name"))


def terms(t):
    """What the benchmark's questions ask for."""
    return t.benchmark.select(F.col("item_id").alias("query"), F.explode(st.query_terms(F.col("text"))).alias("q")).select("query", "q.term", "q.is_prefix").distinct()


def lexical(t, top: int):
    return rt.best_bm25(fielded(t), terms(t), FIELDS, top)


@query("ret_01", f"WITH {BM} SELECT query, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 6")
def ret_01(t):
    return lexical(t, 6).select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("top_03", f"WITH {bm25_sql({'text': 1.0})} SELECT query, doc_id, rank FROM lex WHERE rank <= 40")
def top_03(t):
    return rt.best_bm25(t.documents, terms(t), {"text": 1.0}, 40).select("query", "doc_id", F.col("rank").cast("long").alias("rank"))


UNIT_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), eq AS (SELECT vec_id AS query, v AS qv FROM e WHERE vec_id % 50 = 0)"


def asked(t):
    """The stated query set: every vector whose id is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


KNN = f"{UNIT_SQL}, c AS (SELECT query, vec_id, label, round(list_cosine_similarity(v, qv), 6) AS cosine FROM e, eq), kn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c)"


@query("top_01", f"WITH {KNN} SELECT query, vec_id, rank FROM kn WHERE rank <= 10")
def top_01(t):
    return vc.nearest(t.embeddings, asked(t), 10).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("top_01_masked", f"WITH {UNIT_SQL}, c AS (SELECT query, vec_id, round(list_cosine_similarity(v, qv), 6) AS cosine FROM e, eq WHERE query % 100 = 0 OR label IN (query % 10, 3, 7)), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query, vec_id, rank FROM k WHERE rank <= 10")
def top_01_masked(t):
    """Each query sees the rows of its own groups only, some see all."""
    allowed = F.when(F.col("query") % 100 != 0, F.array(F.col("query") % 10, F.lit(3), F.lit(7)))
    return vc.nearest(t.embeddings, asked(t).withColumn("allowed", allowed), 10, group="label").select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("top_02", f"WITH {UNIT_SQL}, c AS (SELECT query, vec_id, round(list_cosine_similarity(v, qv), 6) AS cosine FROM e, eq WHERE label IN (1, 3)), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query, vec_id, rank FROM k WHERE rank <= 5")
def top_02(t):
    return vc.nearest(t.embeddings.where(F.col("label").isin(1, 3)), asked(t), 5).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("ret_02", f"WITH {KNN} SELECT query, vec_id, cosine FROM kn WHERE rank <= 40")
def ret_02(t):
    return vc.nearest(t.embeddings, asked(t), 40).select("query", "vec_id", "cosine")


HYBRID = f"{BM}, {UNIT_SQL.replace('vec_id % 50 = 0', 'vec_id IN (SELECT item_id FROM benchmark)')}, c AS (SELECT query, vec_id AS doc_id, round(list_cosine_similarity(v, qv), 6) AS cosine FROM e, eq), den AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc_id) AS rank FROM c), rr AS (SELECT query, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query, doc_id, rank FROM lex WHERE rank <= 40 UNION ALL SELECT query, doc_id, rank FROM den WHERE rank <= 40) GROUP BY query, doc_id)"


def fused(t):
    """RRF of the lexical and the dense channel; the vector of a question's id stands for the question."""
    own = t.benchmark.select(F.col("item_id").alias("vec_id")).join(t.embeddings, "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    dense = vc.nearest(t.embeddings, own, 40).withColumnRenamed("vec_id", "doc_id")
    return rrf([lexical(t, 40), dense], ["query", "doc_id"])


@query("win_01", f"WITH {HYBRID} SELECT query, doc_id, round(score, 6) AS score FROM rr")
def win_01(t):
    return fused(t).select("query", "doc_id", F.round("score", 6).alias("score"))


HYBRID3 = f"""{HYBRID}, al AS (SELECT rr.query, rr.doc_id, d.brand, round(0.85::DOUBLE * score + 0.15::DOUBLE * score * 2 * CASE WHEN effective_date IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, greatest(date_diff('day', effective_date, DATE '{AS_OF}'), 0) / 540) END, 6) AS score
 FROM rr JOIN d ON d.id = rr.doc_id WHERE d.status = 'ok' AND d.section IN ('en', 'de')), cap AS (SELECT *, row_number() OVER (PARTITION BY query, brand ORDER BY score DESC, doc_id) AS nth FROM al), fin AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM cap WHERE nth <= 2)"""


@query("ret_03", f"WITH {HYBRID3} SELECT query, doc_id, score, rank FROM fin WHERE rank <= 6")
def ret_03(t):
    return hybrid(t).select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid(t):
    """Fusion, rights and currency before the cut, recency, at most two of a brand, six in all."""
    docs = kb.library(t.documents).where("status = 'ok'").where(F.col("section").isin("en", "de")).select(F.col("id").alias("doc_id"), "brand", "effective_date")
    live = fused(t).join(docs, "doc_id").withColumn("score", F.round(rt.recency(F.col("score"), F.col("effective_date"), F.to_date(F.lit(AS_OF))), 6))
    nth = F.row_number().over(Window.partitionBy("query", "brand").orderBy(F.desc("score"), "doc_id"))
    return rt.ranked(live.withColumn("nth", nth).where("nth <= 2"), "query", "score", "doc_id", 6)


@query("ret_05", f"WITH {kb.LIBRARY_SQL} SELECT id, round(0.85::DOUBLE * text_chars + 0.15::DOUBLE * text_chars * 2 * CASE WHEN effective_date IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, greatest(date_diff('day', effective_date, DATE '2022-01-01'), 0) / 540) END, 4) AS score FROM d")
def ret_05(t):
    return kb.library(t.documents).select("id", F.round(rt.recency(F.col("text_chars"), F.col("effective_date"), F.to_date(F.lit("2022-01-01"))), 4).alias("score"))


RR_TOK = r"list_filter(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\-./]*'), lambda x: trim(x, '-./')), lambda x: length(x) >= 2 AND NOT list_contains({stop}, x))"
STOP_LIST = "[" + STOP_SQL[1:-1] + "]"
W8 = r"CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '\p{L}') THEN 4.2::DOUBLE WHEN length(x) > 9 THEN 3.45::DOUBLE ELSE 3.0::DOUBLE END"


PAIRED = f"""n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT item_id, doc_id, list_distinct({RR_TOK.format(x='b.text', stop=STOP_LIST)}) AS q, {RR_TOK.format(x="coalesce(d.text, '')", stop=STOP_LIST)} AS dt FROM documents d, n JOIN benchmark b ON d.doc_id % n.n = b.item_id),
hp AS (SELECT item_id, doc_id, unnest(dt) AS term, unnest(range(0, len(dt))) AS pos FROM p), h AS (SELECT hp.* FROM hp JOIN (SELECT item_id, doc_id, unnest(q) AS term FROM p) USING (item_id, doc_id, term)),
mt AS (SELECT item_id, doc_id, count(DISTINCT term) AS m FROM h GROUP BY 1, 2), lp AS (SELECT item_id, doc_id, pos, t.term, max(CASE WHEN h.term = t.term THEN pos END) OVER (PARTITION BY item_id, doc_id, t.term ORDER BY pos) AS lastp FROM h JOIN (SELECT DISTINCT item_id, doc_id, term FROM h) t USING (item_id, doc_id)),
sp AS (SELECT item_id, doc_id, min(span) AS span FROM (SELECT item_id, doc_id, pos, pos - min(lastp) AS span FROM lp GROUP BY 1, 2, 3 HAVING count(lastp) = count(*)) GROUP BY 1, 2),
px AS (SELECT p.item_id, p.doc_id, CASE WHEN m IS NULL THEN 0 WHEN m < 2 THEN 1 WHEN span <= greatest(3 * m, 12) THEN 1 ELSE greatest(3 * m, 12)::DOUBLE / span END AS near FROM p LEFT JOIN mt USING (item_id, doc_id) LEFT JOIN sp USING (item_id, doc_id))"""


def paired(t):
    """Every document with the question that its id falls to."""
    n = t.benchmark.agg(N().alias("n"))
    docs = t.documents.join(F.broadcast(n)).select("doc_id", F.coalesce("text", F.lit("")).alias("d"), F.pmod("doc_id", "n").alias("item_id"))
    return docs.join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")


@query("ret_06", f"""WITH {PAIRED},
s AS (SELECT item_id, doc_id, len(dt) AS n, list_sum(list_transform(list_intersect(q, dt), lambda x: {W8})) AS hit, list_sum(list_transform(q, lambda x: {W8})) AS total, len(list_filter(q, lambda x: regexp_matches(x, '[0-9]'))) AS codes, len(list_intersect(list_filter(q, lambda x: regexp_matches(x, '[0-9]')), dt)) AS coded FROM p)
SELECT item_id, doc_id, round((0.60::DOUBLE * coalesce(hit / total, 0) + 0.25::DOUBLE * near + 0.15::DOUBLE * CASE WHEN codes > 0 THEN coded / codes ELSE 0 END) / (1 + ln(1 + n / 400)), 6) AS score FROM s JOIN px USING (item_id, doc_id)""")
def ret_06(t):
    return paired(t).select("item_id", "doc_id", F.round(rt.rerank_score(F.col("q"), F.col("d")), 6).alias("score"))


@query("ret_07", f"WITH {PAIRED} SELECT doc_id, item_id, round(near::DOUBLE, 6) AS proximity FROM px")
def ret_07(t):
    q, d = F.array_distinct(tx.rerank_tokens(F.col("q"))), tx.rerank_tokens(F.col("d"))
    return paired(t).select("doc_id", "item_id", F.round(ar.proximity(q, d), 6).alias("proximity"))


@query("ret_08", rf"WITH t AS (SELECT DISTINCT unnest({TOKENS}) AS term FROM benchmark), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(coalesce(ln((1 + n) / (1 + df)) + 1, CASE WHEN regexp_matches(term, '[0-9]') AND regexp_matches(term, '\p{{L}}') THEN 4.2 WHEN length(term) > 9 THEN 3.45 ELSE 3.0 END), 6) AS weight FROM t CROSS JOIN n LEFT JOIN df USING (term)")
def ret_08(t):
    asked_terms = t.benchmark.select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    df = t.documents.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(N().alias("df"))
    n = t.documents.agg(N().alias("n"))
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return asked_terms.join(df, "term", "left").join(F.broadcast(n)).select("term", F.round(rt.term_weight(F.col("term"), idf), 6).alias("weight"))


@query("ret_09", """WITH b AS (SELECT l_orderkey AS query, l_linenumber AS c, sum(l_extendedprice) AS base, max(l_discount) * 12 AS rr FROM lineitem GROUP BY 1, 2), f AS (SELECT *, CASE WHEN max(base) OVER w > min(base) OVER w THEN (base - min(base) OVER w) / (max(base) OVER w - min(base) OVER w) ELSE 0.5 END AS flat, max(base) OVER w AS hi FROM b WINDOW w AS (PARTITION BY query)),
m AS (SELECT *, 0.2::DOUBLE * flat + 0.8::DOUBLE * greatest(0, least(1, rr)) AS mix FROM f) SELECT query, c, round(CASE WHEN max(mix) OVER (PARTITION BY query) > 0 THEN mix / max(mix) OVER (PARTITION BY query) ELSE mix END, 6) AS share FROM m""")
def ret_09(t):
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("c")).agg(F.sum("l_extendedprice").alias("base"), (F.max("l_discount") * 12).alias("rr"))
    return rt.blended(b, "query").select("query", "c", F.round(F.col("score") / F.col("top"), 6).alias("share"))


@query("ret_10", f"WITH {KNN} SELECT query, max(cosine) AS confidence, max(cosine) FILTER (vec_id <> query) < 0.3 AS refused FROM kn WHERE rank <= 6 GROUP BY query")
def ret_10(t):
    near = vc.nearest(t.embeddings, asked(t), 6)
    return near.groupBy("query").agg(F.max("cosine").alias("confidence"), (F.max(F.when(F.col("vec_id") != F.col("query"), F.col("cosine"))) < 0.3).alias("refused"))


@query("ret_11", """WITH g AS (SELECT p_partkey AS gid, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS gw FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_partkey AS id, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 2 = 1),
s AS (SELECT id, gid, len(list_intersect(w, gw)) / len(list_distinct(list_concat(w, gw))) AS sim FROM a JOIN g USING (p_brand, p_size)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, gid) AS r FROM s WHERE sim >= 0.75) SELECT id, gid FROM r WHERE r = 1""")
def ret_11(t):
    """Equal names are compared once: each name of a brand and size finds its best one, with the least key of those that have it."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    asked = t.part.where("p_partkey % 2 = 1").select("p_partkey", "p_brand", "p_size", "p_name")
    names = asked.select("p_brand", "p_size", "p_name").distinct().withColumn("w", words("p_name"))
    known = t.part.where("p_partkey % 2 = 0").groupBy("p_brand", "p_size", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("gid")).withColumn("gw", words("name"))
    sim = F.size(F.array_intersect("w", "gw")) / F.size(F.array_union("w", "gw"))
    near = names.join(known, ["p_brand", "p_size"]).withColumn("sim", sim).where("sim >= 0.75")
    best = near.groupBy("p_brand", "p_size", "p_name").agg(F.max(F.struct("sim", (-F.col("gid")).alias("g"))).alias("b"))
    return asked.join(best, ["p_brand", "p_size", "p_name"]).select(F.col("p_partkey").alias("id"), (-F.col("b.g")).alias("gid"))


@query("ret_12", """WITH a AS (SELECT * FROM (VALUES (1, '15'), (2, '17'), (3, '999999'), (4, 'red')) a(query, article)), h AS (SELECT query, p_partkey, 0 AS tier FROM a JOIN part ON CAST(p_partkey AS VARCHAR) = article UNION ALL SELECT query, p_partkey, 1 FROM a JOIN part ON starts_with(CAST(p_partkey AS VARCHAR), article) UNION ALL SELECT query, p_partkey, 2 FROM a JOIN part ON list_contains(string_split(p_name, ' '), article)),
d AS (SELECT query, p_partkey, min(tier) AS tier FROM h GROUP BY query, p_partkey), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, p_partkey) AS r FROM d) SELECT CAST(query AS BIGINT) AS query, p_partkey, CAST(tier AS BIGINT) AS tier FROM b WHERE r <= 8""")
def ret_12(t):
    asks = F.broadcast(t.spark.createDataFrame([(1, "15"), (2, "17"), (3, "999999"), (4, "red")], "query long, article string"))  # a stated list
    code = t.part.withColumn("code", F.col("p_partkey").cast("string"))
    exact = code.join(asks, F.col("code") == F.col("article")).select("query", "p_partkey", F.lit(0).alias("tier"))
    begins = code.join(asks, F.startswith("code", "article")).select("query", "p_partkey", F.lit(1).alias("tier"))
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("article")).join(asks, "article").select("query", "p_partkey", F.lit(2).alias("tier"))
    best = exact.unionByName(begins).unionByName(words).groupBy("query", "p_partkey").agg(F.min("tier").cast("long").alias("tier"))
    r = F.row_number().over(Window.partitionBy("query").orderBy("tier", "p_partkey"))
    return best.withColumn("r", r).where("r <= 8").drop("r")


ROUTED = f"""{HYBRID3}, hs AS (SELECT query AS id, doc_id, score, rank FROM fin WHERE rank <= 6), cf AS (SELECT id, max(score) AS confidence FROM hs GROUP BY id), ar AS (SELECT item_id AS id, CASE item_id % 4 WHEN 1 THEN CAST(1000 + item_id AS VARCHAR) WHEN 2 THEN CAST(100000 + item_id AS VARCHAR) WHEN 3 THEN '99999999' END AS article FROM benchmark),
pp AS (SELECT p_partkey AS product, p_brand AS file, CASE WHEN p_partkey % 2 = 0 THEN CAST(1000 + p_partkey AS VARCHAR) ELSE CAST(100000 + p_partkey // 3 AS VARCHAR) || '.F' END AS article FROM part),
ex AS (SELECT id, product, file, pp.article FROM ar JOIN pp ON pp.article = ar.article), va AS (SELECT id, product, file, lower(pp.article) AS article FROM ar JOIN pp ON starts_with(pp.article, ar.article || '.') WHERE id NOT IN (SELECT id FROM ex)),
pm AS (SELECT id, product, file, row_number() OVER (PARTITION BY id ORDER BY article, product) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM va)), pr AS (SELECT * FROM pm WHERE n <= 8),
go AS (SELECT item_id AS id FROM benchmark WHERE item_id % 8 = 0), ro AS (SELECT item_id AS id, CASE WHEN item_id IN (SELECT id FROM go) THEN 'golden' WHEN item_id IN (SELECT id FROM pr) THEN 'price' WHEN confidence IS NULL THEN 'none' ELSE 'documents' END AS route,
 CASE WHEN item_id IN (SELECT id FROM go) OR item_id IN (SELECT id FROM pr) THEN 'answered' WHEN confidence IS NULL THEN 'nothing_found' WHEN confidence < 0.025::DOUBLE THEN 'low_confidence' ELSE 'answered' END AS stage, confidence FROM benchmark b LEFT JOIN cf ON cf.id = b.item_id)"""


def routing_inputs(t):
    """Every question with its curated answer, products and documents: what RET-11, RET-12 and RET-03 find."""
    k = F.col("item_id")
    more = F.when(k % 4 == 1, F.concat(F.lit(" цена арт. "), (1000 + k).cast("string"))).when(k % 4 == 2, F.concat(F.lit(" сколько стоит "), (100000 + k).cast("string"))).when(k % 4 == 3, F.lit(" артикул 99999999")).otherwise("")
    questions = written(t.benchmark.select(k.alias("id"), F.concat(F.coalesce("text", F.lit("")), more).alias("question")))
    # curated questions: those asked word for word
    curated = t.benchmark.where("item_id % 8 = 0").select(F.coalesce("text", F.lit("")).alias("question"))
    golden = questions.join(curated, "question", "left_semi").select("id")
    article = F.when(F.col("p_partkey") % 2 == 0, (1000 + F.col("p_partkey")).cast("string")).otherwise(F.concat((100000 + F.floor(F.col("p_partkey") / 3)).cast("string"), F.lit(".F")))
    products = t.part.select(F.col("p_partkey").alias("product"), article.alias("article"), F.col("p_brand").alias("file"))
    hits = written(hybrid(t).select(F.col("query").alias("id"), "doc_id", "score", "rank"))
    return questions, golden, written(ro.product_matches(questions, products)), hits


@query("ret_13", f"WITH {ROUTED} SELECT id, route, stage, confidence FROM ro")
def ret_13(t):
    return ro.routed(*routing_inputs(t), least=0.025)


@query("ret_14", r"SELECT conv_id, turn, length(text) < 40 AND NOT regexp_matches(text, '[0-9]') AS follow_up, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[\p{Lu}][\p{L}]{7,}'))), ',') AS entities FROM conversations WHERE role = 'user'")
def ret_14(t):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{Lu}][\p{L}]{7,}"), F.lit(0))))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", ((F.length("text") < 40) & ~F.col("text").rlike("[0-9]")).alias("follow_up"), F.array_join(found, ",").alias("entities"))


@query("ret_15", f"""WITH {ROUTED}, op AS (SELECT id, route, confidence FROM ro WHERE stage = 'answered' AND route <> 'golden'), fi AS (SELECT pr.id, file AS source, min(n) AS spot FROM pr JOIN op USING (id) WHERE op.route = 'price' GROUP BY pr.id, file),
ol AS (SELECT id, 'price' AS kind, source, spot FROM fi UNION ALL SELECT hs.id, 'document', CAST(doc_id AS VARCHAR), rank FROM hs JOIN op USING (id) WHERE op.confidence >= 0.025::DOUBLE)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'price' THEN 0 ELSE 1 END, spot, source) AS INTEGER) AS n, kind, source FROM ol""")
def ret_15(t):
    questions, golden, products, hits = routing_inputs(t)
    return ro.sources(ro.routed(questions, golden, products, hits, least=0.025), products, hits, least=0.025)


@query("agg_30", rf"WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY term HAVING count(*) > 5")
def agg_30(t):
    df = t.documents.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(N().alias("df")).where("df > 5")
    n = t.documents.agg(N().alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


@query("vec_02", r"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\-./]+')) AS term FROM documents) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, any_value(n) AS n FROM tf, n GROUP BY term HAVING (count(*) >= 2 OR regexp_matches(term, '[0-9]')) AND count(*) < 0.6::DOUBLE * any_value(n) ORDER BY df DESC, term LIMIT 60000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)) SELECT doc_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 5) AS top, round(sum(w) / sqrt(sum(w * w)), 4) AS total FROM w GROUP BY doc_id""")
def vec_02(t):
    return rt.tf_idf(t.documents).groupBy("doc_id").agg(N().alias("terms"), F.round(F.max("weight"), 5).alias("top"), F.round(F.sum("weight"), 4).alias("total"))


@query("vec_05", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def vec_05(t):
    h = F.sha2("text", 256).alias("h")
    cached = t.documents.where("doc_id % 2 = 0").select(h).distinct()
    return t.documents.where("text IS NOT NULL").select("doc_id", h).join(cached, "h", "left_anti").select("doc_id")


@query("vec_06", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x * 3)::DOUBLE * (x * 3)::DOUBLE))), 3) AS norm, 1.0::DOUBLE AS scaled FROM embeddings")
def vec_06(t):
    tripled = F.transform("embedding", lambda x: x * 3)
    scaled = unit(tripled)
    return t.embeddings.select("vec_id", F.round(F.sqrt(dot(tripled, tripled)), 3).alias("norm"), F.round(F.sqrt(dot(scaled, scaled)), 6).alias("scaled"))


PAIRS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), pr AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@query("jn_13", f"WITH {PAIRS} SELECT x, y, s FROM pr WHERE s >= 0.4 AND x < y")
def jn_13(t):
    return vc.alike(t.embeddings, 0.4)


@query("agg_09", f"WITH {PAIRS} SELECT count(*) FILTER (s > 0.4) AS alike, count(*) FILTER (s > 0.97) AS copies FROM pr WHERE x < y")
def agg_09(t):
    return vc.alike(t.embeddings, 0.4).agg(F.count_if(F.col("s") > 0.4).alias("alike"), F.count_if(F.col("s") > 0.97).alias("copies"))


@query("agg_10", f"WITH {PAIRS}, m AS (SELECT x, max(s) AS nearest FROM pr GROUP BY x), r AS (SELECT *, row_number() OVER (ORDER BY nearest, x) AS r FROM m WHERE nearest <= (SELECT quantile_cont(nearest, 0.02) FROM m)) SELECT x, nearest FROM r WHERE r <= 40")
def agg_10(t):
    """Orphans: of the nearest-neighbour similarities the lowest 2 %, at most 40 (a report's own bound)."""
    m = written(vc.alike(t.embeddings, -1.0, 1).select("x", F.col("s").alias("nearest")))
    limit = m.agg(F.percentile("nearest", F.lit(0.02)).alias("limit"))
    return m.join(F.broadcast(limit), F.col("nearest") <= F.col("limit")).orderBy("nearest", "x").limit(40).select("x", "nearest")


@query("top_04", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM pr WHERE s >= 0.2) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, s FROM r WHERE r <= 6")
def top_04(t):
    return vc.alike(t.embeddings, 0.2, 6).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s").distinct()


CENTROID = "ce AS (SELECT vec_id // 10 AS doc, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), cn AS (SELECT doc, list(m ORDER BY i) AS c FROM ce GROUP BY doc)"


def centroids(t):
    """Mean vector of each document's vectors, of length one; zero means are dropped."""
    parts = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("doc"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("doc", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return rows.where(dot(F.col("c"), F.col("c")) > 0).select("doc", unit(F.col("c")).alias("c"))


@query("agg_25", f"WITH {CENTROID} SELECT doc, round(c[1] / sqrt(list_dot_product(c, c)), 5) AS first, round(c[64] / sqrt(list_dot_product(c, c)), 5) AS last FROM cn")
def agg_25(t):
    return centroids(t).select("doc", F.round(F.get("c", F.lit(0)), 5).alias("first"), F.round(F.get("c", F.lit(63)), 5).alias("last"))
