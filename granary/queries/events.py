"""EV and ST queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import evaluation as ev
from granary.operators import incremental, paths, retention, structure
from granary.operators import patterns as pt
from granary.operators.tables import written
from granary.plans import kb
from granary.queries.registry import query
from granary.queries.retrieval import BM, lexical
from granary.queries.texts import STOP_SQL, TOKENS
from granary.streaming import tiers, vigil, windows

Q, FB, D = kb.QUESTIONS_SQL, kb.FEEDBACK_SQL, kb.LIBRARY_SQL
N = lambda: F.count(F.lit(1))

TRUTH = "tr AS (SELECT item_id AS query, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60)))"


def truth(t):
    """Documents that hold the first sixty characters of an item."""
    heads = t.benchmark.select(F.col("item_id").alias("query"), F.substring("text", 1, 60).alias("pattern"))
    return pt.held(t.documents.select("doc_id", "text"), "text", heads).join(heads, "pattern").select("query", "doc_id")


RK = f"{BM}, {TRUTH}, rk AS (SELECT tr.query, min(rank) AS rank FROM tr LEFT JOIN lex ON lex.query = tr.query AND lex.doc_id = tr.doc_id AND lex.rank <= 10 GROUP BY tr.query)"


def ranks(t, top: int = 10):
    return ev.first_ranks(lexical(t, top), truth(t))


@query("ev_01", f"WITH {RK} SELECT query, rank FROM rk")
def ev_01(t):
    return ranks(t).select("query", F.col("rank").cast("long").alias("rank"))


@query("ev_02", f"WITH {RK} SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 3) AS hit, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 3) AS mrr FROM rk")
def ev_02(t):
    return ev.quality(ranks(t))


RUNS = "a AS (SELECT p_partkey AS query, CASE WHEN p_size < 40 THEN p_size END AS rank FROM part), b AS (SELECT p_partkey AS query, CASE WHEN p_partkey % 7 > 0 THEN (p_size * 3) % 50 + 1 END AS rank FROM part)"


def two_runs(t):
    before = t.part.select(F.col("p_partkey").alias("query"), F.when(F.col("p_size") < 40, F.col("p_size")).alias("rank"))
    after = t.part.select(F.col("p_partkey").alias("query"), F.when(F.col("p_partkey") % 7 > 0, (F.col("p_size") * 3) % 50 + 1).alias("rank"))
    return before, after


@query("ev_03", f"WITH {RUNS}, s AS (SELECT query, b.rank IS NOT NULL AND (a.rank IS NULL OR b.rank < a.rank) AS bad FROM a JOIN b USING (query) WHERE query % 3 = 0) SELECT round(avg(CASE WHEN bad THEN 1.0::DOUBLE ELSE 0 END), 3) AS substituted FROM s")
def ev_03(t):
    expected, rejected = two_runs(t)
    both = expected.where("query % 3 = 0").join(rejected.withColumnRenamed("rank", "reject"), "query")
    bad = F.col("reject").isNotNull() & (F.col("rank").isNull() | (F.col("reject") < F.col("rank")))
    return both.agg(F.round(F.avg(bad.cast("double")), 3).alias("substituted"))


@query("ev_04", "SELECT conv_id, turn, contains(text, 'that') OR contains(text, 'les') AS has, NOT (contains(text, '***') OR contains(text, '###')) AS clean FROM conversations WHERE role = 'assistant'")
def ev_04(t):
    any_of = lambda *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains("text", x))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", any_of("that", "les").alias("has"), (~any_of("***", "###")).alias("clean"))


SET_SQL = """ds AS (SELECT item_id AS line, 'Question ' || (item_id - CASE WHEN item_id % 5 = 4 THEN 1 ELSE 0 END) AS question,
 CASE item_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['src'] WHEN 2 THEN ['Nothing here ' || item_id, 'SRC3/'] WHEN 3 THEN ['/DE/', 'src' || (item_id % 20) || '/'] ELSE ['doc_' || item_id || '_'] END AS expect_files,
 CASE WHEN item_id % 4 = 0 THEN ['yes'] ELSE [] END AS expect_text FROM benchmark)"""


def question_set(t):
    """A question set by the items' ids: repeated questions, patterns of all kinds, no rejects."""
    line, text = F.col("item_id"), lambda x: x.cast("string")
    strings = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]).cast("array<string>")
    files = (
        F.when(line % 6 == 0, strings()).when(line % 6 == 1, strings("src")).when(line % 6 == 2, strings(F.concat(F.lit("Nothing here "), text(line)), "SRC3/"))
        .when(line % 6 == 3, strings("/DE/", F.concat(F.lit("src"), text(line % 20), F.lit("/")))).otherwise(strings(F.concat(F.lit("doc_"), text(line), F.lit("_"))))
    )
    asked = F.concat(F.when(line % 5 == 4, "question ").otherwise(" Question "), text(F.when(line % 5 == 4, line - 1).otherwise(line)))
    return t.benchmark.select(line.alias("line"), asked.alias("question"), files.alias("expect_files"), F.when(line % 4 == 0, strings("yes")).otherwise(strings()).alias("expect_text"), strings().alias("reject_files"), strings().alias("reject_text"))


@query("ev_05", f"""WITH {D}, {SET_SQL}, c AS (SELECT line, f, count(d.id) AS n FROM (SELECT line, unnest(expect_files) AS f FROM ds) LEFT JOIN d ON contains(lower(rel_path), lower(f)) GROUP BY line, f), t AS (SELECT count(*) AS total FROM d),
b AS (SELECT line, lag(line) OVER (PARTITION BY question ORDER BY line) AS n FROM ds)
SELECT line, 'duplicate' AS problem, NULL AS detail, n FROM b WHERE n IS NOT NULL UNION ALL SELECT line, 'no_expects', NULL, 0 FROM ds WHERE len(expect_files) = 0
UNION ALL SELECT line, CASE WHEN n = 0 THEN 'dead' ELSE 'broad' END, f, n FROM c, t WHERE n = 0 OR n > greatest(20, total // 10)
UNION ALL SELECT -1, 'no_texts', NULL, count(*) FROM ds WHERE len(expect_text) = 0 UNION ALL SELECT -1, 'no_rejects', NULL, 0""")
def ev_05(t):
    return ev.audit(question_set(t), kb.library(t.documents)).withColumn("line", F.coalesce("line", F.lit(-1)))


WEIGHTS, ALPHAS, TOPS = [0.0, 0.5, 0.8, 1.0], [0.85, 1.0], [3, 6]
SWEEP = f"""{BM}, {TRUTH}, cd AS (SELECT query, lex.doc_id, score AS base, CASE WHEN effective_date IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, greatest(date_diff('day', effective_date, DATE '2025-01-01'), 0) / 540) END AS fresh,
 round(len(list_intersect(qw, list_distinct({TOKENS.replace('text', 'd.text')}))) / len(qw)::DOUBLE, 6) AS rr FROM lex JOIN d ON d.id = lex.doc_id JOIN (SELECT item_id, list_filter(list_distinct({TOKENS}), lambda x: length(x) >= 3 AND x NOT IN {STOP_SQL}) AS qw FROM benchmark) b ON b.item_id = query WHERE rank <= 20),
vs AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.5), (0.8), (1.0)) w(weight), (VALUES (0.85::DOUBLE), (1.0)) a(alpha)), ag AS (SELECT query, doc_id, weight, alpha, rr, alpha * round(base, 6) + (1 - alpha) * round(base, 6) * fresh * 2 AS aged FROM cd, vs),
mx AS (SELECT *, round((1 - weight) * CASE WHEN max(aged) OVER w > min(aged) OVER w THEN (aged - min(aged) OVER w) / (max(aged) OVER w - min(aged) OVER w) ELSE 0.5 END + weight * greatest(0, least(1, rr)), 6) AS mix FROM ag WINDOW w AS (PARTITION BY query, weight, alpha)),
pl AS (SELECT *, row_number() OVER (PARTITION BY query, weight, alpha ORDER BY mix DESC, doc_id) AS place FROM mx), fi AS (SELECT query, weight, alpha, min(place) AS place FROM pl WHERE EXISTS (SELECT 1 FROM tr WHERE tr.query = pl.query AND tr.doc_id = pl.doc_id) GROUP BY 1, 2, 3),
ou AS (SELECT weight, alpha, top, round(count(*) FILTER (place <= top) / (SELECT count(DISTINCT query) FROM tr)::DOUBLE, 3) AS hit, round(sum(CASE WHEN place <= top THEN 1.0::DOUBLE / place ELSE 0 END) / (SELECT count(DISTINCT query) FROM tr), 3) AS mrr FROM fi, (SELECT unnest([3, 6]) AS top) GROUP BY 1, 2, 3)"""


def candidates(t):
    """The best twenty of each question with their age and the share of the question's words that they hold."""
    d = kb.library(t.documents).select(F.col("id").alias("doc_id"), "text", "effective_date")
    asked = t.benchmark.select(F.col("item_id").alias("query"), tx.keywords(F.col("text")).alias("q"))
    fresh = F.when(F.col("effective_date").isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.datediff(F.to_date(F.lit("2025-01-01")), "effective_date"), F.lit(0)) / 540))
    rr = F.round(F.size(F.array_intersect("q", tx.tokens(F.col("text")))) / F.size("q"), 6)
    return lexical(t, 20).join(d, "doc_id").join(asked, "query").select("query", "doc_id", F.col("score").alias("base"), fresh.alias("fresh"), rr.alias("rr"))


@query("ev_06", f"WITH {SWEEP} SELECT weight, alpha, top, hit, mrr, row_number() OVER (ORDER BY mrr DESC, weight, alpha DESC, top) = 1 AS best FROM ou")
def ev_06(t):
    return ev.sweep(candidates(t), truth(t), WEIGHTS, ALPHAS, TOPS)


@query("ev_07", f"WITH {RUNS} SELECT query, CASE WHEN a.rank IS NOT NULL AND b.rank IS NULL THEN 'broken' WHEN a.rank IS NULL AND b.rank IS NOT NULL THEN 'fixed' WHEN b.rank > a.rank THEN 'worse' WHEN b.rank < a.rank THEN 'better' ELSE 'same' END AS change FROM a JOIN b USING (query)")
def ev_07(t):
    return ev.run_diff(*two_runs(t))


MODELS = """md AS (SELECT p_partkey AS line, 'Напор ' || p_name || ' ' || p_size || '/' || (p_size + 20) || CASE WHEN p_partkey % 3 = 0 THEN ' и 0,' || (p_size % 10) || '-' || p_size || '?' ELSE '' END AS question, ['f' || p_partkey] AS expect_files, [CAST(p_size AS VARCHAR)] AS expect_text FROM part)"""
SIGNED = r"regexp_extract_all(question, '[0-9]+(?:[.,][0-9]+)?(?:[/\-][0-9]+(?:[.,][0-9]+)?)+')"


def models(t):
    """A question on every part, by its signature."""
    size = F.col("p_size").cast("string")
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" и 0,"), (F.col("p_size") % 10).cast("string"), F.lit("-"), size, F.lit("?"))).otherwise("")
    asked = F.concat(F.lit("Напор "), "p_name", F.lit(" "), size, F.lit("/"), (F.col("p_size") + 20).cast("string"), more)
    return t.part.select(F.col("p_partkey").alias("line"), asked.alias("question"), F.array(F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("expect_files"), F.array(size).alias("expect_text"))


@query("ev_08", f"""WITH {MODELS} SELECT line, regexp_replace(question, '[0-9]+(?:[.,][0-9]+)?(?:[/\\-][0-9]+(?:[.,][0-9]+)?)+', '«МОДЕЛЬ-СОСЕД»', 'g') AS question, array_to_string(expect_files, ',') AS reject_files, array_to_string(list_concat(expect_text, {SIGNED}), ',') AS reject_text FROM md""")
def ev_08(t):
    out = ev.twins(models(t))
    return out.select("line", "question", F.array_join("reject_files", ",").alias("reject_files"), F.array_join("reject_text", ",").alias("reject_text"))


@query("ev_08_near", f"WITH {MODELS}, s AS (SELECT DISTINCT unnest({SIGNED}) AS x FROM md) SELECT a.x AS a, b.x AS b FROM s a, s b WHERE a.x <> b.x AND levenshtein(a.x, b.x) = 1")
def ev_08_near(t):
    return ev.neighbours(models(t).select(F.explode(F.regexp_extract_all("question", F.lit(ev.SIGNATURE), F.lit(0))).alias("signature")))


@query("ev_09", f"WITH {Q}, {FB}, s AS (SELECT q.id, fb.id AS f, verdict, unnest([q.id % 11, q.id % 13, q.id % 17, q.id % 19][1:3]) AS doc FROM q JOIN fb ON fb.query_id = q.id) SELECT id, doc, CAST(CASE verdict WHEN 'up' THEN 1 ELSE 0 END AS BIGINT) AS label FROM s")
def ev_09(t):
    rated = kb.questions(t.events).join(kb.feedback(t.events).select("query_id", "verdict"), F.col("id") == F.col("query_id"))
    sources = F.array(*[F.col("id") % k for k in (11, 13, 17, 19)])
    return rated.select("id", F.explode(F.slice(sources, 1, 3)).alias("doc"), (F.col("verdict") == "up").cast("long").alias("label"))


VERSIONS = [
    ("doc_id % 13 <> 0", "text"),
    ("doc_id % 10 <> 3", "CASE WHEN doc_id % 11 = 1 THEN 'v2 ' || doc_id ELSE text END"),
    ("doc_id % 7 <> 2", "CASE WHEN doc_id % 11 = 1 THEN 'v2 ' || doc_id WHEN doc_id % 17 = 4 THEN 'the same' ELSE text END"),
]


def _version_sql(k: int, where: str, text: str) -> str:
    """CTEs of one more version: ``i{k}`` (path, hash, status, twin_of, state)."""
    return f"""s{k} AS (SELECT 'd' || doc_id AS path, sha256(coalesce({text}, '')) AS hash, TRUE AS here FROM documents WHERE {where}),
n{k} AS (SELECT coalesce(s.path, i.path) AS path, s.hash, s.here IS NOT NULL AS here, i.status AS old, coalesce(s.hash = i.hash AND i.status <> 'deleted', FALSE) AS same FROM s{k} s FULL JOIN i{k - 1} i ON s.path = i.path),
k{k} AS (SELECT *, CASE WHEN here THEN first_value(path) OVER (PARTITION BY here, hash ORDER BY CASE WHEN same AND old = 'ok' THEN 0 ELSE 1 END, path) END AS keeper FROM n{k}),
i{k} AS (SELECT path, hash, CASE WHEN NOT here THEN 'deleted' WHEN keeper = path THEN 'ok' ELSE 'duplicate' END AS status, CASE WHEN keeper <> path THEN keeper END AS twin_of,
 CASE WHEN NOT here THEN 'deleted' WHEN keeper <> path THEN 'duplicate' WHEN same AND old = 'ok' THEN 'unchanged' WHEN same THEN 'promoted' WHEN old IS NULL OR old = 'deleted' THEN 'new' ELSE 'changed' END AS state FROM k{k}),
c{k} AS (SELECT {k} AS version, i.path, i.state, i.twin_of FROM i{k} i LEFT JOIN i{k - 1} o ON o.path = i.path WHERE i.state <> 'unchanged' AND NOT coalesce(i.status = o.status AND i.state IN ('deleted', 'duplicate') AND i.twin_of IS NOT DISTINCT FROM o.twin_of, FALSE))"""


FEED = "i0 AS (SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS hash, NULL::VARCHAR AS status, NULL::VARCHAR AS twin_of WHERE FALSE), " + ", ".join(_version_sql(k + 1, *v) for k, v in enumerate(VERSIONS))


def indexed(t):
    """An index that has followed three snapshots of the documents: texts go, come, change and become copies."""
    index = incremental.VersionedIndex(t.spark)
    for where, text in VERSIONS:
        index.take(t.documents.where(where).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce(F.expr(text.replace("'v2 ' || doc_id", "concat('v2 ', doc_id)")), F.lit("")), 256).alias("hash")))
    return index


@query("st_01", f"WITH {FEED} SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3")
def st_01(t):
    return indexed(t).changes()


@query("st_01_index", f"WITH {FEED} SELECT path, hash, status, twin_of FROM i3 WHERE status <> 'deleted'")
def st_01_index(t):
    index = indexed(t)
    return index.at(index.version).where("status <> 'deleted'").select("path", "hash", "status", "twin_of")


TREES = """fa AS (SELECT source AS p1, lang AS p2, 'c' || (doc_id % 5) AS p3 FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL AND lang IS NOT NULL),
fb AS (SELECT source AS p1, lang AS p2, CASE WHEN lang = 'en' AND doc_id % 5 = 1 THEN 'КАТАЛОГ' WHEN lang = 'de' AND doc_id % 5 = 2 THEN 'zz' ELSE 'c' || (doc_id % 5) END AS p3 FROM documents WHERE (doc_id % 7 <> 0 OR lang = 'fr') AND source <> 'src5' AND lang IS NOT NULL)"""


def _tree_sql(x: str) -> str:
    return f"""g{x} AS (SELECT p1 AS folder, '' AS parent, 1 AS depth, 0 AS files, count(DISTINCT p2) AS subfolders FROM f{x} GROUP BY p1 UNION ALL SELECT p1 || '/' || p2, p1, 2, 0, count(DISTINCT p3) FROM f{x} GROUP BY p1, p2
 UNION ALL SELECT p1 || '/' || p2 || '/' || p3, p1 || '/' || p2, 3, count(*), 0 FROM f{x} GROUP BY p1, p2, p3)"""


@query("st_03", f"""WITH {TREES}, {_tree_sql('a')}, {_tree_sql('b')}, lo AS (SELECT *, row_number() OVER (PARTITION BY parent, depth, files, subfolders ORDER BY folder) AS place FROM ga WHERE folder NOT IN (SELECT folder FROM gb)),
ln AS (SELECT *, row_number() OVER (PARTITION BY parent, depth, files, subfolders ORDER BY folder) AS place FROM gb WHERE folder NOT IN (SELECT folder FROM ga)), rn AS (SELECT ln.folder, lo.folder AS was FROM ln JOIN lo USING (parent, depth, files, subfolders, place)),
st AS (SELECT gb.folder, gb.files - ga.files AS change FROM gb JOIN ga USING (folder))
SELECT 'renamed' AS kind, folder, was, 0 AS change FROM rn UNION ALL SELECT 'added', folder, NULL, files FROM ln WHERE folder NOT IN (SELECT folder FROM rn) UNION ALL SELECT 'removed', folder, NULL, -files FROM lo WHERE folder NOT IN (SELECT was FROM rn)
UNION ALL SELECT 'unknown_category', folder, NULL, files FROM ln WHERE depth = 3 AND folder NOT IN (SELECT folder FROM rn) AND NOT folder LIKE '%/КАТАЛОГ'
UNION ALL SELECT CASE WHEN change > 0 THEN 'grew' ELSE 'shrank' END, folder, NULL, change FROM st WHERE abs(change) >= 5""")
def st_03(t):
    k, name = F.col("doc_id"), lambda c: F.concat_ws("/", "source", "lang", c, F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    plain = F.concat(F.lit("c"), (k % 5).cast("string"))
    moved = F.when((F.col("lang") == "en") & (k % 5 == 1), "КАТАЛОГ").when((F.col("lang") == "de") & (k % 5 == 2), "zz").otherwise(plain)
    rows = t.documents.where("source IS NOT NULL AND lang IS NOT NULL")
    before = structure.folder_stats(rows.where("doc_id % 7 <> 0").select(name(plain).alias("path")))
    after = structure.folder_stats(rows.where("(doc_id % 7 <> 0 OR lang = 'fr') AND source <> 'src5'").select(name(moved).alias("path")))
    known = t.spark.createDataFrame([(x,) for x in paths.FOLDER_TYPES], "name string")
    return structure.structure_events(before, after, known)


ISLANDS = "e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS before, event_id FROM events {w}), g AS (SELECT user_id, us, sum(CASE WHEN before IS NULL OR us - before > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e)"


@query("st_04", f"WITH {ISLANDS.format(w=chr(32) + 'WHERE event_type = ' + chr(39) + 'error' + chr(39), gap=86400000000)} SELECT user_id, CAST(n AS BIGINT) AS n, count(*) AS reports, min(us) AS opened, max(us) AS last_seen FROM g GROUP BY user_id, n")
def st_04(t):
    return windows.islands(t.events.where("event_type = 'error'"), 86_400_000_000).groupBy("user_id", "n").agg(N().alias("reports"), F.min("us").alias("opened"), F.max("us").alias("last_seen"))


SILENT = """WITH b AS (SELECT user_id AS key, epoch_us(ts) AS us FROM events), h AS (SELECT max(us) - 3600000000 AS as_of FROM b),
g AS (SELECT key, us + 86400000000 AS since, lead(us) OVER (PARTITION BY key ORDER BY us) AS back, as_of FROM b, h WHERE us <= as_of) SELECT key, since, back FROM g WHERE coalesce(back, as_of) > since"""


def beats(t):
    return t.events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("st_05", SILENT)
def st_05(t):
    as_of = beats(t).agg((F.max("us") - 3_600_000_000).alias("as_of")).scalar()
    return vigil.silences(beats(t), 86_400_000_000, as_of)


@query("st_05_stream", SILENT)
def st_05_stream(t):
    """The same by a stream run to its end, an hour's lateness allowed."""
    stream = windows.event_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema).select(F.col("user_id").alias("key"), "at")
    return vigil.replayed(t.spark, vigil.silences_stream(stream, 86_400_000_000), ["key", "since"], ["back"])


def lease_requests(rows):
    """Requests of three holders for seven resources, by the kinds of events."""
    action = F.when(F.col("event_type").isin("click", "purchase"), "acquire").when(F.col("event_type") == "error", "release").otherwise("beat")
    at = F.col("ts").cast("timestamp")
    return rows.select(
        (F.col("user_id") % 7).alias("key"), at.alias("at"), F.unix_micros(at).alias("us"), F.col("event_id").alias("id"), F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("holder"), action.alias("action")
    )


@query("st_05_leases")
def st_05_leases(t):
    requests = lease_requests(t.events)
    return vigil.leases(requests, 7_200_000_000)


@query("st_07", """WITH s AS (SELECT event_type AS name, epoch_us(ts) // 30000000 * 30 AS slot, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2), k AS (SELECT * FROM s WHERE slot > (SELECT max(slot) FROM s) - 20 * 86400),
t AS (SELECT 'sample' AS tier, 30 AS step UNION ALL SELECT 'five_minutes', 300 UNION ALL SELECT 'hour', 3600) SELECT tier, name, slot // step * step AS slot, count(*) AS n, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high FROM k, t GROUP BY 1, 2, 3""")
def st_07(t):
    """Tiers of the last twenty days of all events' values."""
    readings = t.events.select(F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), "value")
    samples = written(tiers.sampled(readings))
    newest = samples.agg(F.max("slot")).first()[0]
    return tiers.tiered(samples, newest, 20).withColumn("mean", F.round("mean", 6))


HOURLY = "SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


@query("st_08", HOURLY)
def st_08(t):
    return windows.hourly(t.events).select(F.unix_micros("hour").alias("hour"), "event_type", "n", "total")


@query("st_09", f"WITH {ISLANDS.format(w='', gap=900000000)} SELECT user_id, CAST(n AS BIGINT) AS n, count(*) AS events, min(us) AS started FROM g GROUP BY user_id, n")
def st_09(t):
    return windows.islands(t.events, 900_000_000).groupBy("user_id", "n").agg(N().alias("events"), F.min("us").alias("started"))


STORE_SQL = f"""{Q}, {FB}, tq AS (SELECT * FROM q), tf AS (SELECT id, query_id, user_id FROM fb), tt AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_id % 3 = 0), tu AS (SELECT DISTINCT user_id FROM events),
d1 AS (SELECT id FROM tq WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 25 DAYS), d2 AS (SELECT id FROM tt WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAYS),
q1 AS (SELECT * FROM tq WHERE id NOT IN (SELECT id FROM d1)), f1 AS (SELECT * FROM tf WHERE query_id NOT IN (SELECT id FROM d1)), t1 AS (SELECT * FROM tt WHERE id NOT IN (SELECT id FROM d2)), fu AS (SELECT user_id FROM tu WHERE user_id % 10 = 3),
fd AS (SELECT id FROM f1 WHERE user_id IN (SELECT user_id FROM fu) OR query_id IN (SELECT id FROM q1 WHERE user_id IN (SELECT user_id FROM fu))),
q2 AS (SELECT * FROM q1 WHERE user_id NOT IN (SELECT user_id FROM fu)), t2 AS (SELECT * FROM t1 WHERE user_id NOT IN (SELECT user_id FROM fu)), a2 AS (SELECT id FROM q2 WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS)"""


def stored(t):
    """Questions, feedback, traces and users in a store of their own."""
    store = retention.Store(t.spark)
    store.save("queries", kb.questions(t.events).select("id", "user_id", "created_at", "stage"))
    at = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    store.save("feedback", kb.feedback(t.events).select("id", "query_id", "user_id").join(at, "id"))
    store.save("traces", t.events.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), "user_id", "ts"))
    store.save("users", t.events.select("user_id").distinct())
    return store


def retained(t):
    """(step, what, n) of a store that is cleaned, forgets a tenth of its users and anonymises, each first counted only."""
    store, as_of, told = stored(t), F.expr("TIMESTAMP_NTZ'2024-01-31'"), []
    users = store.table("users").where("user_id % 10 = 3")
    steps = (
        ("clean", lambda dry: store.clean(as_of, 25, 20, dry)), ("forget", lambda dry: store.forget(users, dry=dry)), ("anonymize", lambda dry: store.anonymize(as_of, 10, dry)),
    )
    for step, run in steps:
        told += [(step, what, n, dry) for dry in (True, False) for what, n in run(dry).items()]
    return store, told


@query("st_10", f"""WITH {STORE_SQL}, n AS (SELECT 'clean' AS step, 'queries' AS what, (SELECT count(*) FROM d1) AS n UNION ALL SELECT 'clean', 'feedback', (SELECT count(*) FROM tf WHERE query_id IN (SELECT id FROM d1)) UNION ALL SELECT 'clean', 'traces', (SELECT count(*) FROM d2)
UNION ALL SELECT 'forget', 'feedback', (SELECT count(*) FROM fd) UNION ALL SELECT 'forget', 'queries', (SELECT count(*) FROM q1) - (SELECT count(*) FROM q2) UNION ALL SELECT 'forget', 'traces', (SELECT count(*) FROM t1) - (SELECT count(*) FROM t2) UNION ALL SELECT 'forget', 'users', (SELECT count(*) FROM fu)
UNION ALL SELECT 'anonymize', 'queries', (SELECT count(*) FROM a2) UNION ALL SELECT 'anonymize', 'traces', (SELECT count(*) FROM t2 WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS)) SELECT step, what, n, dry FROM n, (SELECT unnest([TRUE, FALSE]) AS dry)""")
def st_10(t):
    """What each step said it would delete and what it deleted."""
    return t.spark.createDataFrame(retained(t)[1], "step string, what string, n long, dry boolean")


@query("st_10_left", f"WITH {STORE_SQL} SELECT id, CASE WHEN id NOT IN (SELECT id FROM a2) THEN user_id END AS user_id, stage FROM q2")
def st_10_left(t):
    return retained(t)[0].table("queries").select("id", "user_id", "stage")


@query("st_08_stream", HOURLY)
def st_08_stream(t):
    return windows.replayed_hourly(t.spark, f"{t.folder}/events.parquet", t.events.schema)
