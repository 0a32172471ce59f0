"""SRC and SNK queries over stored pages and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import analytics as an
from granary.plans import kb
from granary.queries.registry import query
from granary.sources import files, html

D = kb.LIBRARY_SQL
N = lambda: F.count(F.lit(1))

TAGS = ("script", "style", "nav", "footer", "header", "noscript")
DROP_SQL = "|".join(f"<{x}[^>]*>.*?</{x}>" for x in TAGS)
TEXT_SQL = rf"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is){DROP_SQL}', ' ', 'g'), '(?s)<[^>]+>', E'\n', 'g'), '&nbsp;', ' ', 'g'), E'\n'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: length(x) > 2), E'\n')"""


NAMES = ["plan.xlsx", "draw.dwg", "pack.zip", "note.TXT", "scan.pdf", "~$open.docx", "._note.txt", "Thumbs.db", "page_files/x.html", "clip.mp4", "odd.xyz", "noext", "big.xls"]
KINDS = ["table", "asset", "archive", "text", "text", "skip", "skip", "skip", "skip", "asset", "skip", "skip", "asset"]


@query("src_02", f"WITH {D} SELECT id, {KINDS}[CAST(id % 13 AS INTEGER) + 1] AS kind FROM d")
def src_02(t):
    names = F.array(*[F.lit(x) for x in NAMES])
    path = F.concat(F.lit("root/"), F.get(names, (F.col("id") % 13).cast("int")))
    size = F.when(F.col("id") % 13 == 12, F.lit(21 << 20)).otherwise(F.col("text_chars"))
    return kb.library(t.documents).select("id", files.kind_of(path, size).alias("kind"))


@query("src_03", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'drawing' WHEN 1 THEN 'video' WHEN 2 THEN 'image' ELSE 'other' END AS kind FROM part")
def src_03(t):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("dwg", "mp4", "png", "xyz")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", html.asset_kind(ext).alias("kind"))


@query("src_11", f"SELECT page_id, sha256({TEXT_SQL}) AS digest FROM pages")
def src_11(t):
    return t.pages.select("page_id", F.sha2(html.text_of(F.col("html")), 256).alias("digest"))


@query("src_18", "SELECT o_orderkey, o_totalprice / (o_custkey + 1) <= 200 AS safe FROM orders")
def src_18(t):
    return t.orders.select("o_orderkey", html.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") + 1).alias("safe"))


@query("src_19", f"WITH {D}, n AS (SELECT brand, list(id ORDER BY id) AS ids FROM d GROUP BY brand) SELECT id, brand || ', ' || text_chars || ' characters, beside ' || array_to_string(list_filter(ids, lambda x: x <> id)[1:12], ' ') AS card FROM d JOIN n USING (brand)")
def src_19(t):
    d = kb.library(t.documents)
    place = F.row_number().over(Window.partitionBy("brand").orderBy("id"))
    first = d.select("brand", "id", place.alias("r")).where("r <= 13").groupBy("brand").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    beside = F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, 12)
    card = F.concat("brand", F.lit(", "), F.col("text_chars").cast("string"), F.lit(" characters, beside "), F.array_join(beside.cast("array<string>"), " "))
    return d.select("id", "brand", "text_chars").join(first, "brand").select("id", card.alias("card"))


@query("src_23", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def src_23(t):
    return t.pages.select("page_id", html.title_of(F.col("html")).alias("title"))


@query("src_24", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS href FROM pages), a AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link FROM l WHERE starts_with(href, '/') OR starts_with(href, 'http'))
SELECT DISTINCT page_id, split_part(split_part(link, '#', 1), '?', 1) AS link, regexp_extract(link, '^https?://([^/]+)', 1) = host AS same_host, regexp_matches(lower(split_part(split_part(link, '#', 1), '?', 1)), '\.pdf$') AS is_pdf FROM a""")
def src_24(t):
    return html.links(t.pages)


@query("src_25", """WITH n AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM customer), a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 10::BIGINT * 16777216 + ip % 16777216 WHEN 1 THEN 172::BIGINT * 16777216 + ip % 16777216 WHEN 2 THEN 192::BIGINT * 16777216 + 168 * 65536 - 3 + c_custkey % 7 ELSE ip END AS ip FROM n)
SELECT c_custkey, CASE WHEN c_custkey % 11 = 7 THEN NULL WHEN c_custkey % 11 = 5 THEN CAST(c_custkey % 256 AS INTEGER) BETWEEN 252 AND 253 OR (c_custkey % 256 = 254)
 ELSE ip // 16777216 IN (0, 10, 127) OR ip // 1048576 = 172 * 16 + 1 OR ip // 65536 IN (192 * 256 + 168, 169 * 256 + 254) OR ip // 4194304 = 100 * 4 + 1 OR ip // 256 = 192 * 65536 OR ip // 131072 = 198 * 128 + 9 END AS blocked FROM a""")
def src_25(t):
    """Addresses of both versions all over their spaces, and texts that are none."""
    k = F.col("c_custkey")
    ip = (k * 2654435761) % 4294967296
    ip = F.when(k % 6 == 0, F.lit(10 << 24) + ip % (1 << 24)).when(k % 6 == 1, F.lit(172 << 24) + ip % (1 << 24)).when(k % 6 == 2, F.lit((192 << 24) + (168 << 16) - 3) + k % 7).otherwise(ip)
    dotted = F.concat_ws(".", *[(F.shiftright(ip, 24 - 8 * n) % 256).cast("string") for n in range(4)])
    six = F.concat(F.lower(F.lpad(F.hex(k % 256), 2, "0")), F.when(k % 256 == 254, "80").otherwise("12"), F.lit("::"), F.lower(F.hex(k % 65536)))
    rows = t.customer.select("c_custkey", F.when(k % 11 == 7, F.concat(F.lit("host"), k.cast("string"), F.lit(".example"))).when(k % 11 == 5, six).otherwise(dotted).alias("address"))
    nets = t.spark.createDataFrame([(x,) for x in html.BLOCKED], "network string")
    return html.blocked(rows, "address", nets).select("c_custkey", "blocked")


@query("src_26", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages WHERE page_id % 7 > 0 GROUP BY 1")
def src_26(t):
    text = F.concat(F.lit("[InternetShortcut]\r\nIconIndex=0\r\n"), F.when(F.col("page_id") % 7 == 0, F.lit("BASEURL=")).otherwise(F.lit("url=")), "url", F.lit("\r\n"))
    return html.shortcut_hosts(t.pages.select(text.alias("content")))


@query("src_29", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') AND contains(props, '7') ORDER BY ts DESC, event_id DESC LIMIT 200")
def src_29(t):
    logs = t.events.where("event_type = 'error'").unionByName(t.events.where("event_type = 'view'"))
    return logs.where(F.contains("props", F.lit("7"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


@query("snk_03", "SELECT 'kb_calls_total{model=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def snk_03(t):
    return t.events.groupBy("event_type").agg(N().alias("n")).select(F.concat(F.lit('kb_calls_total{model="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


FOUND = f"""{D}, x AS (SELECT *, CASE WHEN id % 19 > 0 THEN doc_type END AS kind, CASE id % 3 WHEN 0 THEN upper(brand) WHEN 1 THEN brand ELSE brand || '-' END AS mark, regexp_extract(CASE WHEN id % 17 = 3 THEN 'scan of ' || id WHEN id % 17 = 5 THEN 'list (2)' ELSE 'ok' END, '(scan|copy|\\([0-9]+\\))', 1) AS bad FROM d),
h AS (SELECT content_hash, count(*) AS n, min(rel_path) AS first FROM x GROUP BY 1), m AS (SELECT mark, [k FOR k IN ['price list', 'catalogue', 'passport'] IF NOT list_contains(coalesce(list(DISTINCT kind), []), k)] AS missing FROM x GROUP BY mark)"""


@query("snk_04", f"""WITH {FOUND}, r AS (SELECT 'без типа' AS category, rel_path AS path, 'type ' || (id % 5) AS detail FROM x WHERE kind IS NULL UNION ALL SELECT 'без даты', rel_path, '' FROM x WHERE effective_date IS NULL AND kind IN ('price list', 'catalogue') UNION ALL SELECT 'плохое имя', rel_path, bad FROM x WHERE bad <> ''
UNION ALL SELECT 'дубль', rel_path, 'копий: ' || n FROM x JOIN h USING (content_hash) WHERE n > 1 AND rel_path <> first UNION ALL SELECT 'бренды-двойники', string_agg(DISTINCT mark, ' | ' ORDER BY mark), '' FROM x WHERE mark IS NOT NULL GROUP BY regexp_replace(lower(mark), '[^0-9a-zа-я]', '', 'g') HAVING count(DISTINCT mark) > 1
UNION ALL SELECT 'пробел покрытия', mark, array_to_string(missing, ', ') FROM m WHERE len(missing) > 0 AND mark IS NOT NULL) SELECT '"' || category || '";"' || replace(path, '"', '""') || '";"' || detail || '"' AS line FROM r""")
def snk_04(t):
    k = F.col("id")
    name = F.when(k % 17 == 3, F.concat(F.lit("scan of "), k.cast("string"))).when(k % 17 == 5, F.lit("list (2)")).otherwise("ok")
    mark = F.when(k % 3 == 0, F.upper("brand")).when(k % 3 == 1, F.col("brand")).otherwise(F.concat("brand", F.lit("-")))
    docs = kb.library(t.documents).select(
        "rel_path", mark.alias("brand"), F.when(k % 19 > 0, F.col("doc_type")).alias("doc_type"), "effective_date", "content_hash",
        F.concat(F.lit("type "), (k % 5).cast("string")).alias("hint"), F.lit("").alias("mtime_hint"), F.regexp_extract(name, r"(scan|copy|\([0-9]+\))", 1).alias("bad_word"),
    )
    return an.problem_lines(an.problems(docs, ["price list", "catalogue", "passport"], ["price list", "catalogue"]))
