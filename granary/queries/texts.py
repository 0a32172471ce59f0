"""TXT queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import stem as st
from granary.functions import text as tx
from granary.operators import chunks as ck
from granary.operators import paths as pm
from granary.operators.common import running_sums
from granary.operators.tables import spread
from granary.plans import kb
from granary.queries.registry import query
from granary.sources import html

D = kb.LIBRARY_SQL
N = lambda: F.count(F.lit(1))
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOP_SQL = "(" + ", ".join(f"'{x}'" for x in tx.STOP) + ")"
CANON_SQL = r'''regexp_replace(regexp_replace(translate(t, 'ёЁ³²¹Øø∅×–—−«»°', 'еЕ321dddx---""'), '(\d),(\d)', '\1.\2', 'g'), '(м3)\s*(/|в)\s*(час|ч)', 'м3/ч', 'gi')'''


@query("txt_01", f"WITH s AS (SELECT doc_id, 'подача ' || (doc_id % 90) || ',' || (doc_id % 7) || ' м³/час — «Øx» ' || lang AS t FROM documents) SELECT doc_id, {CANON_SQL} AS canon FROM s")
def txt_01(t):
    text = F.concat(F.lit("подача "), (F.col("doc_id") % 90).cast("string"), F.lit(","), (F.col("doc_id") % 7).cast("string"), F.lit(" м³/час — «Øx» "), "lang")
    return t.documents.select("doc_id", tx.canon(text).alias("canon"))


COMMA = r"regexp_replace({}, '(\d),(\d)', '\1.\2', 'g')"  # twice: a digit may stand between two commas


@query("txt_02", rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace({COMMA.format(COMMA.format("translate(translate(text, 'ёЁ³²¹Øø∅×–—−«»°', 'еЕ321dddx---" + '""' + "'), chr(160) || chr(173), ' ')"))}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '[.·]{{6,}}', ' ... ', 'g'), E' \n')) AS digest FROM documents""")
def txt_02(t):
    return t.documents.select("doc_id", F.sha2(tx.chunk_text(F.col("text")), 256).alias("digest"))


@query("txt_03", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) BETWEEN 4 AND 99 AND NOT regexp_matches(line, '[.,;]$') AND (regexp_matches(line, '^#{1,4} ') OR regexp_matches(line, '^[0-9]+(\.[0-9]+)*\.? +[\p{Lu}]') OR regexp_matches(line, '^[\p{Lu}\p{N} -]{4,}$'))) AS headings FROM l GROUP BY doc_id""")
def txt_03(t):
    lines = F.split("text", "\n")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, tx.is_heading)).cast("long").alias("headings"))


def chunked(t):
    """Chunks of every document, each text one page."""
    return ck.document_chunks(spread(t.documents).select("doc_id", F.array("text").alias("pages")), "doc_id", "pages")


@query("txt_04")
def txt_04(t):
    pages = t.pages.select("page_id", F.lit(1).alias("page"), tx.chunk_text(html.text_of(F.col("html"))).alias("text"))
    return ck.page_blocks(pages, "page_id").select("page_id", "n", "heading", F.sha2("body", 256).alias("body_sha256"), "is_table")


@query("txt_05")
def txt_05(t):
    """A price table of each brand, as one page."""
    row = F.concat_ws(" | ", "p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    rows = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("r"))
    page = F.concat(F.lit("Name | Size | Price\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"))
    return ck.document_chunks(rows.select("p_brand", F.array(page).alias("pages")), "p_brand", "pages").select("p_brand", "ord", "text")


@query("txt_06")
def txt_06(t):
    return chunked(t).select("doc_id", "ord", "heading", F.sha2("text", 256).alias("digest"))


@query("txt_07")
def txt_07(t):
    return chunked(t).groupBy("doc_id").agg(N().alias("kept"), F.min(F.length("text")).cast("long").alias("least"))


@query("txt_08", f"WITH {D} SELECT id, concat_ws(', ', brand, doc_type, '«' || section || '»', CASE WHEN effective_date IS NOT NULL THEN 'of ' || effective_date END) AS context FROM d")
def txt_08(t):
    dated = F.when(F.col("effective_date").isNotNull(), F.concat(F.lit("of "), F.col("effective_date").cast("string")))
    return kb.library(t.documents).select("id", F.concat_ws(", ", "brand", "doc_type", F.concat(F.lit("«"), "section", F.lit("»")), dated).alias("context"))


@query("txt_09", r"""SELECT doc_id, sha256(concat_ws(E'\n', nullif(source, 'src1'), nullif(lang, ''), text)) AS digest FROM documents""")
def txt_09(t):
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\n", F.nullif("source", F.lit("src1")), F.nullif("lang", F.lit("")), "text"), 256).alias("digest"))


@query("txt_10", r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'price 0' || (p_partkey % 9 + 1) || '.1' || (p_partkey % 3) || '.2019' WHEN 1 THEN 'cat_2021-0' || (p_partkey % 9 + 1) || '-15.pdf' WHEN 2 THEN 'x 150' || (p_partkey % 9 + 1) || '22 y' ELSE 'list 2018' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2019-1' || (p_partkey % 3) || '-0' || (p_partkey % 9 + 1) WHEN 1 THEN '2021-0' || (p_partkey % 9 + 1) || '-15' WHEN 2 THEN '2022-0' || (p_partkey % 9 + 1) || '-15' ELSE '2018-01-01' END AS dated FROM n""")
def txt_10(t):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'price 0' || (p_partkey % 9 + 1) || '.1' || (p_partkey % 3) || '.2019' WHEN 1 THEN 'cat_2021-0' || (p_partkey % 9 + 1) || '-15.pdf' WHEN 2 THEN 'x 150' || (p_partkey % 9 + 1) || '22 y' ELSE 'list 2018' END")
    return t.part.select("p_partkey", tx.name_date(name).cast("string").alias("dated"))


STEM_SQL = "lower(regexp_replace(split_part(rel_path, '/', -1), '\\.[A-Za-z0-9]+$', ''))"
for _p in (r"[0-3]?[0-9][._-][01]?[0-9][._-](19|20)?[0-9]{2}", r"[ _-]v[0-9]+", r"\([0-9]+\)", r"(19|20)[0-9]{2}"):
    STEM_SQL = f"regexp_replace({STEM_SQL}, '{_p}', ' ', 'g')"


@query("txt_11", f"WITH {D} SELECT id, concat_ws('|', brand, doc_type, trim(regexp_replace({STEM_SQL}, '[ _.-]+', ' ', 'g'))) AS key FROM d")
def txt_11(t):
    name = F.element_at(F.split("rel_path", "/"), -1)
    return kb.library(t.documents).select("id", tx.version_key(F.col("brand"), F.col("doc_type"), name).alias("key"))


PATH_SQL = """pa AS (SELECT doc_id AS id, lang || '/' || source || '/' || CASE doc_id % 5 WHEN 0 THEN 'SPL_Radiators (Ann B)/' WHEN 1 THEN 'XY ' || source || '/' WHEN 2 THEN 'ABC_/' ELSE '' END
 || CASE doc_id % 9 WHEN 0 THEN '1КАТАЛОГ/' WHEN 1 THEN '2ПРАЙС_ЛИСТ/' WHEN 2 THEN ' ПАСПОРТ /' WHEN 3 THEN 'Старые прайсы/' WHEN 4 THEN '12СХЕМЫ_НАСОСОВ/' WHEN 5 THEN 'Misc/' WHEN 6 THEN 'АРХИВ/3РУКОВОДСТВО/' WHEN 7 THEN '11ДЕКЛАРАЦИИ/' ELSE '' END
 || 'Doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.CSV' ELSE '.pdf' END AS rel_path FROM documents)"""


def paths_of(t):
    """Paths with lines, categories, archives and files of several kinds."""
    k = F.col("doc_id")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (k % n).cast("int"))
    line = pick(5, "SPL_Radiators (Ann B)/", F.concat(F.lit("XY "), "source", F.lit("/")), "ABC_/", "", "")
    category = pick(9, "1КАТАЛОГ/", "2ПРАЙС_ЛИСТ/", " ПАСПОРТ /", "Старые прайсы/", "12СХЕМЫ_НАСОСОВ/", "Misc/", "АРХИВ/3РУКОВОДСТВО/", "11ДЕКЛАРАЦИИ/", "")
    name = F.concat(F.lit("Doc_"), k.cast("string"), pick(4, ".xlsx", ".CSV", ".pdf", ".pdf"))
    return t.documents.select(k.alias("id"), F.concat(F.concat_ws("/", "lang", "source", F.lit("")), line, category, name).alias("rel_path"))


@query("txt_12", f"""WITH {PATH_SQL}, c AS (SELECT *, id % 9 AS c, split_part(rel_path, '/', 2) AS own, split_part(rel_path, '/', 3) AS third FROM pa WHERE rel_path IS NOT NULL)
SELECT id, split_part(rel_path, '/', 1) AS section, CASE id % 5 WHEN 0 THEN own || ' / SPL Radiators' WHEN 1 THEN own || ' / XY ' || own WHEN 2 THEN own || ' / ABC' ELSE own END AS brand,
 coalesce(CASE c WHEN 0 THEN 'КАТАЛОГ' WHEN 1 THEN 'ПРАЙС-ЛИСТ' WHEN 2 THEN 'ПАСПОРТ' WHEN 4 THEN 'СХЕМЫ НАСОСОВ' WHEN 6 THEN 'РУКОВОДСТВО' WHEN 7 THEN 'СЕРТИФИКАТ' END, CASE WHEN id % 4 < 2 THEN 'ТАБЛИЦА' END) AS doc_type, c IN (3, 6) AS archive FROM c""")
def txt_12(t):
    types = t.spark.createDataFrame(list(pm.FOLDER_TYPES.items()), "name string, doc_type string")
    out = pm.path_meta(paths_of(t).where("rel_path IS NOT NULL"), "rel_path", types)
    return out.select("id", "section", "brand", "doc_type", F.col("is_archive").alias("archive"))


@query("txt_14", "SELECT doc_id, sha256(text) AS full_hash, sha256(substr(text, 1, 64) || substr(text, greatest(length(text) - 63, 1)) || length(text)) AS quick FROM documents WHERE text IS NOT NULL")
def txt_14(t):
    tail = F.expr("substring(text, greatest(length(text) - 63, 1), 64)")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("full_hash"), F.sha2(F.concat(F.substring("text", 1, 64), tail, F.length("text").cast("string")), 256).alias("quick"))


#: forms of words and their stem; codes stay
FORMS = {
    "скважин": "скважина скважины скважине скважинный скважинного скважинных", "насос": "насос насоса насосу насосом насосы насосов насосами",
    "уплотн": "уплотнение уплотнения уплотнений", "давл": "давление давления давлением", "клап": "клапан клапана клапаны клапанов клапаном",
    "температур": "температура температуры температуре", "фильтр": "фильтр фильтра фильтры фильтров", "кабел": "кабель кабеля кабелем кабели",
    "500095.f": "500095.f", "2eco6-38": "2eco6-38", "wrp-a": "wrp-a", "м3": "м3", "abc": "abc", "pump": "pump",
}
FORM_ROWS = [(w, stem) for stem, words in FORMS.items() for w in words.split()]


@query("txt_15", "SELECT p_partkey, word, stem FROM part, (VALUES " + ", ".join(f"({i}, '{w}', '{x}')" for i, (w, x) in enumerate(FORM_ROWS)) + f") f(i, word, stem) WHERE p_partkey % {len(FORM_ROWS)} = i")
def txt_15(t):
    words = F.array(*[F.lit(w) for w, _ in FORM_ROWS])
    word = F.get(words, (F.col("p_partkey") % len(FORM_ROWS)).cast("int"))
    return t.part.select("p_partkey", word.alias("word")).select("p_partkey", "word", st.normalized(F.col("word")).alias("stem"))


BIG_STOP = "(" + ", ".join(f"'{x}'" for x in st.STOP) + ")"


@query("txt_16", rf"""WITH t AS (SELECT unnest(regexp_extract_all(lower({COMMA.format(COMMA.format("translate(text, 'ёЁ³²¹Øø∅×–—−«»°', 'еЕ321dddx---" + '""' + "')"))}), '[a-zа-яё0-9][a-zа-яё0-9\-./]+')) AS raw FROM documents) SELECT trim(raw, '-./') AS term, count(*) AS n FROM t WHERE raw NOT IN {BIG_STOP} GROUP BY 1 HAVING count(*) > 20""")
def txt_16(t):
    """Stems are taken of different tokens, counted before."""
    raw = spread(t.documents).select(F.explode(st.raw_tokens(F.col("text"))).alias("raw")).groupBy("raw").agg(N().alias("n"))
    return raw.select(st.normalized(F.col("raw")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n")).where("n > 20")


@query("txt_17", rf"""WITH t AS (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\-./]*')), '-./') AS term FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM t WHERE length(term) >= 2 AND term NOT IN {STOP_SQL} GROUP BY doc_id""")
def txt_17(t):
    own = tx.rerank_tokens(F.col("text"))
    return t.documents.select("doc_id", own.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("terms")).where("n > 0")


@query("txt_18", rf"WITH t AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS w FROM benchmark) SELECT item_id, string_agg(w, ' ' ORDER BY w) AS keywords FROM t WHERE length(w) >= 3 AND w NOT IN {STOP_SQL} GROUP BY item_id")
def txt_18(t):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(tx.keywords(F.col("text"))), " ").alias("keywords")).where("keywords <> ''")


SYNONYM_ROWS = ", ".join(f"({i}, '{w}', '{' '.join(x)}')" for i, (w, x) in enumerate(tx.SYNONYMS.items()))


@query("txt_19", f"SELECT p_partkey, word, said FROM part JOIN (VALUES {SYNONYM_ROWS}) s(i, word, said) ON p_partkey % {len(tx.SYNONYMS)} = i")
def txt_19(t):
    words = F.array(*[F.lit(w) for w in tx.SYNONYMS])
    word = F.get(words, (F.col("p_partkey") % len(tx.SYNONYMS)).cast("int"))
    return t.part.select("p_partkey", word.alias("word")).select("p_partkey", "word", F.array_join(tx.synonyms(F.array("word", F.lit("red"))), " ").alias("said"))


ASKED_SQL = rf"""aw AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM (SELECT item_id, trim(raw, '-./') AS w, i FROM (SELECT item_id, unnest(raw) AS raw, unnest(range(1, len(raw) + 1)) AS i FROM
 (SELECT item_id, regexp_extract_all(lower({COMMA.format(COMMA.format("translate(coalesce(text, ''), 'ёЁ³²¹Øø∅×–—−«»°', 'еЕ321dddx---" + '""' + "')"))}), '[\p{{L}}\p{{N}}_\-./]{{2,}}') AS raw FROM benchmark))
 WHERE raw NOT IN {STOP_SQL} AND (length(raw) > 2 OR regexp_matches(raw, '^[0-9]+(\.[0-9]+)?$')) AND trim(raw, '-./') <> '')),
qa AS (SELECT DISTINCT item_id AS query, w AS term, FALSE AS is_prefix FROM aw WHERE r <= 16 UNION SELECT DISTINCT item_id, w, TRUE FROM aw WHERE r <= 16 AND length(w) > 4 AND regexp_matches(w, '^\p{{L}}+$'))"""


@query("txt_20", f"WITH {ASKED_SQL} SELECT query AS item_id, term, is_prefix FROM qa")
def txt_20(t):
    return t.benchmark.select("item_id", F.explode(st.query_terms(F.col("text"))).alias("q")).select("item_id", "q.term", "q.is_prefix")


@query("txt_21", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Город МОСКВА SP-45' WHEN 1 THEN 'насос Grundfos' ELSE 'MOCKBA' END AS fixed FROM part")
def txt_21(t):
    text = F.when(F.col("p_partkey") % 3 == 0, "Город МОCКВА SP-45").when(F.col("p_partkey") % 3 == 1, "насос Grundfos").otherwise("MOCKBA")
    return t.part.select("p_partkey", tx.homoglyphs(text).alias("fixed"))


@query("txt_22", r"""WITH s AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[\p{L}\p{N}\p{P}\s]', '', 'g')) AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n = 0 OR l < 20 THEN 0.0::DOUBLE ELSE round(greatest(0::DOUBLE, least(1::DOUBLE, l / n * 3 - j / n * 5)), 4) END AS quality FROM s""")
def txt_22(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", tx.quality(F.col("text")).alias("quality"))


SIGNED_SQL = r"""WITH s AS (SELECT doc_id, text || ' Pump 55/75 арт. AB-' || doc_id || ', код: ' || (1900 + doc_id) || ' and ' || (500000 + doc_id) || '.f, 0,5-40' AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b[0-9]+(?:[.,][0-9]+)?(?:[/\-][0-9]+(?:[.,][0-9]+)?)+\b'))), '|') AS models,
 array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(t, '(?i)код\s*[:№]?\s*([A-Za-zА-Яа-я0-9][\w./\-]{2,20})', 1), regexp_extract_all(t, '(?:арт\.) (AB-[0-9]+)', 1),
 list_filter(regexp_extract_all(t, '(?i)\b[0-9]{4,8}(?:\.[A-ZА-Я0-9]{1,3})?\b'), lambda x: NOT regexp_matches(x, '^(19|20)[0-9][0-9](\.|$)'))), lambda x: lower(x)))), '|') AS articles FROM s"""


@query("txt_23", SIGNED_SQL)
def txt_23(t):
    """Signatures of models and articles of every text, with some of all kinds added."""
    k = F.col("doc_id")
    more = F.concat(F.col("text"), F.lit(" Pump 55/75 арт. AB-"), k.cast("string"), F.lit(", код: "), (1900 + k).cast("string"), F.lit(" and "), (500000 + k).cast("string"), F.lit(".f, 0,5-40"))
    out = t.documents.where("text IS NOT NULL").select("doc_id", tx.signatures(more).alias("s"))
    return out.select("doc_id", F.array_join("s.models", "|").alias("models"), F.array_join("s.articles", "|").alias("articles"))


@query("txt_25", """SELECT doc_id, sha256(CASE WHEN length(text) <= 200 THEN text WHEN strpos(reverse(substr(text, 1, 200)), '.') > 0 AND 200 - strpos(reverse(substr(text, 1, 200)), '.') + 1 > 100
 THEN substr(text, 1, 200 - strpos(reverse(substr(text, 1, 200)), '.') + 1) ELSE substr(text, 1, 200) || '…' END) AS digest FROM documents""")
def txt_25(t):
    return t.documents.select("doc_id", F.sha2(tx.shortened(F.col("text"), 200), 256).alias("digest"))


@query("txt_26", """SELECT p_partkey, 'see [1]' || ' of ' || p_size || ' and 9' || (p_size % 10) AS answer, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all('' || p_size || ' 9' || (p_size % 10), '[0-9]{2,}'), lambda x: x <> '17' AND x <> '91'))), ',') AS unsupported FROM part""")
def txt_26(t):
    answer = F.concat(F.lit("see [1][7] of "), F.col("p_size").cast("string"), F.lit(" and 9"), (F.col("p_size") % 10).cast("string"))
    fixed = tx.citations(answer, F.lit(2))
    return t.part.select("p_partkey", fixed.alias("answer"), F.array_join(tx.unsupported_numbers(fixed, F.lit("17 or 91")), ",").alias("unsupported"))


@query("txt_27_budget", "WITH r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT source, count(*) AS fits FROM r WHERE used <= 12000 GROUP BY source")
def txt_27_budget(t):
    used = running_sums(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", "used")
    return used.where("used <= 12000").groupBy("source").agg(N().alias("fits"))


@query("txt_28", r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS price FROM part")
def txt_28(t):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" руб"))).when(F.col("p_partkey") % 3 == 1, F.lit("1.2.3")).otherwise(F.concat(F.lit("от "), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", tx.price(cell).alias("price"))


@query("txt_31", rf"""WITH s AS (SELECT doc_id, i, trim(s) AS s FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents) WHERE length(trim(s)) >= 25),
o AS (SELECT doc_id, i, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+')), ['the', 'that', 'with', 'les', 'der', 'anan'])) AS hits FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS r FROM o) SELECT doc_id, CAST(i AS BIGINT) AS ord, CAST(hits AS BIGINT) AS hits FROM r WHERE r <= 5""")
def txt_31(t):
    sentences = t.documents.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s")).withColumn("s", F.btrim("s")).where("length(s) >= 25")
    query_words = F.array(*[F.lit(x) for x in ("the", "that", "with", "les", "der", "anan")])
    hits = F.size(F.array_intersect(F.array_distinct(tx.tokens(F.col("s"))), query_words)).cast("long")
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "i"))
    return sentences.select("doc_id", "i", hits.alias("hits")).withColumn("r", r).where("r <= 5").select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), "hits")
