"""The queries of this subpackage: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bwt_dups, decontam, impact_search, langid, license_scan, lm, near_dups, paired_tables, piece_codec, private, quality, ring, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one of fewer files than the session has cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _of_documents(operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": _of_documents(bwt_dups.op1),
    "op2_minhash_near_dedup": _of_documents(near_dups.op2),
    "op3_pii": _of_documents(private.op3),
    "op4_decontamination": lambda spark, sf_dir: decontam.op4(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ),
    "op5_quality_rules": _of_documents(quality.op5),
    "op6_language_id": _of_documents(langid.op6),
    "op7_sentencepiece": _of_documents(piece_codec.op7),
    "op8_token_counts": _of_documents(token_counts.op8),
    "op9_sharding": _of_documents(ring.op9),
    "op10_lm_scoring": _of_documents(lm.op10),
    "op11_impact_search": lambda spark, sf_dir: impact_search.op11(
        _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ),
    "op12_paired_tables": lambda spark, sf_dir: paired_tables.op12(
        _table(spark, sf_dir, "sales"), _table(spark, sf_dir, "sale_lines")
    ),
    "op13_license_scan": _of_documents(license_scan.op13),
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS4 = rf"regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: SQL that gives the same rows; the other operators are held against plain versions in tests/llm
ORACLES: dict[str, str] = {
    "op4_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents), i AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, s, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes)),
hit AS (SELECT dw.doc_id, dw.p, dw.size, iw.item_id, iw.s FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
runs AS (SELECT doc_id, item_id, p, size, p - row_number() OVER (PARTITION BY doc_id, item_id, size, p - s ORDER BY p) AS run, p - s AS diagonal FROM (SELECT DISTINCT * FROM hit)),
lng AS (SELECT doc_id, n, item, begun FROM (SELECT doc_id, n, item, begun, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item, begun) AS r
 FROM (SELECT doc_id, count(*) - 1 + size AS n, CAST(item_id AS VARCHAR) AS item, min(p) - 1 AS begun FROM runs GROUP BY doc_id, item_id, size, diagonal, run)) WHERE r = 1),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS longest, item AS longest_item, CAST(begun AS BIGINT) AS longest_at
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN lng USING (doc_id)""",
    "op5_quality_rules": f"""WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), E'\\n'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
t3 AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t3) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS x FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) AS BIGINT) AS lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM b LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * lines AS dups FROM m),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS bad FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'dups']) AS rule, unnest([short, repeats, symbols, dups]) AS bad FROM f) GROUP BY source, rule),
s AS (SELECT rule, sum(bad) / sum(n) AS mean, sum(bad * bad / n) AS sq, sum(n) AS n, sum(n * n) AS n2, count(*) - 1 AS k FROM h GROUP BY rule),
o AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND n - n2 / n - k > 1e-9 THEN ((sq - n * mean * mean) / (mean * (1 - mean)) - k) / (n - n2 / n - k) ELSE 0::DOUBLE END AS rho FROM s),
k AS (SELECT rule, mean, CASE WHEN rho > 1e-6::DOUBLE THEN least(greatest(1 / rho - 1, 1), 1e6::DOUBLE) ELSE 1e6::DOUBLE END AS strength FROM o),
r AS (SELECT source, max((bad + mean * strength) / (n + strength)) AS rate FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND rate <= 0.5::DOUBLE AS kept, round(rate, 6) AS host_rate FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source""",
    "op11_impact_search": f"""WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS asked FROM (SELECT item_id, unnest({_WORDS4}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(asked * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20""",
}
