"""Ranked search, paired tables and licence scans against plain versions, with the odd inputs each must take."""

import datetime
import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.llm import impact_search, license_scan, paired_tables
from granary.llm import queries as registered
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, n long, `rank` string, score int, `query` string"
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, brute.lower(text))


# --- ranked search


def ranked(docs, items, k=20):
    """Every item's k best documents by adding up each document's score whole."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            size, score = sum(c.values()), 0
            m = 100 - 25 + (25 * size * n) // length
            for t in words(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 200, 900])))) for k in range(240)]
    docs += [(k, docs[7][1]) for k in range(300, 340)]  # ties, more than the best 20
    docs += [(400, None), (401, ""), (402, "!!"), (None, docs[9][1]), (403, docs[9][1]), (403, docs[9][1]), (404, "W1-w1_É é w1"), (405, "w2 " * 30_000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 8, 60])))) for k in range(25)]
    items += [(50, docs[7][1]), (51, None), (52, "nowhere"), (53, "w1 w1 W1 é"), (None, "w2 w3"), (54, docs[9][1])]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, items = corpus
    full = spark.createDataFrame([(i, t, None, 1, "r", 2, "q") for i, t in docs], SCHEMA).repartition(3)
    return full, spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_equals_plain_sums(corpus, tables):
    assert found(impact_search.op11(*tables)) == ranked(*corpus)


def test_search_in_blocks_and_small_shards(corpus, tables, monkeypatch):
    monkeypatch.setattr(impact_search, "SHARD_POSTINGS", 500)
    assert found(impact_search.search(*tables, k=5, block_bytes=2000)) == ranked(*corpus, k=5)


def test_search_of_empty_tables(tables):
    docs, items = tables
    assert impact_search.op11(docs.limit(0), items).collect() == []
    assert impact_search.op11(docs, items.limit(0)).collect() == []


def test_bounds_stop_early_and_stay_exact():
    """With few postings of great impact the bounds prove the best before all groups are taken."""
    rng = np.random.default_rng(0)
    docs, terms = 5000, 40
    at = np.arange(docs + 1) * 10
    doc_terms = np.concatenate([np.sort(rng.choice(terms, 10, replace=False)) for _ in range(docs)])
    tf = rng.zipf(1.7, len(doc_terms)).clip(max=400).astype(np.int64)
    n = np.full(docs, 500)
    weights = (10 ** np.linspace(1, 5, terms)).astype(np.int64)
    shard = impact_search.Shard(np.arange(docs), n, at, doc_terms, tf, weights, docs, docs * 500)
    asked, repeats = np.array([3, 20, 38, 39]), np.array([1, 2, 1, 1])
    whole = np.zeros(docs, np.int64)
    for t, r in zip(asked, repeats):
        of = np.flatnonzero(doc_terms == t)
        whole[of // 10] += r * shard.doc_impacts[of]
    for bar in (1, int(np.sort(whole)[-3])):
        doc, score = shard.best(asked, repeats, 20, bar)
        assert (score == whole[doc]).all()
        best = sorted(zip(-score, doc))[:20]
        right = [(-s, d) for s, d in sorted(zip(-whole, range(docs))) if -s >= bar][:20]
        assert [(-a, b) for a, b in best[: len(right)]] == right
    assert 20 <= len(shard.best(asked, repeats, 20, 1)[0]) <= impact_search.CANDIDATES


# --- licences


def licences(text):
    w = words(text)
    at = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def odd_licences():
    rng = random.Random(11)
    pieces = ["MIT", "License", "mit", "apache", "General", "public", "license", "gnu", "lesser", "-", ".", "\n", "é", "x1", "licensé", "_"]
    return [
        None, "", " ", "MIT License", "mit\x00license", "mit license mit license", "xmit license", "mit licenses", "MITLicense", "ÉMIT license", "mit license" * 3,
        "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "the GNU Lesser General Public License", "CC BY-NC 4.0", "SPDX-License-Identifier:\nMIT",
        "word " * 60_000 + "MIT License " * 500, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore",
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: Foo AND", "SPDX-License-Identifier: AND", "SPDX-License-Identifier",
    ] + ["".join(rng.choice(pieces) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]


def test_licences_equal_plain_search(spark):
    texts = odd_licences()
    rows = [(k, t, None, 1, "r", 2, "q") for k, t in enumerate(texts)] + [(None, "MIT license", None, 1, None, None, None), (3, "MIT License", None, 1, None, None, None)]
    out = license_scan.op13(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "MIT license" if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licences(text), text
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in out}
    says = {texts[k]: (by[k]["labels"], by[k]["score"], by[k]["expressions"]) for k in range(len(texts)) if texts[k]}
    assert says["the GNU Lesser General Public License"] == ("gpl,lgpl", 0.5, "")
    assert says["CC BY-NC 4.0"] == ("cc-by-nc", 0.9, "")
    assert says["// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore"] == ("apache,gpl,mit", 0.2, "( MIT or GPL-2.0-only ) and Apache-2.0")
    assert says["SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */"][:2] == ("gpl", 0.5)
    assert says["SPDX-License-Identifier: Foo AND"] == ("unknown", 0.6, "Foo")
    assert says["SPDX-License-Identifier:\nMIT"] == says["SPDX-License-Identifier"] == says["SPDX-License-Identifier: AND"] == ("", 0.0, "")


def test_licences_of_an_empty_table(spark):
    assert license_scan.op13(spark.createDataFrame([], SCHEMA)).collect() == []


def value(tokens):
    """Restriction of an expression by recursive descent."""

    def level(ops):
        def run(pos):
            a, pos = below[ops](pos)
            while pos < len(tokens) and tokens[pos] == ops:
                b, pos = below[ops](pos + 1)
                a = max(a, b) if ops == "and" else min(a, b)
            return a, pos

        return run

    def leaf(pos):
        if tokens[pos] == "(":
            a, pos = level("or")(pos + 1)
            return a, pos + 1
        a, pos = license_scan.RESTRICTION[license_scan.family(tokens[pos])], pos + 1
        if pos < len(tokens) and tokens[pos] == "with":
            return min(a, license_scan.EXCEPTIONS.get(tokens[pos + 1], 1.0)), pos + 2
        return a, pos

    below = {"or": level("and"), "and": leaf}
    return level("or")(0)[0]


def test_shunting_yard_equals_recursive_descent():
    rng = random.Random(2)
    names = ["mit", "gpl-3.0", "apache-2.0", "lgpl-2.1-only", "odd", "agpl-3.0", "cc0-1.0"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)] + (["with", "classpath-exception-2.0"] if rng.random() < 0.2 else [])
        a, b = expression(depth - 1), expression(depth - 1)
        out = [*a, rng.choice(["and", "or"]), *b]
        return ["(", *out, ")"] if rng.random() < 0.5 else out

    for _ in range(500):
        tokens = expression(4)
        got = license_scan.evaluated(" ".join(tokens) + rng.choice(["", " and", " or ( (", " */"]))
        assert got[0] == value(tokens) and got[2] == " ".join(tokens)
    assert license_scan.evaluated(" or ".join(["MIT"] * 20_000))[0] == 0.1


# --- paired tables


def crc(text, buckets=150):
    return zlib.crc32(text.encode()) % buckets


def plain_pair(sales, lines, buckets=150):
    """What the contract asks for, from lists of rows as tuples."""
    known = Counter(r[0] for r in sales if r[0] is not None)

    def home(r, table):
        if r[0] is None:
            return buckets + 1
        return buckets if table == "sale_lines" and r[0] not in known else crc(f"pair{r[0]}", buckets)

    def order(r):
        return (r[0] is not None, -(r[0] or 0)), *((x is not None, x.encode() if isinstance(x, str) else (x != x, x) if x is not None else 0) for x in r[1:])

    out = []
    for table, rows in (("sales", sales), ("sale_lines", lines)):
        starts, finals = defaultdict(list), defaultdict(list)
        for r in rows:
            b = home(r, table)
            starts[(b - 1 if b % 5 == 1 else b) if table == "sales" else 0 if r[2] is None else crc(str(r[2]), buckets)].append(r)
            finals[b].append(r)
        for b, own in finals.items():
            lineage = []
            for s in sorted(starts):
                n = sum(1 for r in starts[s] if home(r, table) == b)
                lineage += [f"{s}:{n}"] * (n > 0)
            own.sort(key=order)
            joined = sum(known[r[0]] for r in lines if r[0] is not None and home(r, "sale_lines") == b) if b < buckets else 0
            stays = any(sorted(map(repr, x)) == sorted(map(repr, own)) for x in starts.values())
            sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
            out.append((table, b, own, sha(["" if r[0] is None else str(r[0]) for r in own]), sha(lineage), len(own), joined, not stays))
    return out


def same_files(out, sales, lines, buckets=150):
    got = {(r["table_name"], r["bucket"]): r for r in out.collect()}
    expected = plain_pair([tuple(r) for r in sales.collect()], [tuple(r) for r in lines.collect()], buckets)
    assert len(got) == len(expected)
    columns = {"sales": sales.columns, "sale_lines": lines.columns}
    paths = set()
    for table, b, rows, ids, lineage, n, joined, rewritten in expected:
        r = got[table, b]
        assert (r["columns"], r["ids_sha256"], r["lineage_sha256"], r["n_rows"], r["n_joined"], r["rewritten"]) == (",".join(columns[table]), ids, lineage, n, joined, rewritten), (table, b)
        path = urlsplit(r["path"]).path
        held = pq.ParquetFile(path).read()
        assert held.column_names == columns[table]
        assert repr([tuple(x.values()) for x in held.to_pylist()]) == repr(rows)
        paths.add(path)
    if paths:
        folder = os.path.dirname(os.path.dirname(next(iter(paths))))
        assert {f for f in glob.glob(f"{folder}/**/*", recursive=True, include_hidden=True) if os.path.isfile(f)} == paths
    return got


SALES = "sale_id long, client_id long, status string, total double, number int, `table` string, sold_at timestamp_ntz"
LINES = "sale_id long, line_no int, item_id long, place string, amount double, partners int"


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(9)
    day = lambda: None if rng.random() < 0.1 else datetime.datetime(2024, 1, rng.randint(1, 28), 3, 4, 5, 678)
    name = lambda: rng.choice([None, "", "a", "é", "z", "Z", "\U0001f600", "￮"])
    number = lambda: rng.choice([None, 0.0, 1.5, -2.25, float("inf"), float("nan")])
    sales = [(k, rng.randint(0, 9), name(), number(), rng.randint(0, 3), name(), day()) for k in range(400)]
    sales += sales[:20] + [(None, 1, None, None, None, None, None)] * 2 + [(7, None, "x", 1.0, 1, "t", day()) for _ in range(50)]
    ids = [None, *range(350), *range(1000, 1040)]
    lines = [(rng.choice(ids), rng.randint(1, 3), rng.choice([None, *range(60)]), name(), number(), rng.randint(0, 2)) for _ in range(1500)]
    lines += lines[:30] + [(7, rng.randint(1, 50), rng.randint(0, 60), name(), number(), 1) for _ in range(700)]
    return spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(3)


def test_pair_equals_plain_version(shop):
    got = same_files(paired_tables.op12(*shop), *shop)
    assert any(not r["rewritten"] for r in got.values()) and ("sale_lines", 150) in got and ("sales", 151) in got


def test_pair_with_split_sorts(shop):
    """Files of more than 100 rows are sorted by many tasks and streamed into one."""
    same_files(paired_tables.op12(*shop, buckets=7, split_rows=100), *shop, buckets=7)


def test_a_file_of_another_number_stays(spark):
    """A starting file keeps its place if it holds just the rows of a final file, whatever its number."""
    b = {k: crc(f"pair{k}") for k in range(3000)}
    second = next(k for k in b if b[k] % 5 == 1)  # alone in file b - 1
    sales = spark.createDataFrame([(second, 1, "a", 1.0, 1, None, None)], SALES)
    lines = spark.createDataFrame([(second, 1, 5, "x", 1.0, 1), (5000, 1, 6, "x", 1.0, 1)], LINES)
    got = same_files(paired_tables.op12(sales, lines), sales, lines)
    assert not any(r["rewritten"] for r in got.values())


def test_pair_of_empty_tables(spark, shop):
    none = spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)
    assert paired_tables.op12(*none).collect() == []
    same_files(paired_tables.op12(none[0], shop[1], buckets=6), none[0], shop[1], buckets=6)
    same_files(paired_tables.op12(shop[0], none[1], buckets=6), shop[0], none[1], buckets=6)


def test_flatten_again_does_nothing(tmp_path):
    """A task that runs again after it was lost finds its file in place; merged parts keep their order."""
    for k in range(3):
        os.makedirs(tmp_path / "n", exist_ok=True)
        pq.write_table(pa.table({"x": [k * 2, k * 2 + 1]}), tmp_path / "n" / f"part-{k:05d}-a.parquet")
    for _ in range(2):
        paired_tables.flatten(str(tmp_path / "n"), str(tmp_path / "out" / "one.parquet"))
        assert pq.read_table(tmp_path / "out" / "one.parquet").column(0).to_pylist() == [0, 1, 2, 3, 4, 5]


def test_the_given_tables(spark):
    """The registered query over the whole small tables."""
    folder = "/root/testdata/sf0.001"
    sales, lines = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("sales", "sale_lines"))
    same_files(registered.QUERIES["op12_paired_tables"](spark, folder), sales, lines)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in registered.QUERIES["op13_license_scan"](spark, folder).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licences(docs[r["doc_id"]])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").where(F.col("item_id") < 12).collect()]
    got = [x for x in found(registered.QUERIES["op11_impact_search"](spark, folder)) if x[0] < 12]
    assert got == ranked(list(docs.items()), items)
