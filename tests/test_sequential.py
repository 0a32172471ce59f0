"""Operators with sequential semantics against plain loops, streams against their batch twins."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import spoken as sp
from granary.operators import clusters as cl
from granary.operators import graph as gr
from granary.operators import latent
from granary.operators import vectors as vc
from granary.operators.common import at_ranks, running_sums
from granary.sources import web
from granary.streaming import dialog


def random_pairs(rng, n, links):
    out = {}
    for _ in range(links):
        a, b = sorted(rng.sample(range(n), 2))
        out[a, b] = round(rng.uniform(0.3, 1), 3)
    return out


def plain_greedy(weights, pairs, near, least):
    sim = lambda x, y: pairs.get((min(x, y), max(x, y)), 0)
    used, out = set(), {}
    for i in sorted(weights, key=lambda k: (-weights[k], k)):
        if i in used:
            continue
        members = [i] + [j for j in weights if j != i and j not in used and sim(i, j) >= near]
        if len(members) >= least:
            used.update(members)
            out |= {j: i for j in members}
    return out


def plain_attached(ids, clusters, pairs, near):
    out = dict(clusters)
    for i in sorted(ids):
        if i not in out:
            best = [(s, out[x + y - i]) for (x, y), s in pairs.items() if i in (x, y) and s >= near and (x + y - i) in out]
            if best:
                out[i] = max(best)[1]
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_clusters(spark, least):
    rng = random.Random(least)
    weights = {k: rng.randint(1, 9) * 1.0 for k in range(40)}
    pairs = random_pairs(rng, 40, 60)
    items = spark.createDataFrame(list(weights.items()), "id long, weight double")
    rows = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, sim double")
    found = cl.greedy(items, rows, 0.6, least)
    want = plain_greedy(weights, pairs, 0.6, least)
    assert {r["id"]: r["cluster"] for r in found.collect()} == want
    joined = cl.merged(found, rows, 0.6)
    names = {r["id"]: r["cluster"] for r in joined.collect()}
    for (a, b), s in pairs.items():
        if s >= 0.6 and a in names and b in names:
            assert names[a] == names[b]
    more = cl.attached(items, joined, rows, 0.4)
    assert {r["id"]: r["cluster"] for r in more.collect()} == plain_attached(weights, names, pairs, 0.4)


def test_degree_cap(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.randint(1, 3), s) for (a, b), s in random_pairs(rng, 14, 50).items()]
    degree, want = {}, set()
    for a, b, n, w in sorted(edges, key=lambda e: (-e[2], -e[3], e[0], e[1])):
        if degree.get(a, 0) < 2 or degree.get(b, 0) < 2:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            want.add((a, b))
    df = spark.createDataFrame(edges, "a long, b long, n int, w double")
    assert {(r["a"], r["b"]) for r in cl.degree_capped(df, 2).collect()} == want


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8])
def test_question_pairs(spark, least):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(25)]
    texts = {k: set(rng.choices(words, weights=range(1, 26), k=rng.randint(1, 7))) for k in range(40)}
    df = {w: sum(w in t for t in texts.values()) for w in words}
    weight = lambda w: np.log(40 / (1 + df[w])) + 1
    want = {}
    for a in texts:
        for b in texts:
            sim = sum(map(weight, texts[a] & texts[b])) / min(sum(map(weight, texts[a])), sum(map(weight, texts[b])))
            if a < b and sim >= least:
                want[a, b] = pytest.approx(sim)
    terms = spark.createDataFrame([(k, w) for k, t in texts.items() for w in t], "id long, term string")
    assert {(r["a"], r["b"]): r["sim"] for r in gr.question_pairs(terms, least).collect()} == want


def test_vectors_in_blocks(spark):
    x = np.random.default_rng(3).standard_normal((70, 5))
    x[7] = x[3]
    x[9] = 0
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    s = np.round(unit @ unit.T, 6)
    got = {(r["x"], r["y"]) for r in vc.alike(df, 0.5, block=16).collect()}
    assert got == {(a, b) for a in range(70) for b in range(a + 1, 70) if s[a, b] >= 0.5}
    best = {}
    for r in vc.alike(df, -1.0, 3, block=16).collect():
        best.setdefault(r["x"], set()).add(r["y"])
    for a in range(70):
        order = sorted((b for b in range(70) if b != a), key=lambda b: (-s[a, b], b))
        assert {round(s[a, b], 4) for b in best[a]} == {round(s[a, b], 4) for b in order[:3]}
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = {(r["query"], r["rank"]): r["cosine"] for r in vc.nearest(df, asked, 4, block=3).collect()}
    assert near == {(a, k + 1): pytest.approx(v, abs=2e-6) for a in range(0, 70, 10) for k, v in enumerate(sorted(s[a], reverse=True)[:4])}


def test_values_at_ranks(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 30) if g else rng.random())) for g in (0, 1) for _ in range(301)] + [(2, 5.0), (3, None), (0, 1e300), (4, 1e18)]
    rows += [(4, rng.random()) for _ in range(3000)]  # one value far from all others
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = {"lo": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}
    for most in (200_000, 40):
        got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in at_ranks(df, "v", ranks, ["g"], most).collect()}
        for g in (0, 1, 2, 4):
            own = sorted(v for k, v in rows if k == g)
            assert got[g] == (own[0], own[len(own) // 2], own[-1])
        assert 3 not in got


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, 1, 5])) for k in range(300)]
    want, sums = [], {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        want.append((g, k, v, sums[g]))
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    assert sorted(map(tuple, running_sums(df, ["g"], ["k"], "v", "used").collect()), key=lambda x: x[1]) == want


def test_decomposition(spark):
    rng = np.random.default_rng(5)
    a = rng.random((30, 12)) * (rng.random((30, 12)) < 0.6)
    rows = [(i, f"t{j:02d}", float(a[i, j])) for i in range(30) for j in range(12) if a[i, j]]
    df = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    model = latent.decompose(df, 4)
    _, s, vt = np.linalg.svd(a)
    assert model.singular == pytest.approx(s[:4], rel=1e-6)
    assert np.abs((model.components * vt[:4].T).sum(0)) == pytest.approx(np.ones(4), abs=1e-5)
    out = {r["doc_id"]: r["embedding"] for r in latent.projected(df, model).collect()}
    want = a @ model.components
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert all(out[i] == pytest.approx(want[i], abs=1e-5) for i in out)


def test_word_pieces_against_the_library(spark):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    letters = [chr(97 + k) for k in range(26)]
    vocabulary = ["[UNK]", "[CLS]", "[SEP]", *letters[:20], *[f"##{x}" for x in letters], "pump", "##ing", "wa", "##ter", ",", "."]
    lib = Tokenizer(models.WordPiece({x: k for k, x in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=1000))
    lib.normalizer = normalizers.Lowercase()
    lib.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    texts = ["Pumping water, pumps.", "zebra pump", "", "  ", "water" * 40, "a1 b"]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "text string").withColumn("ids", sp.pieces(F.col("text"), vocabulary))
    got = {r["text"]: r for r in rows.select("text", sp.framed(F.col("ids"), vocabulary, 1000).alias("x"), sp.framed(F.col("ids"), vocabulary, 5).alias("short")).collect()}
    assert got[None]["x"] is None
    for text in texts:
        assert got[text]["x"] == [1, *lib.encode(text).ids, 2]
        assert len(got[text]["short"]) <= 5
    two = spark.createDataFrame([("pump", "water")], "a string, b string").select(sp.pieces(F.col("a"), vocabulary).alias("a"), sp.pieces(F.col("b"), vocabulary).alias("b"))
    at = {x: k for k, x in enumerate(vocabulary)}
    assert two.select(sp.framed_pair(F.col("a"), F.col("b"), vocabulary, 12).alias("x")).first()["x"] == [1, at["pump"], 2, at["wa"], at["##ter"], 2]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("**Напор** 45 м, [2] см. <b>тут</b>", "Напор 45 метров , источник 2 сантиметров . тут"),
        ("В базе знаний нет", "В базе знаний нет"),
        ("220 В и 3,6 м3/ч", "220 вольт и 3 запятая 6 кубометров в час"),
        ("НДС 20", "эн-дэ-эс 20"),
        ("WRP-A и 2ECO6-38", "дабл-ю ар пи тире эй и 2 и си оу 6 тире 38"),
        ("https://a.b/c тут", "ссылка тут"),
        ("", ""),
        ("X1-PDF, 1С и 1С-5; 55/75 5м 1,2,3", "икс 1 -пэ-дэ-эф, один-эс и один-эс-5; 55/75 5 метров 1 запятая 2,3"),
        ("АБВГД ABCDEFGH-AB é5 10 мм", "АБВГД ABCDEFGH- эй би é5 10 миллиметров"),
    ],
)
def test_speech(spark, text, said):
    assert spark.createDataFrame([(text,)], "t string").select(sp.said(F.col("t")).alias("s")).first()["s"] == said


def test_context(spark):
    def places(texts, headers, budget):
        row = spark.createDataFrame([(texts, headers)], "t array<string>, h array<string>")
        return row.select(sp.context_places(F.col("t"), F.col("h"), budget).alias("x")).first()["x"]

    texts = ["one two three", "two", "four " * 100, "four " * 200, None, "five " * 30]
    assert places(texts, ["h"] * 6, 10_000) == [0, 2, 4, 5]
    assert places(texts, ["h"] * 6, 530) == [0, 2, 4]
    assert places(["long " * 50, "b"], ["h"] * 2, 10) == [0] and places([], [], 10) == []



def turns(spark):
    rows = [
        (1, 0, "напор у Водомет 55/75?"), (1, 60, "а цена?"), (1, 120, "какая мощность"), (1, 200, "сколько стоит кабель"), (1, 2000, "а вес?"),
        (2, 0, "а цена?"), (2, 30, "насосы Wilo"), (2, 90, "глубина погружения?"), (3, 5, None),
    ]
    df = spark.createDataFrame(rows, "chat long, s long, question string")
    return df.select("chat", F.timestamp_seconds(F.col("s") + 1_000_000).alias("at"), "question")


ASKED = [
    (1, 0, "напор у Водомет 55/75?"), (1, 60, "а цена? (55/75)"), (1, 120, "какая мощность (55/75)"), (1, 200, "сколько стоит кабель"), (1, 2000, "а вес?"),
    (2, 0, "а цена?"), (2, 30, "насосы Wilo"), (2, 90, "глубина погружения? (wilo)"), (3, 5, None),
]


def test_memory_of_conversations(spark):
    out = dialog.inherited(turns(spark), F.array(F.lit("wilo")))
    assert [(r["chat"], int(r["at"].timestamp()) - 1_000_000, r["asked"]) for r in out.orderBy("chat", "at").collect()] == ASKED


def test_memory_as_a_stream(spark, tmp_path):
    turns(spark).where("question IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chat long, at timestamp, question string").parquet(str(tmp_path / "in")).withWatermark("at", "1 minute")
    out = dialog.inherited_stream(stream, F.array(F.lit("wilo")))
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("chat", "at").collect()
    assert [(r["chat"], int(r["at"].timestamp()) - 1_000_000, r["asked"]) for r in got] == ASKED[:-1]


def test_alerts(spark):
    at = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    checks = spark.range(0, 10).select(F.timestamp_seconds(F.col("id") * 6 * 3600).alias("at"))
    reports = spark.createDataFrame([("a", k) for k in (0, 1, 2, 3, 4, 6)] + [("b", 9)], "code string, k long").select("code", F.timestamp_seconds(F.col("k") * 6 * 3600).alias("at"))
    hours = lambda x: None if x is None else int(x.timestamp()) // 3600
    got = sorted((r["code"], hours(r["opened"]), hours(r["last_seen"]), r["notices"], hours(r["resolved"])) for r in dialog.alerts(reports, checks).collect())
    assert at and got == [("a", 0, 24, 3, 30), ("a", 36, 36, 1, 42), ("b", 54, 54, 1, None)]


def test_watched_folder(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    take = lambda df, number: seen.extend((r["path"].rsplit("/", 1)[-1], bytes(r["content"])) for r in df.collect())
    for name, text in ((None, None), ("b.txt", "two")):
        if name:
            time.sleep(1)
            (folder / name).write_text(text)
        dialog.watch(spark, str(folder), take, str(tmp_path / "state")).awaitTermination()
    assert seen == [("a.txt", b"one"), ("b.txt", b"two")]


def test_web(spark):
    maps = spark.createDataFrame([("<urlset><url><loc> http://a/x </loc></url><url><loc>http://a/y</loc></url></urlset>",), ("",)], "x string")
    assert [r[0] for r in maps.select(web.sitemap_links(F.col("x"))).collect()] == [["http://a/x", "http://a/y"], []]
    rules = spark.createDataFrame([("User-agent: *\nDisallow: /no", "http://a/no/x"), ("User-agent: *\nDisallow: /no", "http://a/yes"), (None, "http://a/no")], "r string, u string")
    assert [r[0] for r in rules.select(web.allowed(F.col("r"), F.col("u"), "bot")).collect()] == [False, True, True]
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    reach = lambda most: [(r["url"], r["depth"]) for r in web.crawl(seeds, links, most).orderBy("depth", "url").collect()]
    assert reach(100) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and reach(2) == [("a", 0), ("b", 1)]
    lines = spark.createDataFrame([("// note",), ("",), ('{"question": "q", "expect_files": ["f"]}',), ("broken",)], "value string")
    assert [(r["question"], r["expect_files"]) for r in web.questions(lines).collect()] == [("q", ["f"]), (None, None)]


def test_degree_cap_without_rounds(spark, monkeypatch):
    """A chain on which each edge waits for the one before needs no written round."""
    edges = spark.createDataFrame([(k, k + 1, 1, 1 - k / 100) for k in range(40)], "a long, b long, n int, w double")
    monkeypatch.setattr(cl, "written", lambda df: pytest.fail("a round was written"))
    assert {(r["a"], r["b"]) for r in cl.degree_capped(edges, 1).collect()} == {(k, k + 1) for k in range(40)}


def test_best_in_tiles_of_copies():
    """Many equal vectors, several tiles, rows that do not count: the same as a plain sort, ties by id."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 8))
    x[200:900] = x[100]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.sort(rng.choice(10_000, 1500, replace=False))
    s = np.round(np.einsum("id,jd->ij", x, x), 6)
    s[np.arange(1500), np.arange(1500)] = -np.inf
    for least, top in ((-1.0, 1), (0.3, 6), (0.99, 40)):
        one, back = vc.Best(x, top, least), vc.Best(x, top, least)
        for i, j, part in vc._tiles(x, x):
            part[np.isneginf(s[i : i + vc.TILE, j : j + vc.TILE])] = -np.inf
            one.take(i, part, x[j : j + vc.TILE], ids[j : j + vc.TILE])
            back.take(j, part.T, x[i : i + vc.TILE], ids[i : i + vc.TILE])
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :top]
        want = [(r, int(ids[c]), s[r, c]) for r in range(1500) for c in order[r] if s[r, c] >= least]
        for best in (one, back):
            row, own, value = best.rows()
            assert [(int(a), int(b), c) for a, b, c in zip(row, own, value)] == want


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Parts of one brand and size, many of one name, and some nulls."""
    import pandas as pd

    rng = random.Random(11)
    names = ["red bolt", "bolt red", "red red bolt", "hot big red bolt", "big red bolt", "blue ring"]
    rows = [(k, rng.choice(names), rng.choice(["B1", "B1", "B2", None]), rng.choice([3, 3, 24])) for k in range(300)]
    folder = tmp_path_factory.mktemp("parts")
    pd.DataFrame(rows, columns=["p_partkey", "p_name", "p_brand", "p_size"]).astype({"p_size": "int32"}).to_parquet(folder / "part.parquet")
    docs = pd.DataFrame([(k, f"src{rng.choice([3, 4, 5])}", rng.choice(["de", "en"]), "x" * 70, 70) for k in range(60)], columns=["doc_id", "source", "lang", "text", "n_chars"])
    docs.to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["jn_02", "set_04", "ret_11"])
def test_parts_with_many_copies(spark, copies, monkeypatch, name):
    """Lists of few values give the rows of the SQL; words are compared once a pair of names, not of parts."""
    import duckdb

    from granary.operators import lists as li
    from granary.queries import ORACLES, QUERIES, lookups

    monkeypatch.setattr(lookups, "RUN", 7)
    monkeypatch.setattr(li.in_lists, "__defaults__", (7,))
    df = QUERIES[name](spark, copies)
    c = duckdb.connect()
    for t in ("part", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{copies}/{t}.parquet'")
    rel = c.sql(ORACLES[name])
    want = sorted(rel.select(", ".join(df.columns)).fetchall(), key=repr)
    assert want and sorted(map(tuple, df.collect()), key=repr) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if name == "ret_11":
        assert "Aggregate [p_brand" in plan and plan.index("array_intersect") < plan.rindex("Aggregate [p_brand")
    else:
        assert "list" in plan


@pytest.mark.parametrize("nulls", [False, True])
def test_pairs_written_in_few_bytes(spark, tmp_path, nulls):
    """Parts with documents of one brand: rows of the SQL, nulls too; files repeat themselves, and only lists are shuffled."""
    import duckdb
    import pandas as pd

    from granary.queries import ORACLES, QUERIES

    keys, ids = [*range(2520), *[None] * 2 * nulls], [*range(350), *[None] * nulls]
    pd.DataFrame({"p_partkey": keys, "p_size": 3}).astype({"p_partkey": "Int64", "p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    docs = pd.DataFrame({"doc_id": ids, "source": "src3", "lang": "de", "text": "x" * 70, "n_chars": 70}).astype({"doc_id": "Int64"})
    docs.to_parquet(tmp_path / "documents.parquet")
    df = QUERIES["jn_02"](spark, str(tmp_path))
    df.write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in ("part", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    counted = [f"SELECT p_partkey, id, count(*) AS n FROM ({q}) GROUP BY ALL" for q in (ORACLES["jn_02"], f"FROM '{tmp_path}/out/*.parquet'")]
    want, got = (sorted(c.sql(q).fetchall(), key=repr) for q in counted)
    assert got == want and sum(n for *_, n in got) == len(keys) * len(ids)
    if not nulls:
        assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.2 * len(got)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(xs") < plan.index("RepartitionByExpression")


def test_best_of_whole_scores(spark, monkeypatch):
    """Postings kept by document give the scores of those that are shuffled: prefixes, fields, nulls, copies, small blocks."""
    from granary.operators import retrieval as rt

    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("pump", "pumps", "valve", "val", "о") for b in ("", "a", "b1", "_x")]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))) if k % 9 else None, rng.choice(["Pump", None])) for k in range(150)]
    rows += [(k + 1000, *rows[7][1:]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, brand string")
    asked = [(q, w, p) for q in range(6) for w in rng.sample(words, 4) for p in (False, True)] + [(9, "nowhere", False)]
    terms = spark.createDataFrame(asked, "query long, term string, is_prefix boolean").where("NOT is_prefix OR length(term) > 3")
    fields = {"text": 1.0, "brand": 2.0}
    monkeypatch.setattr(rt, "SCORES", 500)
    got = [tuple(r) for r in rt.best_bm25(docs, terms, fields, 12).select("query", "rank", "doc_id", "score").collect()]
    plain = rt.bm25(docs, terms, fields).withColumn("score", F.round("score", 6))
    want = [tuple(r) for r in rt.ranked(plain, "query", "score", "doc_id", 12).select("query", "rank", "doc_id", "score").collect()]
    assert len(want) > 60 and sorted(got) == [pytest.approx(x) for x in sorted(want)]
    monkeypatch.setattr(rt, "LISTED", 3)
    many = [tuple(r) for r in rt.best_bm25(docs, terms, fields, 12).select("query", "rank", "doc_id", "score").collect()]
    assert sorted(many) == [pytest.approx(x) for x in sorted(want)]
