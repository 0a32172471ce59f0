"""Cases that single operators must decide: scores, hosts, places of matches, tables that fill, names that clash."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import decontam, langid, near_dups, piece_codec, private, quality, scratch
from tests.llm.test_operators import prose

CLASH = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept_id long, kept_key string, text_key string, __spans int, __k string, __id string, __key string"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(None, a), (None, b), (None, a + " end"), (4, "mail ann.b@mail.example.org now"), (4, None), (5, "")]
    return spark.createDataFrame([(k, t, "en", "s", None, "x", 1, "y", "z", 2, "k", "i", "key") for k, t in rows], CLASH)


def test_names_that_clash(clashing):
    kept = near_dups.keep_one(clashing)
    assert kept.schema == clashing.schema
    got = kept.collect()
    # the two near copies, the other text, the mail and one of null and empty, which are equal texts
    assert len(got) == 4 and {(r["spans"], r["__spans"], r["__k"], r["__id"], r["kept_id"]) for r in got} == {("x", 2, "k", "i", 1)}
    out = private.redact(clashing)
    assert out.schema == clashing.schema
    assert {(r["spans"], r["__spans"]) for r in out.collect()} == {("x", 2)}
    assert out.where("text = 'mail [EMAIL] now'").count() == 1
    assert scratch.free(["A", "a_"], "a") == "a__"


def test_context_moves_scores(spark):
    texts = {
        "192.0.2.7": 0.5,
        "login from 192.0.2.7": 0.7,
        "server build 192.0.2.7": 0.4,
        "release 192.0.2.7": 0.2,
        "the building 192.0.2.7": 0.5,
        "pay by card 4111 1111 1111 1111": 0.9,
        "4111 1111 1111 1111 is a sample": 0.4,
        "release " + "x " * 30 + "192.0.2.7": 0.5,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["max_score"] for r in private.find(df).orderBy("doc_id").collect()] == list(texts.values())


def test_spans_over_pieces_and_levels(spark):
    """Offsets, context and redaction in texts of more than one piece and of more matches than one level holds."""
    rng = random.Random(4)
    made, want, redacted = [], [], []
    at = 0
    for k in range(1500):
        gap = "é" * rng.choice([1, 2, 45, 700 if k % 100 == 0 else 3]) + " "
        hit = f"{k % 256}.1.2.3"
        made += [gap, hit, " "]
        want.append(f"ip:{at + len(gap)}:{at + len(gap) + len(hit)}")
        redacted += [gap, "[IP]", " "]
        at += len(gap) + len(hit) + 1
    overlap = "+1 (555) 123-4567.x@y.com"
    df = spark.createDataFrame([(0, "".join(made)), (1, overlap + " tail")], "doc_id long, text string")
    assert private.find(df).where("doc_id = 0").first()["spans"] == ",".join(want)
    got = {r["doc_id"]: r["text"] for r in private.redact(df).collect()}
    assert got[0] == "".join(redacted)
    assert got[1] == "[PHONE] tail"


def test_time_is_linear_in_the_matches(spark):
    def seconds(n):
        df = spark.createDataFrame([(0, "1.2.3.4 " * n)], "doc_id long, text string")
        began = time.time()
        assert private.find(df).first()["n_ip"] == n
        return time.time() - began

    seconds(10)
    assert seconds(40_000) < 3 * seconds(10_000) + 15  # the square would take minutes


def test_prior_takes_off_binomial_noise():
    # 1,000 hosts of one document each: nothing is known of the hosts
    assert quality.prior(1000, 1000, 1000, 100, 100) == (0.1, quality.PRIOR_RANGE[1])
    # hosts of 100 documents whose rates vary as a binomial's do, and hosts that fail wholly or not at all
    rng = np.random.default_rng(1)
    bad = rng.binomial(100, 0.2, 400).astype(float)
    assert quality.prior(40_000, 400 * 1e4, 400, bad.sum(), (bad * bad / 100).sum())[1] > 200
    bad = np.repeat([0.0, 100.0], [300, 100])
    assert quality.prior(40_000, 400 * 1e4, 400, bad.sum(), (bad * bad / 100).sum())[1] == quality.PRIOR_RANGE[0]


def test_a_host_decides(spark):
    """Of a host that fails, sound documents go as well; a single bad document does not condemn a small host."""
    rng = random.Random(9)
    good = lambda: prose(rng, 60)
    rows = [(k, good(), f"good{k % 20}") for k in range(600)]
    rows += [(1000 + k, "short text", "bad") for k in range(45)] + [(2000 + k, good(), "bad") for k in range(5)]
    rows += [(3000, "short", "lone"), (3001, good(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(out[k]["kept"] for k in range(600)) and out[3001]["kept"]
    assert not any(out[2000 + k]["kept"] or out[2000 + k]["base_failed"] for k in range(5))
    assert out[3000]["base_failed"] and out[3000]["host_rate"] < out[2000]["host_rate"]


def test_longest_match_and_its_place(spark):
    rng = random.Random(12)
    item = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    other = [f"v{rng.randint(0, 400)}" for _ in range(30)]
    bench = spark.createDataFrame([(7, " ".join(item)), (9, " ".join(other)), (9, " ".join(other)), (11, "lone")], "item_id long, text string")
    texts = [
        "a b c " + " ".join(item[5:30]) + " x y " + " ".join(other[3:15]),
        " ".join(other) + " " + " ".join(item[:12]),
        " ".join(item[3:12]),  # nine words only
        "A lone Lone word",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for blocks in (1 << 20, 50):
        got = {r["doc_id"]: r["longest"] and tuple(r["longest"]) for r in decontam.find(docs, bench, blocks).collect()}
        assert got == {0: (25, "7", 3), 1: (30, "9", 0), 2: None, 3: (1, "11", 1)}


def plain_language(rows, texts):
    """Nearest of the centroids that ``train`` finds, each n-gram counted one at a time."""

    def counted(text):
        raw = text.encode().lower() if text.isascii() else bytes(tb_lower(text.encode()))
        out = np.zeros(langid.DIMS, np.int64)
        for order in langid.ORDERS:
            for i in range(len(raw) - order + 1):
                gram = order
                for c in raw[i : i + order]:
                    gram = (gram * 0x01000193 & 0xFFFFFFFF) ^ c
                out[(gram * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 13)] += 1
        return out

    def tb_lower(raw):
        return [c + 32 if 65 <= c <= 90 else c for c in raw]

    model = langid.train([lang for lang, _ in rows], np.stack([counted(t) for _, t in rows]))
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        v = np.log1p(counted(t)) * model.idf
        v = v / np.sqrt((v * v).sum())
        cosines = [float(v @ c) for c in model.centroids]
        best = int(np.argmax(cosines))
        out.append((model.languages[model.of_centroid[best]], cosines[best]))
    return out


def test_language_against_a_plain_version(spark):
    rng = random.Random(3)
    en = "the house of old water runs down and nobody knows where it goes in the night".split()
    de = "das haus am alten wasser steht und niemand weiß wohin es in der nacht geht".split()
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = sorted([("en", say(en, 30)) for _ in range(12)] + [("de", say(de, 30)) for _ in range(12)])
    texts = [say(en, 8), say(de, 8), None, "", "12 34 !!", "Straße Ünder", say(en, 3000) + " " + "e" * 70_000]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(asked, model).orderBy("doc_id").collect()]
    want = plain_language(rows, texts)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=1e-5)


def test_strange_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    strange = ["где находится насос и сколько стоит доставка", "これは日本語の文章です。水が流れる。", "xq zv kj wq pf gh qz xv jk zq vw"]
    asked = spark.createDataFrame([(k, t, "en") for k, t in enumerate(strange)], "doc_id long, text string, lang string")
    assert langid.keep_known(asked, model).count() == 0
    known = docs.where("lang IS NOT NULL AND length(text) > 400")
    assert langid.keep_known(known, model).count() >= 0.95 * known.count()


def test_long_counts_teach_whole():
    a, b = np.zeros(langid.DIMS, np.int64), np.zeros(langid.DIMS, np.int64)
    a[0], a[1], b[0], b[1] = 70_000, 1, 1, 70_000
    model = langid.train(["a", "b"], np.stack([a, b]))
    x = np.log1p(np.array([[70_000.0, 1.0]])) * model.idf[:2]
    assert model.centroids[0][:2] == pytest.approx((x / np.linalg.norm(x))[0], abs=1e-5)


def test_a_full_table_is_begun_anew(monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_CHUNKS", 5)
    monkeypatch.setattr(piece_codec, "SLICE_BYTES", 40)
    monkeypatch.setattr(piece_codec, "PORTION", 2)
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 12)) for _ in range(60)] + ["  ", "", "x" * 300, " a", "a "]
    c = piece_codec.Codec(piece_codec.model_path())
    got = [piece_codec._ids(x).tolist() for _, x, _ in piece_codec._texts(c, pa.array(texts))]
    assert got == [c.lib.encode(t) for t in texts]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        applicationId = "app"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_weights_add_up_over_two_levels(spark):
    from granary.llm import lm

    rows = [(k, k + 1, np.full(3, float(k)).tobytes()) for k in range(23)]
    df = spark.createDataFrame(rows, "part long, n long, w binary")
    out = lm.added(df, 23, 3).collect()
    assert len(out) <= 3 and sum(r["n"] for r in out) == sum(range(24))
    assert sum(np.frombuffer(r["w"], np.float64)[0] for r in out) == sum(range(23))


def test_scores_against_a_plain_loop(spark):
    """Each token's probability from the trained weights, one at a time; nor do partitions change the weights."""
    from granary.llm import lm

    rng = random.Random(21)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + ["", None, "x" * 500 + " unseen words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taught = F.col("doc_id") < 70
    got = {r["doc_id"]: r["score"] for r in lm.score(df.repartition(5), taught)[0].collect()}
    again = {r["doc_id"]: r["score"] for r in lm.score(df.repartition(2), taught)[0].collect()}
    assert got == pytest.approx(again, rel=1e-6)

    vocab = lm.vocabulary(lm.token_counts(df.where(taught)))
    shared = spark.sparkContext.broadcast(vocab)
    model = lm.train(df.where(taught), shared, lm.LogBilinear(vocab.noise()))
    r, q, b, s = (model.w[k].astype(float) for k in "rqbs")
    common = vocab.common.to_pylist()
    count = dict(zip(common, vocab.c.tolist()))

    def unit_of(token):
        if token in count and common.index(token) < lm.OWN:
            return common.index(token)
        raw = token.encode()
        return lm.OWN + (raw[-1] * 31 + (raw[-2] * 7 if len(raw) > 1 else 0)) % lm.BINS

    for k in (0, 5, 69, 72, 79, 80, 81, 82):
        units, total = [0, 0], 0.0
        for token in [*((texts[k] or "").lower().split()), lm.END]:
            u = unit_of(token)
            h = r[units[-1]] * s[0] + r[units[-2]] * s[1]
            scores = q @ h + b
            total += (scores[u] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / np.log(10)
            if u >= lm.OWN:
                den = vocab.bin_tokens[u - lm.OWN] + lm.SMOOTH * (vocab.bin_distinct[u - lm.OWN] + 1)
                total += np.log10((count.get(token, 0) + lm.SMOOTH) / den)
            units.append(u)
        assert got[k] == pytest.approx(total, rel=1e-4)


def test_equal_rows_fill_slots(spark):
    """A third of the rows equal, ids null: all slots without gaps, shards one row apart, the same rows as before."""
    from granary.llm import ring

    rows = [(None, "same")] * 700 + [(None, None)] * 50 + [(k, f"text {k}") for k in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [tuple(r) for r in ring.shard_documents(df, 40).collect()]
    assert len(out) == len(rows) and sorted(x[0] is None for x in out) == sorted(k is None for k, _ in rows)
    slots = {}
    for _, size, _, shard, slot in out:
        slots.setdefault(shard, []).append(slot)
    assert len(slots) == 40 and {len(x) for x in slots.values()} <= {51, 52}
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = [tuple(r) for r in ring.shard_documents(df.repartition(2), 40).collect()]
    assert sorted(out, key=repr) == sorted(again, key=repr)


def test_oracles(spark):
    import duckdb

    from granary.llm.queries import ORACLES, QUERIES

    folder, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, folder)
        rel = c.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
