"""Operators of granary.llm against plain versions and the libraries, with the odd inputs each must take."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bwt_dups, decontam, langid, lm, near_dups, piece_codec, private, quality, ring, token_counts
from granary.llm import shingles as sh
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__cell` string, `key` string, label int"
WORDS = "the pump of red water runs into a small tank near every old house while nobody counts the drops that fall".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    changed = base.split()
    changed[60] = "otherwise"
    return [
        None, "", " ", "\n\n", "one", "a b c d", base, base, " ".join(changed), prose(rng, 80) + "\n" + base[:230], "x" * 700, prose(rng, 3000),
        "mail me: ann.b@mail.example.org, call +1 (202) 555-0143 or 4111 1111 1111 1111", "host 10.0.0.300 and 10.0.0.1.7.8.9, 1.2.3.4.5.6.7.8",
        "IBAN GB82 WEST 1234 5698 7654 32 at the bank", "line\nline\nline\n \nline", "日本語 テキスト é ½ ▁▁ a  b", "it's <|endoftext|> we'll\n\n 's", "!!! ??? 123",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, "src0" if k % 2 else None, None, "c", "k", 1) for k, t in enumerate(odd_texts())]
    rows += [(None, "no id here", "en", None, 1, None, None, None), rows[6], rows[6]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    return spark.createDataFrame([(1, " ".join(base[20:40])), (2, "Tank! nowhere"), (3, None), (4, "C d"), (None, "quite other words")], "item_id long, text string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_repeats_in_a_collection(tmp_path):
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(200, 330))) for _ in range(rng.randint(1, 5))]
        texts.append(b"zz" + texts[0])
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(x) for x in texts])
        column = max(map(len, texts))  # aligned by their ends, windows in one column only are compared
        got = bwt_dups.repeats(data, offsets, np.array([len(x) for x in texts]), f"file://{tmp_path}")
        ends = {}
        for x in texts:
            for i in range(len(x) - 199):
                key = (len(x) - i, x[i : i + 200])
                ends[key] = ends.get(key, 0) + 1
        want = [len(x) - i >= 200 and ends[len(x) - i, x[i : i + 200]] > 1 for x in texts for i in range(len(x))]
        assert column and got.tolist() == want


@pytest.mark.parametrize("group", [bwt_dups.GROUP, 3, 1])
def test_op1(docs, group):
    own = pairs(docs)
    want = sorted(zip([k for k, _ in own], brute.repeats([t for _, t in own])), key=repr)
    out = bwt_dups.remove_repeats(docs, group=group).select("doc_id", "n_bytes", F.size("spans"), F.sha2("kept", 256), F.octet_length("kept"))
    got = sorted([(r[0], (r[1], r[1] - r[4], r[2], r[3])) for r in out.collect()], key=repr)
    assert got == want


def test_op2(docs):
    own = pairs(docs)
    label = brute.classes([t for _, t in own])
    least = {}
    for (k, _), c in zip(own, label):
        least[c] = min(least.get(c, k), k) if k is not None and least.get(c) is not None else (k if least.get(c) is None else least[c])
    want = sorted([(k, least[c]) for (k, _), c in zip(own, label)], key=repr)
    assert sorted([(r["doc_id"], r["class_id"]) for r in near_dups.op2(docs).collect()], key=repr) == want
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted(set(least.values()), key=repr)


def test_classes_are_told_apart_without_ids(spark):
    """Different texts without an id, or of one id, are different classes; one of each class stays."""
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(6)]
    near = texts[0] + " tail"
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in near_dups.keep_one(df).collect()]
    first = [x for x in kept if x[1] in (texts[0], near)]
    assert len(first) == 1
    rest = [(None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5])]
    assert sorted(set(kept) - set(first), key=repr) == sorted(rest, key=repr) and len(kept) == 6
    assert near_dups.classes(df).select("class_key").distinct().count() == 6


def test_near_copies_in_a_large_group(spark):
    """Copies of one text, each with other words changed: the components are those of brute force."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    texts = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dups.op2(df).collect()) == list(enumerate(brute.classes(texts)))


def test_links_are_found_where_lines_repeat(spark):
    """Pairs of Jaccard 0.8 whose shingles not shared repeat: each pair is a class of its own."""
    texts = []
    for k in range(60):
        shared = [f"s{k}x{i}" for i in range(84)]  # 80 shingles
        line = [f"r{k}x{i}" for i in range(16)]  # 4 shingles over the seam, 12 inside, 4 from its end to its start
        texts += [" ".join(shared), " ".join(shared + line * 50)]
    sets = [brute.shingles(t) for t in texts[:2]]
    assert len(sets[0] & sets[1]) == 80 and len(sets[0] | sets[1]) == 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dups.op2(df).collect()) == [(i, i - i % 2) for i in range(120)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**62, 400).astype(np.uint64), rng.integers(0, 2**62, 400).astype(np.uint64)
    b[:300] = a[:300]
    w = 1.0 + rng.integers(0, 3, 400)
    text = np.repeat([0, 1], 400)
    s = sh.prob_min_hash(text, np.concatenate([a, b]), np.concatenate([w, w]), 2, 2048)
    p, _ = sh.similarities((np.zeros(400, int), a[np.argsort(a)], w[np.argsort(a)]), (np.zeros(400, int), b[np.argsort(b)], w[np.argsort(b)]))
    assert abs((s[0] == s[1]).mean() - p[0]) < 0.05


def test_op3(docs):
    want = sorted([(k, *brute.private(t)) for k, t in pairs(docs)], key=repr)
    out = private.op3(docs)
    assert sorted(rows_of(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")), key=repr) == want
    assert {r["doc_id"] for r in out.where("n_iban = 1").collect()} == {14}


def test_redaction_keeps_columns(docs):
    out = private.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.where("doc_id = 12").first()["text"]
    assert text == "mail me: [EMAIL], call [PHONE] or [CARD]"


def test_redaction_of_odd_contexts(spark):
    cases = [
        ("camera of the new building: 203.0.113.7", "camera of the new building: [IP]"),
        ("conversion at 203.0.113.7", "conversion at [IP]"),
        ("203.0.113.7 is " + "x " * 15 + "of buildings", "[IP] is " + "x " * 15 + "of buildings"),  # the reach ends within a word
        ("203.0.113.7 is " + "x " * 15 + "1 buildstore", "[IP] is " + "x " * 15 + "1 buildstore"),
        ("rebuild " + "x " * 17 + " 203.0.113.7", "rebuild " + "x " * 17 + " [IP]"),
        ("build 1.2.3.4", "build 1.2.3.4"),
        ("1.2.3.4 releases", "1.2.3.4 releases"),
        ("version 1.2.3.4 runs", "version 1.2.3.4 runs"),
        ("+1 (555) 123-4567.x@y.com", "[PHONE]"),
        ("+1 (555) 123-4567, x@y.com", "[PHONE], [EMAIL]"),
    ]
    out = private.redact(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string"))
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [x for _, x in cases]


def test_op4(docs, bench):
    items = [(r["item_id"] if r["item_id"] is not None else "null", r["text"]) for r in bench.collect()]
    want = sorted([(k, *x) for k, x in zip([k for k, _ in pairs(docs)], brute.contaminated([t for _, t in pairs(docs)], items))], key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(rows_of(decontam.op4(docs, bench).select(columns)), key=repr) == want
    blocks = decontam.find(docs, bench, block_bytes=40)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], len(r["items"])) for r in blocks.collect()) == sorted((repr(x[0]), *x[1:4]) for x in want)
    clean = decontam.decontaminate(docs, bench, block_bytes=40)
    assert clean.columns == docs.columns
    assert sorted([r["doc_id"] for r in clean.collect()], key=repr) == sorted([x[0] for x in want if not x[5]], key=repr)


def test_op5(docs):
    out = quality.op5(docs)
    want = sorted([(k, *brute.quality(t)) for k, t in pairs(docs)], key=repr)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(rows_of(out.select(columns)), key=repr) == want
    assert out.where("base_failed AND kept").count() == 0


def test_op6(spark, docs):
    out = {r["doc_id"]: r for r in langid.op6(docs).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[18]["lang_pred"] == "und" and out[18]["score"] == 0
    assert all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in out.values())
    rng = random.Random(1)
    german = "der die und ist nicht ein eine mit auf für haus straße über".split()
    rows = [(k, prose(rng, 30) if k % 2 else " ".join(rng.choice(german) for _ in range(30)), "en" if k % 2 else "de") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.op6(df).join(df, "doc_id").where("held_out")
    assert held.count() > 20 and held.where("lang_pred <> lang").count() == 0


def test_op7_and_op8(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib = piece_codec.codec(piece_codec.model_path()).lib
    own = pairs(docs)
    ids = lib.encode([t or "" for _, t in own])
    want = sorted([(k, i, lib.decode(i)) for (k, _), i in zip(own, ids)], key=repr)
    assert sorted(rows_of(piece_codec.encode(docs, piece_codec.model_path())), key=repr) == want
    n = [len(e.ids) for e in Tokenizer.from_file(path("byte_bpe_50k.json")).encode_batch([t or "" for _, t in own], add_special_tokens=False)]
    got = sorted(rows_of(token_counts.op8(docs).select("doc_id", "n_bytes", "n_tokens")), key=repr)
    assert got == sorted([(k, len((t or "").encode()), x) for (k, t), x in zip(own, n)], key=repr)


def test_random_texts_have_the_libraries_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(2)
    alphabet = list(" \n\t'abstmrevl.,19é日　▁<|>") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    c = piece_codec.codec(piece_codec.model_path())
    got = [piece_codec._ids(x).tolist() for _, x, _ in piece_codec._texts(c, pa.array(texts))]
    assert got == c.lib.encode(texts)
    counts = token_counts.text_counts(pa.array(texts), token_counts.transducer(path("byte_bpe_50k.tiktoken")), "<|endoftext|>")[1]
    assert counts.tolist() == [len(e.ids) for e in Tokenizer.from_file(path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_op9(spark, docs):
    out = ring.op9(docs)
    assert out.count() == docs.count()
    assert out.select("shard", "slot").distinct().count() == docs.count()
    many = spark.range(4003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    loads = sorted(r["count"] for r in ring.op9(many).groupBy("shard").count().collect())
    assert len(loads) == 40 and loads[-1] - loads[0] <= 1
    gap = ring.op9(many).groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap"), F.min("slot").alias("first")).collect()
    assert all(r["gap"] == 0 and r["first"] == 0 for r in gap)
    same = ring.shard_documents(many, 40).alias("a").join(ring.shard_documents(many, 41).alias("b"), "doc_id").where("a.shard = b.shard").count()
    assert same > 0.5 * 4003


def test_op10(docs):
    want = brute.unigrams(pairs(docs.dropDuplicates(["doc_id", "text"])))
    out = {r["doc_id"]: r for r in lm.op10(docs.dropDuplicates(["doc_id", "text"])).collect()}
    assert out.keys() == want.keys()
    for k, (n, known, total, base) in want.items():
        r = out[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_unit_probabilities_sum_to_one():
    model = lm.LogBilinear(np.full(lm.UNITS, 1 / lm.UNITS))
    first, second, norm = model.tables()[0]
    p = 10.0 ** (first[3].astype(float) + second[5] - norm[3, 5])
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_empty_tables(empty, bench):
    for f in (bwt_dups.op1, near_dups.op2, private.op3, quality.op5, langid.op6, piece_codec.op7, token_counts.op8, ring.op9, lm.op10):
        assert f(empty).count() == 0
    assert decontam.op4(empty, bench).count() == 0
    assert isinstance(near_dups.keep_one(empty).schema, T.StructType)


def test_empty_benchmark(docs, bench):
    assert decontam.op4(docs, bench.limit(0)).where("contaminated").count() == 0
