"""The whole pipeline against a composition of plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import langid, piece_codec, private
from tests.llm import brute
from tests.llm.test_operators import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept_key string, text_key string"
GERMAN = "das haus am alten wasser steht und niemand weiß wohin es in der nacht geht während der regen fällt".split()


def corpus(seed=3):
    rng = random.Random(seed)
    english = [prose(rng, rng.randint(60, 140)) for _ in range(24)]
    german = [" ".join(rng.choice(GERMAN) + str(rng.randint(0, 40)) for _ in range(90)) for _ in range(16)]
    items = [prose(rng, 14), prose(rng, 30)]
    rows = [(k, t, "en") for k, t in enumerate(english)] + [(100 + k, t, "de") for k, t in enumerate(german)]
    near = english[0].split()
    near[30] = "otherwise"
    rows += [
        (200, english[0], None), (201, " ".join(near), "en"), (None, english[1] + " tail", None), (None, prose(rng, 70), "en"),
        (203, prose(rng, 50) + " " + items[0] + " " + prose(rng, 20), "en"), (204, prose(rng, 50) + " " + items[1].upper(), "en"),
        (205, prose(rng, 60) + " mail me: ann.b@mail.example.org or +1 (202) 555-0143", "en"), (206, None, "en"), (207, "", None), (208, "123 !!", "de"),
        (209, "где находится насос и сколько стоит доставка " * 5, None), (210, prose(rng, 30_000), "en"), (3, english[3], "en"),
    ]
    return [(k, t, lang, "s", None if t is None else len(t), "x", "y", "z") for k, t, lang in rows], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def expected(spark, folder):
    """(doc_id, tokens, digest of the decoded text): stage after stage, by plain code."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    keys = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    known = {r["doc_id"] for r in langid.predict(keys, model).where("NOT rejected").collect()}
    rows = [x for n, x in enumerate(rows) if n in known]
    classes = brute.classes([t for _, t in rows])
    best = {}
    for (k, t), c in zip(rows, classes):
        order = (k is None, k or 0, hashlib.md5((t or "").encode()).digest(), k, t)
        best[c] = min(best.get(c, order), order)
    rows = [x[3:] for x in best.values()]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute.contaminated([t for _, t in rows], items)
    rows = [x for x, h in zip(rows, hit) if not h[-1]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lib = piece_codec.codec(piece_codec.model_path()).lib
    out = []
    for r in private.redact(frame).collect():
        ids = lib.encode(r["text"] or "")
        out.append((r["doc_id"], len(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    return out


def test_rows(spark, folder):
    got = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(expected(spark, folder), key=repr)
    ids = [x[0] for x in got]
    assert not {200, 201, 203, 204, 206, 207, 208, 209} & set(ids) and {0, 100, 205, 210} <= set(ids) and ids.count(3) == 1


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
