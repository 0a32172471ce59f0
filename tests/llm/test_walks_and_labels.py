"""Placement on the ring against a plain walk; languages beyond the sample's size, and ties."""

import random

import pytest
from pyspark.sql import functions as F

from granary.llm import langid, ring


def walked(rows, shards, vnodes):
    """[(row, shard, slot)]: rows go to their own shards first, then on around the ring, one by one."""
    nodes = ring.ring_nodes(shards, vnodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], []

    def put(row, shard):
        out.append((row, shard, used[shard]))
        used[shard] += 1

    for row in sorted(rows):
        home = next((k for k, (cell, _) in enumerate(nodes) if cell >= row[0]), 0)
        if used[nodes[home][1]] < room[nodes[home][1]]:
            put(row, nodes[home][1])
        else:
            left.append((row, home))
    for row, home in left:
        at = (home + 1) % len(nodes)
        while used[nodes[at][1]] >= room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        put(row, nodes[at][1])
    return out


@pytest.mark.parametrize(("shards", "vnodes"), [(7, 3), (40, 64)])
def test_ring_against_a_plain_walk(spark, shards, vnodes):
    rng = random.Random(shards)
    data = [(k, rng.choice(["a", "b", None, "long " * rng.randint(1, 20)])) for k in range(600)] + [(5, "again")] * 40
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64("doc_id", text)
    cells = docs.select(F.shiftrightunsigned(h, 48).cast("int"), h, "doc_id", F.crc32(text.cast("binary")), (F.octet_length(text) + 16).cast("long"))
    want = sorted((r[2], r[4], r[3], s, n) for r, s, n in walked([tuple(r) for r in cells.collect()], shards, vnodes))
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in ring.shard_documents(docs, shards, vnodes).collect())
    assert got == want


def test_every_label_is_learned(spark):
    rng = random.Random(1)
    texts = {f"l{k:03d}": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)) for k in range(450)}
    rows = [(k, t, lang) for k, (lang, t) in enumerate(texts.items())]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == sorted(texts)
    asked = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {k: lang for k, _, lang in rows}


def test_equal_cosines_go_to_the_first_language(spark):
    rows = [(1, "the water runs", "xx"), (2, "the water runs", "aa"), (3, "another text of it", "mm")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(1, "the water runs")], "doc_id long, text string")
    assert langid.predict(asked, model).first()["lang_pred"] == "aa"
