"""Near-duplicate classes by ProbMinHash, banding and verification.

1. Equal texts (by MD5, the count pre-aggregated before the shuffle) become one
   node.  A node's distinct 5-word shingles, each of weight 1, give a
   ProbMinHash signature, whose places agree with the Jaccard similarity that
   links are verified on; ``BANDS`` bands of ``ROWS`` places are its buckets.
   (Weights that grow with the count would lose links: what two texts do not
   share may be what repeats.)
2. In each bucket the hub (the member whose buckets are the fullest: the text
   the others are copies of) is compared with all other members.  Pairs are
   verified on the whole shingle sets: a link is a Jaccard similarity of
   ``SIMILARITY`` or more.  Components of the links are labels.
3. Buckets whose members still have several labels are settled: members that
   no other label's signature comes near are dropped, the rest is compared
   exactly.  A bucket of more than ``BLOCK`` such members is compared in blocks.
   So no bucket emits its pairs, and none has a cap.
4. Components of all links are the classes.

Two texts at the limit of 0.8 share no bucket with a probability of 3 in a
million.

Edge cases: null text is empty; texts without words are in a class only with
texts equal to them; a text of fewer than five words is one shingle; class ids
are the least doc_id of the class (null only if all its ids are null); repeated
rows are copies; an empty table gives no rows; extra columns are kept by
``keep_one`` and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import shingles as sh
from granary.llm import textbytes as tb
from granary.llm.components import components
from granary.llm.runs import runs
from granary.llm.scratch import cut, free

BANDS = 32
ROWS = 5
SIMILARITY = 0.8
NEAR = 0.62
BLOCK = 2048
SLICE_BYTES = 2 << 20
BROADCAST_ROWS = 1_000_000


def _key(docs: DataFrame) -> DataFrame:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shingles, bands, one byte of each place) of texts (key, text)."""
    m = BANDS * ROWS
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(1))
        for i, j in tb.slices(offsets, SLICE_BYTES):
            words, at = sh.word_hashes(batch.column(1), i, j, data, offsets)
            text, hashes, _ = sh.shingles(words, at)
            signature = sh.prob_min_hash(text, hashes, np.ones(len(text)), j - i, m)
            rows = signature.reshape(j - i, BANDS, ROWS)
            bands = np.arange(BANDS, dtype=np.uint64)[None, :]
            for k in range(ROWS):
                bands = tb.mixed(bands * np.uint64(3) + rows[:, :, k])
            sizes = np.bincount(text, minlength=j - i)
            some = np.flatnonzero(sizes)
            places = np.arange(0, (len(some) + 1) * BANDS, BANDS, dtype=np.int32)
            low = (tb.mixed(signature) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j].take(pa.array(some)),
                    pa.array(sizes[some], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(bands[some].ravel().view(np.int64))),
                    pa.array([low[k].tobytes() for k in some], pa.binary()),
                ],
                names=["key", "n", "bands", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sorted shingle hashes as bytes) of texts (node, text)."""
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(1))
        for i, j in tb.slices(offsets, SLICE_BYTES):
            words, at = sh.word_hashes(batch.column(1), i, j, data, offsets)
            text, hashes, _ = sh.shingles(words, at)
            of = np.searchsorted(text, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([hashes[of[k] : of[k + 1]].tobytes() for k in range(j - i)], pa.binary())],
                names=["node", "set"],
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v, their sets) that are links."""
    for batch in tb.tidy(batches):
        good = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            good.append(both >= SIMILARITY * ((len(a) + len(b)) // 8 - both))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs (bucket, block, node, label, n, signature), the members that another label's signature comes near."""
    for run in runs(batches, 2):
        label, n = np.asarray(run.column("label")), np.asarray(run.column("n"))
        s = np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint8).reshape(len(label), -1)
        near = np.zeros(len(label), dtype=bool)
        for k in range(len(label)):
            other = np.flatnonzero(
                (label != label[k]) & (np.minimum(n, n[k]) >= SIMILARITY * np.maximum(n, n[k])) & ~(near & near[k])
            )
            if len(other):
                close = other[(s[other] == s[k]).mean(1) >= NEAR]
                near[close] = True
                near[k] |= len(close) > 0
        if near.any():
            yield run.select(["bucket", "block", "node", "label"]).filter(pa.array(near)).combine_chunks().to_batches()[0]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs (bucket, block, node, label, set), links that join labels; all pairs are compared, in memory."""
    for run in runs(batches, 2):
        node, label = np.asarray(run.column("node")), np.asarray(run.column("label")).copy()
        sets = [np.frombuffer(x, np.uint64) for x in run.column("set").to_pylist()]
        n = np.array([len(x) for x in sets])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        width = max(1, (8 << 20) // len(sets))
        for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            lo, hi = np.searchsorted(at, [a, a + width])
            x = np.zeros((len(sets), width), np.float32)
            x[row[lo:hi], at[lo:hi] - a] = 1
            both += x @ x.T
        links = both >= SIMILARITY * (n[:, None] + n[None, :] - both) - 1e-6
        u, v = [], []
        for i, j in np.argwhere(np.triu(links, 1)):
            if label[i] != label[j]:
                u.append(int(node[i]))
                v.append(int(node[j]))
                label[label == label[j]] = label[i]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _filtered(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one document of each node.

    The nodes are broadcast up to ``BROADCAST_ROWS`` rows; beyond, the texts
    are joined by a shuffle.
    """
    wanted = cut(nodes, "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(_key(docs).alias("key"), "doc_id", "text")
    return texts.join(side, "key").where(F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "text").dropDuplicates(["node"])


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, class_key, n_links) of every document.

    ``class_key`` is the least key of a class and tells classes apart, which
    ``class_id`` does not where ids are null or shared.  ``n_links`` counts the verified links found at the document's text, which
    join it to different texts of its class.
    """
    spark = docs.sparkSession
    keyed = docs.select(_key(docs).alias("key"), "doc_id")
    copies = keyed.groupBy("key").agg(F.min("doc_id").alias("least_id"))
    signed = (
        docs.select(_key(docs).alias("key"), "text")
        .transform(tb.bounded).mapInArrow(_signed, "key binary, n long, bands array<long>, signature binary")
        .groupBy("key")
        .agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
    )
    nodes = cut(
        signed.join(copies, "key").select(F.monotonically_increasing_id().alias("node"), "key", "least_id", "n", "bands", "signature"),
        "nodes",
    )
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(banded.join(full, "bucket"), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = cut(
        members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("h"))
        .select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")),
        "hubs",
    )
    in_buckets = nodes.join(weight.select("node"), "node", "left_semi").select("node", "key", "least_id")
    sets = cut(_filtered(docs, in_buckets).transform(tb.bounded).mapInArrow(_sets, "node long, set binary"), "sets")
    alike = F.least("n", "hub_n") >= F.lit(SIMILARITY) * F.greatest("n", "hub_n")
    pairs = (
        members.join(hubs, "bucket").where((F.col("node") != F.col("hub")) & alike)
        .select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    )

    def of(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))

    links = cut(
        pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "set_u", "set_v").transform(tb.bounded).mapInArrow(_verified, "u long, v long"),
        "links",
    )
    labels = cut(components(links), "labels")
    open_members = (
        members.join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
        .join(labels, "node", "left")
        .select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    )
    open_members = cut(open_members, "open")
    unsettled = (
        open_members.groupBy("bucket")
        .agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("size"))
        .where("a <> b")
        .select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    # block pairs (x, y), x <= y, numbered x * blocks + y; one block in nearly all buckets
    x = F.pmod(F.xxhash64("node"), F.col("blocks"))
    spread = open_members.join(unsettled, "bucket").withColumn(
        "block",
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                lambda y: F.least(x, y) * F.col("blocks") + F.greatest(x, y),
            )
        ),
    )
    near = (
        spread.join(nodes.select("node", "signature"), "node")
        .select("bucket", "block", "node", "label", "n", "signature")
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block")
        .transform(tb.bounded).mapInArrow(_may_link, "bucket long, block long, node long, label long")
    )
    more = (
        near.join(sets, "node")
        .select("bucket", "block", "node", "label", "set")
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block")
        .transform(tb.bounded).mapInArrow(_settled, "u long, v long")
    )
    more = cut(more, "more")
    if more.isEmpty():
        final = labels
    else:
        final = cut(components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more)), "final")
    degrees = links.unionByName(more).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    labelled = (
        nodes.select("node", "key", "least_id")
        .join(final, "node")
        .join(degrees, "node", "left")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("key").alias("class_key"))
    linked = cut(labelled.join(least, "label").select("key", "class_id", "class_key", "n_links"), "linked")
    by_key = copies.join(linked, "key", "left").select(
        "key",
        F.coalesce("class_id", "least_id").alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    # written first: a join of plain exchanges is one whose large partitions can be split
    return keyed.join(cut(by_key, "by_key"), "key").select("doc_id", "key", "class_id", "class_key", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: of the least id, null last, then of the least key."""
    cols = docs.columns
    i, k, h = free(cols, "kept_id"), free(cols, "kept_key"), free(cols, "text_key")
    found = cut(classes(docs), "classes")
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("kept"))
    gone = found.join(
        kept.select(F.col("kept.doc_id").alias(i), F.col("kept.key").alias(k)),
        F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("key") == F.col(k)),
        "left_anti",
    ).select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    gone = cut(gone, "gone")
    small = gone.count() <= BROADCAST_ROWS
    own = docs.withColumn(h, _key(docs))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k))
    out = own.join(F.broadcast(gone) if small else gone, same, "left_anti")
    twice = found.groupBy("doc_id", "key").count().where("count > 1")
    if not twice.isEmpty():  # repeated rows: one of them stays
        out = out.dropDuplicates(["doc_id", h])
    return out.select(*[F.col(f"`{c}`") for c in cols])


def op2(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")
