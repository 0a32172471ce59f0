"""Language identification by nearest centroid.

A text is the vector of its byte n-grams (orders 1 to 3, hashed to ``DIMS``
places), weighted ln(1 + tf) * idf and normalised.  Each language keeps several
centroids, found by spherical k-means over a bounded sample of labelled texts:
``SAMPLE`` texts in all, shared equally among the labels and chosen by the hash of
their id.  Every label is learned, by ``LEAST`` of its texts at least (all, if it has fewer), so with more
than ``SAMPLE / LEAST`` labels the sample and the model grow with the labels, not with the documents.  A text takes the language of the centroid with the largest
cosine; it is rejected if that cosine lies below ``REJECT`` times the cosine
that nearly all (``LOW``) of the centroid's language's own sample reach.

Edge cases: null text and text without a letter is "und", score 0, rejected;
rows with a null id or null label never teach; without any labelled row all is
"und"; ties go to the language that sorts first; whole texts are read, of
whatever length; repeated rows are treated alike; an empty table gives no rows;
extra columns are kept by ``keep_known`` and ignored by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import textbytes as tb

DIMS = 1 << 13
ORDERS = (1, 2, 3)
SAMPLE = 1600
CENTROIDS = 4
ROUNDS = 12
LOW = 0.01
REJECT = 0.3
SLICE_BYTES = 1 << 20
SLICE_TEXTS = 128
LEAST = 4
BROADCAST_ROWS = 1_000_000


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x DIMS counts of hashed n-grams; none crosses the end of a text."""
    n = len(offsets) - 1
    low = tb.LOWER[data].astype(np.uint32)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * DIMS
    out = np.zeros(n * DIMS, np.int64)
    for order in ORDERS:
        if len(low) < order:
            continue
        m = len(low) - order + 1
        gram = np.full(m, order, np.uint32)
        for k in range(order):
            gram = gram * np.uint32(0x01000193) ^ low[k : k + m]
        place = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
        whole = text[:m] == text[order - 1 :]
        out += np.bincount((place + text[:m])[whole], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = tb.flat(column)
    for i, j in tb.slices(offsets, SLICE_BYTES):
        for a in range(i, j, SLICE_TEXTS):
            b = min(j, a + SLICE_TEXTS)
            yield a, b, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of_centroid: np.ndarray
    reach: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf.astype(np.float32)) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each text."""
        cosines = self.vectors(tf) @ self.centroids.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, begun with the vectors farthest from each other."""
    chosen = [x.mean(0)]
    near = x @ chosen[0]
    seeds = []
    for _ in range(min(k, len(x))):
        seeds.append(x[near.argmin()])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        used = np.bincount(of, minlength=len(c)) > 0
        c = sums[used] / np.maximum(np.linalg.norm(sums[used], axis=1, keepdims=True), 1e-12)
    return c


def train(labels: list[str], tf: np.ndarray) -> Model:
    """The model of labelled counts."""
    names = sorted(set(labels))
    place = {x: k for k, x in enumerate(names)}
    of = np.array([place[x] for x in labels], np.int64)
    n = max(len(labels), 1)
    model = Model(names, np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    model.idf = (np.log((1 + n) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x = model.vectors(tf)
    groups = [clusters(x[of == k], CENTROIDS) for k in range(len(names))]
    if groups:
        model.centroids = np.concatenate(groups).astype(np.float32)
        model.of_centroid = np.repeat(np.arange(len(names)), [len(g) for g in groups])
        own = [(x[of == k] @ g.T).max(1) for k, g in enumerate(groups)]
        low = np.array([np.quantile(y, LOW) for y in own]) * REJECT
        model.reach = low[model.of_centroid]
    return model


def fit(docs: DataFrame, taught: Column) -> Model:
    """The model of the rows for which ``taught`` holds."""
    rows = docs.where(taught & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.count()
    if not labels:
        return train([], np.zeros((0, DIMS), np.int64))
    share = max(LEAST, SAMPLE // labels)
    # twice the share by hash, then the share by rank; a row a label is joined
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id"), 11) / float(1 << 53)
    picked = rows.select("lang", "text", "doc_id", drawn.alias("draw")).join(F.broadcast(sizes) if labels <= BROADCAST_ROWS else sizes, "lang")
    picked = picked.where(F.col("draw") < F.lit(2.0 * share + 20) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    picked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            for a, b, tf in slices(batch.column(1)):
                used = [np.flatnonzero(r) for r in tf]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()),
                        pa.array([r[u].astype(np.uint32).tobytes() for r, u in zip(tf, used)], pa.binary()),
                    ],
                    names=["lang", "places", "counts"],
                )

    sample = picked.transform(tb.bounded).mapInArrow(run, "lang string, places binary, counts binary").toArrow()
    tf = np.zeros((sample.num_rows, DIMS), np.uint32)
    for row, places, n in zip(tf, sample.column(1).to_pylist(), sample.column(2).to_pylist()):
        row[np.frombuffer(places, np.uint16)] = np.frombuffer(n, np.uint32)
    labels = sample.column(0).to_pylist()
    order = sorted(range(len(labels)), key=lambda k: (labels[k], tf[k].tobytes()))
    return train([labels[k] for k in order], tf[order])


def _judge(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    n = len(column)
    lang, score, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
    if len(model.centroids):
        names = np.array(model.languages, dtype=object)
        for a, b, tf in slices(column):
            best, cosine = model.nearest(tf)
            lang[a:b], score[a:b], rejected[a:b] = names[model.of_centroid[best]], cosine, cosine < model.reach[best]
    letters = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    lang[~letters], score[~letters], rejected[~letters] = "und", 0.0, True
    return lang.tolist(), score, rejected


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            lang, score, rejected = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").transform(tb.bounded).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            yield batch.filter(pa.array(~_judge(shared.value, batch.column(at))[2]))

    return docs.transform(tb.bounded).mapInArrow(run, docs.schema)


def held_out(parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op6(docs: DataFrame) -> DataFrame:
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
