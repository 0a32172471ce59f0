"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Counts of all training tokens are gathered first (one distributed aggregate).
The most frequent tokens are units of their own; all others fall into bins by
their last two bytes, and inside its bin a token has its smoothed share of the
counts.  The neural model predicts the unit of a token from the units of the
two before it: the context vector is the sum of two scaled unit vectors, and
the score of a unit is its product with that unit's output vector plus a bias.

Training documents are dealt by a hash of id and text into ``ROUNDS`` rounds and,
within a round, into parts of about ``PART_BYTES`` of text, so neither files nor
partitions matter.  In a round every part trains in numpy on all its tokens, in
the order of that hash, from the weights at hand, against shared noise drawn from the unit
counts; the weights are then averaged by token count in a tree.  For scoring, the exponentials
factor over the two context places, so one matrix product gives the normaliser
of every pair of context units, and the token probabilities sum to one.

The counts of the ``COMMON`` most frequent tokens of at most ``TOKEN_BYTES``
bytes are broadcast, a fixed size; all other tokens get their counts by a join.

Edge cases: null text is empty and has its end token only; rows with a null id
are scored and never teach; without any training row the model is uniform;
repeated rows are scored alike and each counted; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import textbytes as tb
from granary.llm.langid import held_out
from granary.llm.scratch import cut

END = "\n"  # no word holds white space
COMMON = 1 << 18
TOKEN_BYTES = 64
OWN = 768
BINS = 256
UNITS = OWN + BINS
DIM = 24
NOISE = 48
BATCH = 4096
RATE = 0.15
SMOOTH = 0.1
SLICE_BYTES = 8 << 20
FAN_IN = 64
ROUNDS = 3
PART_BYTES = 16 << 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, code of each token, first token of each text); every text ends with END."""
    low = tb.LOWER[data]
    starts, ends, at = tb.words(low, offsets, tb.WHITE)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = tb.pieces(low[~tb.WHITE[low]], bounds).dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
    n = len(at) - 1
    codes = np.full(len(starts) + n, len(distinct) - 1, np.int64)
    codes[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(at))] = np.asarray(coded.indices)
    return distinct, codes, at + np.arange(n + 1)


def _slices(column: pa.Array):
    data, offsets = tb.flat(column)
    for i, j in tb.slices(offsets, SLICE_BYTES):
        yield i, j, *tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            for _, _, distinct, codes, _ in _slices(batch.column(0)):
                n = np.bincount(codes, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(n, pa.int64())], names=["token", "n"])

    return docs.select("text").transform(tb.bounded).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def bins(distinct: pa.Array) -> np.ndarray:
    """Unit of each token that has none of its own."""
    raw = distinct.cast(pa.large_string()).cast(pa.large_binary())
    data, offsets = tb.flat(distinct)
    ends, sizes = offsets[1:], np.diff(offsets)
    if not len(data):
        return np.full(len(raw), OWN, np.int64)
    last = data[np.maximum(ends - 1, 0)].astype(np.int64)
    before = np.where(sizes > 1, data[np.maximum(ends - 2, 0)].astype(np.int64), 0)
    return OWN + (last * 31 + before * 7) % BINS


@dataclass
class Vocabulary:
    """The common tokens, END first, then by falling count, with counts; sums over the bins; totals."""

    common: pa.Array
    c: np.ndarray
    bin_tokens: np.ndarray
    bin_distinct: np.ndarray
    total: int
    distinct: int

    def units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit, place among the common tokens or -1) of each token."""
        place = pc.fill_null(pc.index_in(distinct, value_set=self.common), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where((place >= 0) & (place < OWN), place, bins(distinct)), place

    def noise(self) -> np.ndarray:
        out = np.full(UNITS, 0.5)
        out[: min(OWN, len(self.c))] += self.c[:OWN]
        out[OWN:] += self.bin_tokens
        return out / out.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Of the table of counts: the common tokens and, over all others, sums a bin."""
    top = counts.where(F.octet_length("token") <= TOKEN_BYTES).orderBy((F.col("token") == END).desc(), F.desc("c"), "token").limit(COMMON).toArrow()
    common = pa.concat_arrays(top.column(0).chunks) if top.num_rows else pa.array([], pa.string())
    common = common.cast(pa.large_string())
    if not len(common) or common[0].as_py() != END:
        common = pa.concat_arrays([pa.array([END], pa.large_string()), common])
        c = np.concatenate([[0], top.column(1).to_numpy()]).astype(np.int64)
    else:
        c = top.column(1).to_numpy().astype(np.int64)
    shared = counts.sparkSession.sparkContext.broadcast(common[:OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
        for batch in tb.tidy(batches):
            token = batch.column(0).cast(pa.large_string())
            own = pc.is_valid(pc.index_in(token, value_set=shared.value)).to_numpy(zero_copy_only=False).astype(bool)
            unit = bins(token)[~own]
            n += np.bincount(unit, weights=np.asarray(batch.column(1))[~own], minlength=UNITS).astype(np.int64)
            v += np.bincount(unit, minlength=UNITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(UNITS)), pa.array(n), pa.array(v)], names=["unit", "n", "v"])

    sums = counts.transform(tb.bounded).mapInArrow(run, "unit long, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    by_bin, distinct_by_bin = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for unit, n, v in sums.where(F.col("unit") >= OWN).collect():  # BINS rows
        by_bin[unit - OWN], distinct_by_bin[unit - OWN] = n, v
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    return Vocabulary(common, c, by_bin, distinct_by_bin, int(total), int(distinct))


class LogBilinear:
    """Unit vectors ``r``, output vectors ``q``, biases ``b`` and the two scales of the context places."""

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(7)
        self.noise = noise
        self.shapes = {"r": (UNITS, DIM), "q": (UNITS, DIM), "b": (UNITS,), "s": (2, DIM)}
        self.w = {
            "r": rng.normal(0, 0.3, (UNITS, DIM)).astype(np.float32),
            "q": rng.normal(0, 0.05, (UNITS, DIM)).astype(np.float32),
            "b": np.log(noise).astype(np.float32),
            "s": np.stack([np.ones(DIM), np.full(DIM, 0.5)]).astype(np.float32),
        }
        self.g = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.w.items()}

    def _move(self, name: str, rows, gradient: np.ndarray) -> None:
        g = self.g[name]
        g[rows] += gradient * gradient
        self.w[name][rows] += RATE * gradient / np.sqrt(g[rows])

    @staticmethod
    def _summed(units: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(units, kind="stable")
        own = units[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return own[first], np.add.reduceat(gradient[order], first, axis=0)

    def learn(self, u1: np.ndarray, u2: np.ndarray, unit: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One step on a batch: raise its units' scores over those of ``noise``."""
        r, q, b, s = (self.w[k] for k in "rqbs")
        a1, a2 = r[u1], r[u2]
        h = a1 * s[0] + a2 * s[1]
        own = q[unit]
        positive = 1 / (1 + np.exp(np.clip((h * own).sum(1) + b[unit] - log_noise[unit], -30, 30)))
        others = q[noise]
        negative = -1 / (1 + np.exp(np.clip(log_noise[noise] - b[noise] - h @ others.T, -30, 30)))
        dh = positive[:, None] * own + negative @ others
        n = np.float32(len(unit))
        dq = np.concatenate([positive[:, None] * h, negative.T @ h])
        db = np.concatenate([positive, negative.sum(0)])
        rows, both = self._summed(np.concatenate([unit, noise]), np.concatenate([dq, db[:, None]], axis=1))
        self._move("q", rows, both[:, :-1] / n * 8)
        self._move("b", rows, both[:, -1] / n * 8)
        rows, dr = self._summed(np.concatenate([u1, u2]), np.concatenate([dh * s[0], dh * s[1]]))
        self._move("r", rows, dr / n * 8)
        self._move("s", slice(None), np.stack([(dh * a1).mean(0), (dh * a2).mean(0)]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.shapes]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.w[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 scores by (unit before, unit) with the bias, by (unit two before, unit), less the normaliser.

        P(unit | u1, u2) = 10 ** (first[u1, unit] + second[u2, unit] - norm[u1, u2]).
        """
        r, q, b, s = (self.w[k].astype(np.float64) for k in "rqbs")
        first = (r * s[0]) @ q.T + b
        second = (r * s[1]) @ q.T
        m1, m2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        z = np.log(np.exp(first - m1) @ np.exp(second - m2).T) + m1 + m2.T
        return np.stack([first, second, z]).astype(np.float32) / np.float32(np.log(10)), z


def contexts(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units one and two before each token; before a text stand ends."""
    u1, u2 = np.zeros(len(units), units.dtype), np.zeros(len(units), units.dtype)
    u1[1:], u2[2:] = units[:-1], units[:-2]
    first = at[:-1]
    u1[first] = u2[first] = 0
    second = first + 1
    u2[second[second < len(units)]] = 0
    return u1, u2


class Trainer:
    """A model that learns from texts, begun with the given weights."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, part: int):
        self.vocabulary = vocabulary
        self.model = LogBilinear(vocabulary.noise())
        self.model.load(weights)
        self.rng = np.random.default_rng(part)
        self.cumulated = np.cumsum(self.model.noise)
        self.log_noise = np.log(NOISE * self.model.noise).astype(np.float32)
        self.seen = 0

    def learn(self, column: pa.Array) -> None:
        for _, _, distinct, codes, at in _slices(column):
            unit = self.vocabulary.units(distinct)[0].astype(np.int32)[codes]
            u1, u2 = contexts(unit, at)
            for k in range(0, len(unit), BATCH):
                noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), UNITS - 1)
                self.model.learn(u1[k : k + BATCH], u2[k : k + BATCH], unit[k : k + BATCH], noise, self.log_noise)
            self.seen += len(unit)

    def row(self, part: int) -> pa.RecordBatch:
        weighted = (self.model.flat() * self.seen).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.seen]), pa.array([weighted], pa.binary())], names=["part", "n", "w"])


def added(weights: DataFrame, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """Sums of (part, n, w) by a tree, until at most ``fan_in`` rows are left; no task gets more than ``fan_in``."""

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # sums of floats depend on the order
        w = np.sum([np.frombuffer(x, np.float64) for x in table.column("w").to_pylist()], axis=0)
        part, n = table.column("part")[0].as_py(), pc.sum(table.column("n")).as_py()
        return pa.table({"part": [part], "n": [n], "w": pa.array([w.tobytes()], pa.binary())})

    while parts > fan_in:
        groups = -(-parts // fan_in)
        weights = (
            weights.groupBy(F.pmod("part", F.lit(groups)).alias("to"))
            .applyInArrow(summed, "part long, n long, w binary")
            .withColumn("part", F.pmod("part", F.lit(groups)))
        )
        parts = groups
    return weights


def train(docs: DataFrame, shared, start: LogBilinear) -> LogBilinear:
    """The model trained on every token of ``docs``; ``shared`` is the broadcast vocabulary."""
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size"))
    size = dealt.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // (ROUNDS * PART_BYTES)))
    context = docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        weights = context.broadcast(start.flat())

        def run(batches: Iterator[pa.RecordBatch], weights=weights, turn=turn) -> Iterator[pa.RecordBatch]:
            at, trainer = -1, None
            for batch in tb.tidy(batches):
                part = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b > a and part[a] != at:
                        if trainer is not None and trainer.seen:
                            yield trainer.row(at)
                        at = int(part[a])
                        trainer = Trainer(shared.value, weights.value, at * ROUNDS + turn)
                    if b > a:
                        trainer.learn(batch.column(1)[a:b])
            if trainer is not None and trainer.seen:
                yield trainer.row(at)

        own = (
            dealt.where(F.pmod("h", F.lit(ROUNDS)) == turn)
            .select(F.pmod(F.shiftright("h", 20), F.lit(parts)).cast("long").alias("part"), "text", "h")
            .repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "h", "text").select("part", "text")
        )
        rows = added(own.transform(tb.bounded).mapInArrow(run, "part long, n long, w binary"), parts).toArrow().sort_by("part")  # at most FAN_IN rows
        n = sum(rows.column("n").to_pylist())
        if n:
            start.load(np.sum([np.frombuffer(x, np.float64) for x in rows.column("w").to_pylist()], axis=0) / n)
    return start


def score(docs: DataFrame, taught: Column) -> tuple[DataFrame, Vocabulary]:
    """(doc_id, n_tokens, n_known, base_score, score) of every document; the rows with ``taught`` teach."""
    context = docs.sparkSession.sparkContext
    teach = docs.where(taught)
    counts = cut(token_counts(teach), "counts")
    vocab = vocabulary(counts)
    shared = context.broadcast(vocab)
    model = train(teach, shared, LogBilinear(vocab.noise()))
    tables = context.broadcast(model.tables()[0])
    log_den = np.log10(vocab.total + SMOOTH * (vocab.distinct + 1))
    bin_den = np.log10(vocab.bin_tokens + SMOOTH * (vocab.bin_distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        v = shared.value
        first, second, norm = tables.value
        for batch in tb.tidy(batches):
            for i, j, distinct, codes, at in _slices(batch.column(1)):
                unit, place = v.units(distinct)
                common = place >= 0
                c = np.where(common, v.c[np.maximum(place, 0)], 0)
                gain = np.where(common, np.log10(c + SMOOTH), 0.0)
                inside = np.where(unit < OWN, 0.0, gain - bin_den[np.maximum(unit - OWN, 0)])
                known = common & (c > 0)
                units = unit[codes]
                u1, u2 = contexts(units, at)
                lm = (first[u1, units] + second[u2, units] - norm[u1, u2]).astype(np.float64) + inside[codes]
                n = np.diff(at)
                doc = np.repeat(np.arange(j - i), n)
                rare = ~common[codes]
                pairs, tf = np.unique(doc[rare] * len(distinct) + codes[rare], return_counts=True)
                of = pa.array(np.searchsorted(pairs, np.arange(j - i + 1) * len(distinct)), pa.int32())
                words = distinct.take(pa.array(pairs % len(distinct))).cast(pa.string())
                out = [
                    pa.array((part << 40) + row + np.arange(j - i)),
                    batch.column(0)[i:j],
                    pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat(known[codes].astype(np.int64), at[:-1])),
                    pa.array(np.add.reduceat(gain[codes], at[:-1]) - n * log_den),
                    pa.array(np.add.reduceat(lm, at[:-1])),
                    pa.ListArray.from_arrays(of, words),
                    pa.ListArray.from_arrays(of, pa.array(tf, pa.int64())),
                ]
                row += j - i
                yield pa.RecordBatch.from_arrays(
                    out, names=["row", "doc_id", "n_tokens", "known", "base", "lm", "rare", "tf"]
                )

    schema = (
        "row long, doc_id long, n_tokens long, known long, base double, lm double, rare array<string>, tf array<long>"
    )
    scored = cut(docs.select("doc_id", "text").transform(tb.bounded).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.tf").alias("tf")
    )
    c = F.coalesce("c", F.lit(0))
    added = (
        rare.join(counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("tf") * F.log10(c + SMOOTH)).alias("gain"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"))
    )
    gain = F.coalesce("gain", F.lit(0.0))
    out = scored.drop("rare", "tf").join(added, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("lm") + gain).alias("score"),
    )
    return out, vocab


def op10(docs: DataFrame) -> DataFrame:
    held = held_out(10, 0)
    out, vocab = score(docs, F.col("doc_id").isNotNull() & ~held)
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
