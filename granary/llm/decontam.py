"""Benchmark decontamination by suffix arrays over shards of the documents.

A shard is about two megabytes of whole texts.  Its suffix array holds every word
position from which as many benchmark words follow as the shortest window has
(no other position can begin a match), sorted by their next ``WINDOW`` words.
Every window of every test suffix is searched in it by bisection, which gives
all places of the verbatim match.  Consecutive matches of one item on one
diagonal make up the longest match, whose item, place and length are given.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text (a longer item
is a block of its own; equal items are taken once).  A block's index is a few
arrays, about 150 bytes for each of its words, so what is broadcast has a fixed
bound; a further block is a further pass over all documents that carries on
what earlier ones found.

Edge cases: null text has no words; an item without words has no window; items
that share an id count once; a null item id is listed as "null"; of longest
matches the one of the least item id, then of the least place is given; repeated
rows are treated alike; an empty benchmark leaves every document clean, an empty
table of documents gives no rows; documents with a null id are treated like
others; extra columns are kept by ``decontaminate`` and ignored by ``find``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import textbytes as tb
from granary.llm.scratch import cut

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20

# words "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" of texts with A-Z lower-cased
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[0x30:0x3A] = False
SEPARATOR[0x61:0x7B] = False
SEPARATOR[0x80:] = False


def word_hashes(column: pa.Array, i: int, j: int, data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, index of each text's first word) of texts i to j - 1."""
    part = tb.LOWER[data[offsets[i] : offsets[j]]]
    starts, ends, at = tb.words(part, offsets[i : j + 1] - offsets[i], SEPARATOR)
    return tb.span_hashes(tb.prefix_hashes(part), starts, ends), at


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{4 * rows.shape[1]}").ravel()


class TestSuffixes:
    """The windows of one block of benchmark items."""

    def __init__(self, items: pa.Table):
        ids = np.array(["null" if x is None else str(x) for x in items.column(0).to_pylist()], dtype=object)
        column = items.column(1).combine_chunks() if items.num_rows else pa.array([], pa.string())
        data, offsets = tb.flat(column)
        hashes, at = word_hashes(column, 0, len(ids), data, offsets)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = (numbers + 1).astype(np.uint32)
        self.item_ids, item_of = np.unique(ids.astype(str) if len(ids) else np.zeros(0, "U1"), return_inverse=True)
        # every window of every test suffix: its item, the word it begins with, its size
        words = np.diff(at)
        sizes = np.minimum(words, WINDOW)
        n = np.where(words > 0, words - sizes + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        size = sizes[row]
        low, high = np.zeros((len(row), WINDOW), ">u4"), np.full((len(row), WINDOW), 0xFFFFFFFF, ">u4")
        for k in range(WINDOW):
            inside = np.flatnonzero(size > k)
            low[inside, k] = high[inside, k] = numbers[at[:-1][row[inside]] + start[inside] + k]
        self.low, first, window = np.unique(keys(low), return_index=True, return_inverse=True)
        self.high, self.sizes = keys(high)[first], size[first]
        self.least = int(self.sizes.min()) if len(first) else 0
        owners = np.unique(np.stack([window, item_of[row], start], 1), axis=0) if len(row) else np.zeros((0, 3), np.int64)
        self.owner_at = np.searchsorted(owners[:, 0], np.arange(len(first) + 1))
        self.owners = owners[:, 1:]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the benchmark's vocabulary, 0 if it has none."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            h = hashes[maybe]
            k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[k] == h, k + 1, 0)
        return out

    def search(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches in a shard: (text, word position in the shard, number of the window)."""
        none = np.zeros(0, np.int64)
        if not len(self.low) or not len(hashes):
            return none, none, none
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(hashes)) + text  # one gap after each text
        row = np.zeros(len(hashes) + len(at) + WINDOW, np.int64)
        row[place] = self.numbered(hashes)
        gaps = np.flatnonzero(row == 0)
        p = place[row[place] > 0]
        p = p[gaps[np.searchsorted(gaps, p)] - p >= self.least]
        if not len(p):
            return none, none, none
        suffixes = keys(row[p[:, None] + np.arange(WINDOW)])
        order = np.argsort(suffixes, kind="stable")
        array, p = suffixes[order], p[order]
        lo = np.searchsorted(array, self.low, side="left")
        hi = np.searchsorted(array, self.high, side="right")
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        found = p[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        of = np.searchsorted(place, found)
        return text[of], of, window


def _shards(index: TestSuffixes, column: pa.Array):
    """For each text: (words, covered positions from the text's start, items, longest match as (length, item, place) or None)."""
    data, offsets = tb.flat(column)
    for i, j in tb.slices(offsets, SHARD_BYTES):
        hashes, at = word_hashes(column, i, j, data, offsets)
        text, place, window = index.search(hashes, at)
        step = np.zeros(len(hashes) + WINDOW + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + index.sizes[window], -1)
        covered = np.cumsum(step)[: len(hashes)] > 0
        counts = index.owner_at[window + 1] - index.owner_at[window]
        owner = index.owners[
            np.repeat(index.owner_at[window] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        ]
        t, p, size = np.repeat(text, counts), np.repeat(place, counts), np.repeat(index.sizes[window], counts)
        longest: dict[int, tuple[int, str, int]] = {}
        if len(t):
            order = np.lexsort((p, size, p - owner[:, 1], owner[:, 0], t))
            t, p, size, item, s = t[order], p[order], size[order], owner[order, 0], owner[order, 1]
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (size[1:] != size[:-1]) | (p[1:] - p[:-1] != 1) | (s[1:] - s[:-1] != 1)
            run = np.flatnonzero(new)
            length = np.diff(np.append(run, len(t))) - 1 + size[run]
            best = np.lexsort((p[run], item[run], -length, t[run]))
            of, where = np.unique(t[run][best], return_index=True)
            for k, b in zip(of.tolist(), best[where].tolist()):
                longest[k] = (int(length[b]), str(index.item_ids[item[run[b]]]), int(p[run[b]] - at[k]))
            pairs = np.unique(np.stack([t, item], 1), axis=0)
        else:
            pairs = np.zeros((0, 2), np.int64)
        of = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
        for k in range(j - i):
            yield (
                int(at[k + 1] - at[k]),
                covered[at[k] : at[k + 1]],
                [str(index.item_ids[x]) for x in pairs[of[k] : of[k + 1], 1]],
                longest.get(k),
            )


def _blocks(bench: DataFrame, block_bytes: int) -> tuple[int, Iterator[pa.Table]]:
    """The number of blocks, and the benchmark a bounded block of whole different items at a time."""
    items = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    return n, (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow() for k in range(n))


def _best(a: dict | None, b: dict | None) -> dict | None:
    """The longer of two matches, of equals that of the least item id, then place."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-x["length"], x["item"], x["place"]))


MATCH = "struct<length:long,item:string,place:long>"


def _pass(frame: DataFrame, shared, first: bool, last: bool) -> DataFrame:
    """One block's matches, joined to those of the blocks before; text and cover go on to the next block."""
    match = pa.struct([("length", pa.int64()), ("item", pa.string()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            rows = dict(zip(batch.schema.names, batch.columns))
            found = list(_shards(shared.value, rows["text"]))
            n_words, covers, items, longest = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            longest = [x and {"length": x[0], "item": x[1], "place": x[2]} for x in longest]
            if not first:
                covers = [
                    c | np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)).astype(bool)
                    for c, b in zip(covers, rows["cover"].to_pylist())
                ]
                items = [sorted({*a, *b}) for a, b in zip(items, rows["items"].to_pylist())]
                longest = [_best(a, b) for a, b in zip(longest, rows["longest"].to_pylist())]
            out = {
                "doc_id": rows["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array([int(c.sum()) for c in covers], pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())),
                "longest": pa.array(longest, match),
            }
            if not last:
                out |= {"text": rows["text"], "cover": pa.array([np.packbits(c).tobytes() for c in covers], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = f"doc_id long, n_words long, n_hit long, items array<string>, longest {MATCH}"
    return frame.transform(tb.bounded).mapInArrow(run, schema if last else schema + ", text string, cover binary")


def find(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, longest struct<length,item,place>) of every document."""
    frame = docs.select("doc_id", "text")
    n, blocks = _blocks(bench, block_bytes)
    for k, table in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes(table))
        frame = _pass(frame if k == 0 else cut(frame, "decontam"), shared, k == 0, k == n - 1)
    return frame


def decontaminate(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    at = docs.columns.index("text")
    frame = docs
    for k, table in enumerate(_blocks(bench, block_bytes)[1]):
        shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes(table))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tb.tidy(batches):
                clean = [not items for _, _, items, _ in _shards(shared.value, batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        frame = (frame if k == 0 else cut(frame, "decontam")).transform(tb.bounded).mapInArrow(run, docs.schema)
    return frame


def op4(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return find(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.length", F.lit(0)).cast("long").alias("longest"),
        F.col("longest.item").alias("longest_item"),
        F.col("longest.place").alias("longest_at"),
    )
