"""Ranked search over impact-ordered postings, score at a time.

A query's score of a document sums, over the query's terms, an integer impact:
``w * ((10**9 * tf) div (1000 * tf + 12 * m))``, with ``w`` of the term's
document frequency and ``m`` of the document's length (``impacts``).

Three passes, each over all documents:

1. Every text gives its length and how often it holds each of the queries'
   terms; this is written once and read by what follows.
2. The corpus counts (documents, terms, document frequencies) are aggregates.
3. Documents are taken as shards of about ``SHARD_POSTINGS`` postings.  A shard's
   postings lie by term, in descending impact, equal impacts together as one
   group.  For each query the groups of all its terms are taken in descending
   contribution and added to the documents' scores.  What a term may still add is
   the contribution of its next group, so after every step the sum of these
   bounds what any document may still gain.  A query stops when no document but
   the few that are left (``CANDIDATES``) can reach its k-th score any more; the
   scores of those are then completed from the documents' own term counts.  If
   the bounds never prove that, all its groups are taken.

A frequent term's postings are spread over all shards, so no task holds a term
whole.  A task keeps a query's best k over its shards, which also raises the bar
for later ones, and the best of all tasks meet in a window that keeps k before
the shuffle.

Queries go in blocks of about ``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items
(what is broadcast has this bound); a further block is a further pass.  A
document's word is taken for a query's term if their 64-bit hashes agree.

Edge cases: null text has no terms; a query without terms, or without a
document of a score above 0, gives no rows; rows of equal id and text are one
query, rows that share only an id are ranked one by one; a null document id
sorts before others; repeated rows are documents of their own; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import textbytes as tb
from granary.llm.decontam import word_hashes
from granary.llm.scratch import cut

TOP = 20
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 10_000
SLICE_BYTES = 2 << 20
SHARD_POSTINGS = 1 << 20
CANDIDATES = 200
STEPS = 16
NULL_ID = np.iinfo(np.int64).min


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo[i] to hi[i] - 1, one range after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Queries:
    """The terms of one block of queries."""

    def __init__(self, items: pa.Table):
        column = items.column(1).combine_chunks() if items.num_rows else pa.array([], pa.string())
        self.ids = items.column(0).combine_chunks() if items.num_rows else items.column(0)
        data, offsets = tb.flat(column)
        hashes, at = word_hashes(column, 0, len(column), data, offsets)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        # distinct terms of each query, with how often it has them
        key, self.repeats = np.unique(np.repeat(np.arange(len(column)), np.diff(at)) * max(len(self.vocabulary), 1) + numbers, return_counts=True)
        self.terms = key % max(len(self.vocabulary), 1)
        self.at = np.searchsorted(key, np.arange(len(column) + 1) * max(len(self.vocabulary), 1))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbered(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words that are terms, their term numbers)."""
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        k = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[k] == hashes[maybe]
        return maybe[same], k[same]


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _count(shared):
    """Per document with a term: (id, terms with repeats, numbers of the queries' terms in it, how often each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            queries, column = shared.value, batch.column(1)
            data, offsets = tb.flat(column)
            for i, j in tb.slices(offsets, SLICE_BYTES):
                hashes, at = word_hashes(column, i, j, data, offsets)
                word, term = queries.numbered(hashes)
                text = np.searchsorted(at, word, side="right") - 1
                size = max(len(queries.vocabulary), 1)
                key, tf = np.unique(text * size + term, return_counts=True)
                kept = np.flatnonzero(np.diff(at) > 0)
                cuts = np.append(np.searchsorted(key, kept * size), len(key))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(kept)), pa.array(np.diff(at)[kept], pa.int64()), _lists(cuts, key % size, pa.int32()), _lists(cuts, tf, pa.int64())],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of each weight adds to a document of ``n`` terms that holds it ``tf`` times; all in 64-bit integers."""
    m = 100 - 25 + (25 * n * documents) // length
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Impact-ordered postings of some documents, and the same by document."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.ids, self.doc_at, self.doc_terms = ids, at, terms
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        self.doc_impacts = impacts(weights[terms], tf, n[doc], documents, length)
        order = np.lexsort((doc, -self.doc_impacts, terms))
        order = order[self.doc_impacts[order] > 0]
        self.docs, self.impacts, by = doc[order], self.doc_impacts[order], terms[order]
        new = np.ones(len(order), dtype=bool)  # groups of equal term and impact
        new[1:] = (by[1:] != by[:-1]) | (self.impacts[1:] != self.impacts[:-1])
        first = np.flatnonzero(new)
        self.group_at = np.append(first, len(order))
        self.group_impact = self.impacts[first]
        self.term_groups = np.searchsorted(by[first], np.arange(len(weights) + 1))
        self._asked = np.zeros(len(weights), np.int64)

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, bar: int, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the ``k`` best and score ``bar`` or more; whole scores."""
        scores = np.zeros(len(self.ids), np.int64)
        lo, hi = self.term_groups[terms], self.term_groups[terms + 1]
        group = ranges(lo, hi)
        of = np.repeat(np.arange(len(terms)), hi - lo)
        adds = self.group_impact[group] * repeats[of]
        order = np.argsort(-adds, kind="stable")
        group, of, adds = group[order], of[order], adds[order]
        sizes = self.group_at[group + 1] - self.group_at[group]
        done = np.cumsum(sizes)
        ends = np.unique(np.searchsorted(done, np.linspace(0, done[-1] if len(done) else 0, STEPS + 1)[1:])) + 1
        taken, begin, rest = np.zeros(len(terms), np.int64), 0, 0
        for end in np.minimum(ends, len(group)).tolist():
            g = group[begin:end]
            posting = ranges(self.group_at[g], self.group_at[g + 1])
            np.add.at(scores, self.docs[posting], np.repeat(adds[begin:end], sizes[begin:end]))
            taken += np.bincount(of[begin:end], minlength=len(terms))
            begin = end
            left = np.flatnonzero(lo + taken < hi)
            rest = int((self.group_impact[(lo + taken)[left]] * repeats[left]).sum())
            if len(scores) > k:
                bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if rest and np.count_nonzero(scores + rest >= bar) <= most:
                break
        found = np.flatnonzero(scores + rest >= max(bar, 1))
        if rest and len(found):  # proved early: complete the scores of those left
            self._asked[terms] = repeats
            posting = ranges(self.doc_at[found], self.doc_at[found + 1])
            counts = self.doc_at[found + 1] - self.doc_at[found]
            whole = np.zeros(len(found), np.int64)
            np.add.at(whole, np.repeat(np.arange(len(found)), counts), self._asked[self.doc_terms[posting]] * self.doc_impacts[posting])
            self._asked[terms] = 0
        else:
            whole = scores[found]
        kept = whole >= max(bar, 1)
        return found[kept], whole[kept]


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _rank(shared, k: int):
    """The best ``k`` documents of a task's shards for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, length = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(queries.at) - 1)]
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            ids, n, counts, terms, tf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            shard = Shard(ids, n, np.append(0, np.cumsum(counts)), terms, tf, weights, documents, length)
            for q, (own, score) in enumerate(best):
                a, b = queries.at[q], queries.at[q + 1]
                bar = int(score[-1]) if len(score) == k else 1
                doc, whole = shard.best(queries.terms[a:b], queries.repeats[a:b], k, bar)
                if len(doc):
                    best[q] = _top(np.append(own, shard.ids[doc]), np.append(score, whole), k)

        postings = 0
        for batch in tb.tidy(batches):
            terms, tf = batch.column(2), batch.column(3)
            ids = batch.column(0).cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            held.append((ids.copy(), np.array(batch.column(1)), np.array(terms.value_lengths()).astype(np.int64), np.array(terms.flatten()).astype(np.int64), np.array(tf.flatten())))
            postings += len(held[-1][3])
            if postings >= SHARD_POSTINGS:
                settle()
                postings = 0
        if held:
            settle()
        for q, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q), pa.int64()), queries.ids.take(pa.array(np.full(len(ids), q))), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(scores, pa.int64())],
                    names=["query", "item_id", "doc_id", "score"],
                )

    return run


def _blocks(items: DataFrame, block_bytes: int, block_items: int) -> Iterator[pa.Table]:
    """The queries, a bounded block of whole different ones at a time."""
    own = items.select("item_id", F.col("text").cast("string").alias("t")).distinct()
    total, count = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-int(total) // block_bytes), -(-int(count) // block_items))
    for b in range(n):
        yield own.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "t"), F.lit(n)) == b).toArrow()


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query, equal scores by ascending doc_id."""
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(tb.bounded)
    for table in _blocks(items, block_bytes, block_items):
        queries = Queries(table)
        counts = cut(texts.mapInArrow(_count(spark.sparkContext.broadcast(queries)), "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")
        documents, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(queries.vocabulary), np.int64)
        df[np.array(found.column(0)).astype(np.int64)] = np.array(found.column(1))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        shared = spark.sparkContext.broadcast((queries, weights, int(documents), int(length)))
        best = counts.where(F.size("terms") > 0).mapInArrow(_rank(shared, k), f"query long, item_id {kind}, doc_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))))
        ranked = ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)
