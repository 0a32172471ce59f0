"""Removal of repeated passages by collection Burrows-Wheeler transforms.

A passage is repeated if a string of ``LENGTH`` bytes in it also starts
anywhere else.  Every such string (window) has an anchor: the ``K``-byte
substring with the least hash, the leftmost of equals.  Equal windows have equal
anchors, so windows of one anchor that follow on each other in a text form a
record (at most ``LENGTH + W - 1`` bytes), and repeats are found among the
records of each anchor:

1. Anchors that occur once in the corpus are dropped (a distributed count).
2. Equal records are collapsed before they are sent on; a record found more than
   once goes on as two copies, so that its windows meet in the order like all
   others.
3. The records of an anchor go together to one task, which builds the
   (positional) Burrows-Wheeler transform of a collection of whole anchor groups
   column by column: each round inserts one symbol of every record and updates
   the transform, the order and the common prefixes, held in external files of the
   shared folder that are read and written in sequence.  A window with a common
   prefix of ``LENGTH`` with a neighbour in the order of its column is a repeat.
   Nothing else makes a repeat.
4. An anchor of more than ``GROUP`` different records (a common line amid ever
   different text) is cut in two by the place of the anchor in the window, and each half is keyed
   by the bytes that all its windows share; this goes on until every group is
   small enough for one task.  After eight halvings a group's windows are equal,
   so it ends.  All groups go through step 3.

Records and groups are keyed by 64-bit hashes: two different records are taken
for one only if both their anchors' and their contents' hashes agree.

Edge cases: null text is empty; texts under ``LENGTH`` bytes keep all; matches
never cross texts; repeated rows are copies of each other; a text of any length
is cut into overlapping parts for the search only; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import textbytes as tb
from granary.llm.runs import runs
from granary.llm.scratch import cut, files
from granary.llm.shared_files import opened

LENGTH = 200
K = 64
W = LENGTH - K + 1
PART = 1 << 20
CHUNK = 8 << 20
GROUP = 20_000
BROADCAST_ROWS = 1_000_000
POSITION = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` values on end."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def records(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window in the text, windows, anchor, content hash, anchor's place) of all records of the texts."""
    prefix = tb.prefix_hashes(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    at = np.arange(n - K + 1)
    kmers = tb.span_hashes(prefix, at, at + K)
    least = sliding_min((kmers & ~POSITION) | at.astype(np.uint64), W)
    anchor = (least & POSITION).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(offsets, start, side="right") - 1
    whole = start + LENGTH <= offsets[text + 1]
    start, anchor, text = start[whole], anchor[whole], text[whole]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    a = start[first]
    content = tb.span_hashes(prefix, a, a + windows + LENGTH - 1)
    return text[first], a - offsets[text[first]], windows, kmers[anchor[first]].view(np.int64), content.view(np.int64), anchor[first] - a


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(texts' offsets in ``data``, first text, added to window numbers); a very long text in overlapping parts."""
    for i, j in tb.slices(offsets, PART):
        if offsets[j] - offsets[i] <= 4 * PART:
            yield offsets[i : j + 1], i, 0
        else:  # one text
            for a in range(int(offsets[i]), int(offsets[j]) - LENGTH + 1, PART):
                yield np.array([a, min(a + PART + LENGTH - 1, int(offsets[j]))]), i, a - int(offsets[i])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(0))
        for o, _, _ in _parts(data, offsets):
            anchor = records(data[o[0] : o[-1]], o - o[0])[3]
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64())], names=["anchor"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(2))
        for o, i, shift in _parts(data, offsets):
            text, a, windows, anchor, content, place = records(data[o[0] : o[-1]], o - o[0])
            who = pa.array(text + i)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(who),
                    batch.column(1).take(who),
                    pa.array(a + shift, pa.int64()),
                    pa.array(windows, pa.int32()),
                    pa.array(anchor, pa.int64()),
                    pa.array(content, pa.int64()),
                    pa.array(place, pa.int32()),
                ],
                names=["doc_id", "th", "a", "windows", "anchor", "content", "place"],
            )


class ExternalColumns:
    """Files of one collection in ``folder``: the transform, column after column, and the order of the suffixes and
    their common prefixes, of which every round reads the files of the last round in sequence and writes new ones."""

    kinds = {"order": np.int32, "prefixes": np.uint8}

    def __init__(self, folder: str) -> None:
        self.fs, path = opened(folder)
        self.folder, self.turn = f"{path}/bwt-{uuid.uuid4().hex}", 0
        self.fs.create_dir(self.folder, recursive=True)
        self.transform = self.fs.open_output_stream(f"{self.folder}/transform")

    def _name(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.turn}"

    def write(self, symbols: np.ndarray, *columns: np.ndarray) -> None:
        """Add a column of the transform; write the order and the prefixes of this round."""
        self.transform.write(np.ascontiguousarray(symbols))
        self.turn += 1
        for kind, column in zip(self.kinds, columns):
            with self.fs.open_output_stream(self._name(kind)) as file:
                file.write(np.ascontiguousarray(column))

    def read(self) -> list[np.ndarray]:
        """The order and the prefixes of the last round, whose files go (none is ever written over)."""
        out = []
        for kind, dtype in self.kinds.items():
            with self.fs.open_input_stream(self._name(kind)) as file:
                out.append(np.frombuffer(file.read(), dtype))
            self.fs.delete_file(self._name(kind))
        return out

    def close(self) -> None:
        self.transform.close()
        self.fs.delete_dir(self.folder)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) of each range (none empty), the ranges of each symbol ascending and disjoint.

    ``reduceat`` also runs over what lies between one range and the next unless
    that is not ahead of it, so the ranges go from the last to the first.
    """
    if not len(lo):
        return np.zeros(0, np.uint8)
    ends = np.stack([lo[::-1], hi[::-1]], 1).ravel()
    return np.minimum.reduceat(np.append(values, np.uint8(0)), ends)[::2][::-1]


def repeats(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, folder: str) -> np.ndarray:
    """For each byte of the records: whether a window that starts there stands elsewhere among them too.

    The records stand aligned by their anchors (``anchors``: its place in each),
    for equal windows have theirs at the same place.  So the transform is
    positional: round by round, from the last column to the first, one symbol of
    every record is put before its suffix, and the suffixes that start in the
    new column are in the stable order of their new symbols.  The common prefix
    of neighbours is one more than the least common prefix between their places
    in the order before.  A record comes in with its last column and goes after
    its first.
    """
    sizes = np.diff(offsets)
    out = np.zeros(len(data), dtype=bool)
    if not len(sizes):
        return out
    used = np.flatnonzero(np.bincount(data, minlength=256))
    rank = np.zeros(256, np.uint8)  # UTF-8 leaves 13 byte values unused, so 0 is free
    rank[used] = np.arange(1, len(used) + 1)
    symbols = rank[data]
    column = offsets[:-1] + anchors
    right, left = sizes - anchors, -anchors
    by_end = np.argsort(-right, kind="stable").astype(np.int32)
    ends = -right[by_end]
    columns = ExternalColumns(folder)
    try:
        columns.write(np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint8))
        come = 0
        for j in range(int(right.max()) - 1, int(left.min()) - 1, -1):
            order, common = columns.read()
            until = int(np.searchsorted(ends, -j, side="left"))  # those that end right after column j
            if until > come:
                order = np.concatenate([by_end[come:until], order])
                common = np.concatenate([np.zeros(until - come, np.uint8), common])
                come = until
            place = column[order] + j
            symbol = np.where(left[order] <= j, symbols[np.maximum(place, 0)], 0).astype(np.uint8)
            moved = np.argsort(symbol, kind="stable")
            gone = len(symbol) - int(np.count_nonzero(symbol))
            p = moved[gone:]
            c = symbol[p]
            same = np.zeros(len(p), dtype=bool)
            same[1:] = c[1:] == c[:-1]
            at = np.flatnonzero(same)
            now = np.zeros(len(p), np.uint8)
            now[at] = np.minimum(_least(common, p[at - 1] + 1, p[at] + 1), LENGTH - 1) + 1
            order = order[p]
            columns.write(symbol, order, now)
            start = anchors[order] + j
            window = sizes[order] - start >= LENGTH
            shared = np.maximum(now, np.append(now[1:], np.uint8(0))) >= LENGTH
            out[(offsets[order] + start)[window]] = shared[window]
    finally:
        columns.close()
    return out


def _transformed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The windows repeated of records (key, ckey, n, place, bytes), sorted by key, in chunks of whole groups."""

    def done(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        key, ckey, n, place, raw = (table.column(k).combine_chunks() for k in range(5))
        own = np.arange(len(raw))
        copies = np.flatnonzero(np.asarray(n) > 1)
        who = np.concatenate([own, copies])
        data, offsets = tb.raw(raw.cast(pa.large_binary()).take(pa.array(who)))
        again = repeats(data, offsets, np.asarray(place).astype(np.int64)[who], folder)
        masks = []
        for a, b in zip(offsets[: len(own)].tolist(), offsets[1 : len(own) + 1].tolist()):
            mask = again[a : b - LENGTH + 1]
            masks.append(np.packbits(mask).tobytes() if mask.any() else None)
        masks = pa.array(masks, pa.binary())
        has = masks.is_valid()
        return pa.RecordBatch.from_arrays([key.filter(has), ckey.filter(has), masks.filter(has)], names=["key", "ckey", "mask"])

    held, size = [], 0
    for run in runs(batches, 1):
        held.append(run)
        size += run.column("bytes").nbytes
        if size >= CHUNK:
            yield done(held)
            held, size = [], 0
    if held:
        yield done(held)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, n, place, bytes) of texts with their lists of records."""
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(0))
        lists = batch.column(1)
        flat = lists.flatten()
        of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        a = np.asarray(flat.field("a")) + offsets[of]
        b = a + np.asarray(flat.field("windows")) + LENGTH - 1
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [flat.field(x) for x in ("anchor", "content", "n", "place")] + [pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary())],
            names=["anchor", "content", "n", "place", "bytes"],
        )


PIECE = "anchor long, content long, first int, key long, ckey long, lo int, hi int, n long, place int, bytes binary"


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each piece whose anchor stands in the first and in the second half of its range of places.

    All windows of a half hold the bytes from ``l`` before the anchor to ``LENGTH - h`` after its start.
    """
    for batch in tb.tidy(batches):
        rows = []
        for r in batch.to_pylist():
            mid = (r["lo"] + r["hi"]) // 2
            x, place = r["bytes"], r["place"]
            for l, h in ((r["lo"], mid), (mid + 1, r["hi"])):  # noqa: E741
                w1, w2 = max(0, place - h), min(len(x) - LENGTH, place - l)
                if w1 <= w2:
                    own = x[w1 : w2 + LENGTH]
                    shared = x[place - l : place + LENGTH - h]
                    key = _hash(r["key"].to_bytes(8, "little", signed=True), bytes([l]), shared)
                    rows.append(r | {"first": r["first"] + w1, "key": key, "ckey": _hash(own), "lo": l, "hi": h, "place": place - w1, "bytes": own})
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _whole(masks: DataFrame) -> DataFrame:
    """(anchor, content, mask) of records whose windows' masks came in pieces (at most W of a record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            out = []
            for parts in batch.column(2).to_pylist():
                bits = np.zeros(W + 8, np.uint8)
                for x in parts:
                    own = np.unpackbits(np.frombuffer(x["mask"], np.uint8))
                    bits[x["first"] : x["first"] + len(own)] |= own[: len(bits) - x["first"]]
                out.append(np.packbits(bits[:W]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["anchor", "content", "mask"])

    return (
        masks.groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "mask")).alias("parts"))
        .transform(tb.bounded).mapInArrow(run, "anchor long, content long, mask binary")
    )


def _groups(parts: DataFrame, group: int) -> DataFrame | None:
    """The records in groups of at most ``group`` different ones (``PIECE``); None if the anchors are such groups."""

    def hot(sizes: DataFrame) -> DataFrame | None:
        found = cut(sizes.where(F.col("d") > group).select(F.col("key").alias("hot")), "hot")
        return None if found.isEmpty() else F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    many = hot(parts.groupBy(F.col("anchor").alias("key")).agg(F.count(F.lit(1)).alias("d")))
    if many is None:
        return None
    pieces = parts.select(
        "anchor", "content", F.lit(0).alias("first"), F.col("anchor").alias("key"), F.col("content").alias("ckey"),
        F.lit(0).alias("lo"), F.lit(W - 1).alias("hi"), "n", "place", "bytes",
    )
    while many is not None:
        same = F.col("key") == F.col("hot")
        halves = pieces.join(many, same, "left_semi").transform(tb.bounded).mapInArrow(_halved, PIECE)
        pieces = cut(pieces.join(many, same, "left_anti").unionByName(halves), "pieces")
        many = hot(pieces.select("key", "ckey").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("d")))
    return pieces


def _marked(records: DataFrame) -> DataFrame:
    """(key, ckey, mask) of records (key, ckey, n, place, bytes)."""
    folder = files(records.sparkSession, "bwt")
    return (
        records.repartition("key").sortWithinPartitions("key")
        .transform(tb.bounded).mapInArrow(lambda batches: _transformed(batches, folder), "key long, ckey long, mask binary")
    )


def _near(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, th) may be in ``wanted``: by a broadcast if that is small, else all."""
    ids = cut(wanted.select(F.col("th").alias("__th")).distinct(), "ids")
    if ids.count() > BROADCAST_ROWS:
        return docs
    return docs.join(F.broadcast(ids), F.col("th") == F.col("__th"), "left_semi")


def repeated_windows(docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``docs`` keyed (doc_id, th, text) and, for each text with repeats, its (a, mask) list of windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    long = keyed.where(F.octet_length("text") >= LENGTH)
    often = (
        long.select("text").transform(tb.bounded).mapInArrow(_anchors, "anchor long")
        .groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    )
    schema = "doc_id long, th long, a long, windows int, anchor long, content long, place int"
    # written first: a join of plain exchanges is one whose large partitions can be split
    often = cut(often, "often")
    found = cut(long.transform(tb.bounded).mapInArrow(_records, schema).join(often, "anchor"), "records")
    different = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("windows").alias("windows"), F.any_value("place").alias("place"), F.min(F.struct("doc_id", "th", "a")).alias("at")
    )
    wanted = cut(
        different.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"))
        .agg(F.collect_list(F.struct(F.col("at.a").alias("a"), "windows", "anchor", "content", "place", "n")).alias("list")),
        "wanted",
    )
    some = (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("th") == F.col("__th"))
    listed = wanted.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "list")
    parts = cut(
        _near(long, wanted).dropDuplicates(["doc_id", "th"]).join(listed, some)
        .select("text", "list")
        .transform(tb.bounded).mapInArrow(_sliced, "anchor long, content long, n long, place int, bytes binary"),
        "parts",
    )
    pieces = _groups(parts, group)
    if pieces is None:
        masks = _marked(parts.select(F.col("anchor").alias("key"), F.col("content").alias("ckey"), "n", "place", "bytes")).toDF("anchor", "content", "mask")
    else:
        records = pieces.groupBy("key", "ckey").agg(
            F.sum("n").alias("n"), F.any_value("place").alias("place"), F.any_value("bytes").alias("bytes")
        )
        masks = _whole(pieces.select("anchor", "content", "first", "key", "ckey").join(_marked(records), ["key", "ckey"]))
    # rows equal in all three are repeated documents, which share their spans
    hits = found.join(masks, ["anchor", "content"]).groupBy("doc_id", "th", "a").agg(
        F.any_value("windows").alias("windows"), F.any_value("mask").alias("mask")
    )
    hits = hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "windows", "mask")).alias("hits"))
    return keyed, cut(hits, "hits")


def _covered(size: int, hits: list[dict]) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes lie in repeated windows."""
    step = np.zeros(size + 1, np.int64)
    for hit in hits:
        bits = np.unpackbits(np.frombuffer(hit["mask"], np.uint8), count=hit["windows"]).astype(bool)
        starts = hit["a"] + np.flatnonzero(bits)
        step[starts] += 1
        step[starts + LENGTH] -= 1
    return np.cumsum(step[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, removed spans, remaining bytes) of texts with repeats."""
    for batch in tb.tidy(batches):
        data, offsets = tb.flat(batch.column(1))
        spans, kept = [], []
        for k, hits in enumerate(batch.column(2).to_pylist()):
            own = data[offsets[k] : offsets[k + 1]]
            gone = _covered(len(own), hits)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"s": int(a), "e": int(b)} for a, b in edges.reshape(-1, 2)])
            kept.append(own[~gone].tobytes())
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s,e>>, kept binary) of every document."""
    keyed, hits = repeated_windows(docs, group)
    other = hits.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    schema = "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary"
    changed = _near(keyed, hits).join(other, same).select("doc_id", "text", "hits").transform(tb.bounded).mapInArrow(_removed, schema)
    ids = cut(hits.select("doc_id", "th"), "changed")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    own = keyed.join(side.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), same, "left_anti")
    whole = own.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return changed.unionByName(whole)


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
