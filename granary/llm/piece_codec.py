"""SentencePiece encoding and decoding by a table of distinct chunks.

In the normalised text a space is a marker, and no piece of the model has a
marker after another character.  So no piece crosses the start of a run of
markers: the text falls into chunks (a run of markers and what follows), every
distinct chunk is segmented once by the library and stands in a table, and ids
and decoded text are joined back by position.  ``Codec`` refuses a model for
which that does not hold.

Each Python worker keeps one table for all its texts, as a few Arrow arrays of
at most ``TABLE_CHUNKS`` chunks and about ``TABLE_BYTES``.  A table that would
grow beyond that is begun anew with the chunks at hand.  So a rare chunk may be
segmented again, but never differently.

A chunk whose pieces spell it out (no unknown character, no byte pieces) decodes
to itself; all others are decoded by the library.

Edge cases: null and empty texts have no ids and decode to an empty text; a
chunk may be a whole very long text; repeated rows are treated alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.llm import textbytes as tb

MARK = "▁"
SLICE_BYTES = 1 << 20
TABLE_CHUNKS = 1 << 17
TABLE_BYTES = 8 << 20
PORTION = 1 << 12


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.lib.get_piece_size()):
            if MARK in self.lib.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a marker: distinct chunks would not be exact")
        if self.lib.decode(self.lib.encode("a  b")) != "a  b":
            raise ValueError("the model does not keep white space: distinct chunks would not be exact")
        self.lone_mark = [self.lib.piece_to_id(MARK)]
        size = self.lib.get_piece_size()
        self.number = [str(i) for i in range(size)]
        plain = lambda i: not (self.lib.is_unknown(i) or self.lib.is_control(i) or self.lib.is_byte(i) or self.lib.is_unused(i))
        self.piece = [self.lib.id_to_piece(i) if plain(i) else "\0" for i in range(size)]  # no chunk is spelled with a zero there
        self._empty()

    def _empty(self) -> None:
        #: the chunks; their ids in decimal, each after a comma; a space and the text they decode to; number of ids
        self.known = pa.array([], pa.large_string())
        self.ids, self.texts = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        self.sizes = np.zeros(0, np.int64)

    def _segmented(self, column: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        number, piece = self.number, self.piece
        written, texts, sizes = [], [], []
        for k in range(0, len(column), PORTION):
            chunks = column[k : k + PORTION].to_pylist()
            ids = self.lib.encode(chunks, num_threads=1)
            if "" in chunks:
                ids[chunks.index("")] = self.lone_mark
            own: list[str | None] = []
            for c, x in zip(chunks, ids):
                spelled = "".join([piece[i] for i in x])
                own.append(c if spelled[:1] == MARK and spelled[1:].replace(MARK, " ") == c else None)
                written.append("".join(["," + number[i] for i in x]).encode())
                sizes.append(len(x))
            other = [i for i, t in enumerate(own) if t is None]
            for i, t in zip(other, self.lib.decode([ids[i] for i in other], num_threads=1) if other else []):
                own[i] = t
            texts += [(" " + t).encode() for t in own]
        return pa.array(written, pa.large_binary()), pa.array(texts, pa.large_binary()), np.array(sizes, np.int64)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """The place in the table of each chunk (all of them different)."""
        place = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) + len(new) > TABLE_CHUNKS or self.ids.nbytes + self.texts.nbytes > TABLE_BYTES:
                held = np.flatnonzero(place >= 0)
                at = pa.array(place[held])
                self.known, self.ids, self.texts = self.known.take(at), self.ids.take(at), self.texts.take(at)
                self.sizes = self.sizes[place[held]]
                place[held] = np.arange(len(held))
            place[new] = len(self.known) + np.arange(len(new))
            column = chunks.take(pa.array(new))
            ids, texts, sizes = self._segmented(column)
            self.known = pa.concat_arrays([self.known, column])
            self.ids, self.texts = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.texts, texts])
            self.sizes = np.concatenate([self.sizes, sizes])
        return place

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the texts' chunks in order as places in the table, each text's first chunk).

        The marker that a chunk begins with is left out: the library sets one
        before whatever it encodes.
        """
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        space = data == 0x20
        later = space.copy()
        later[1:] &= ~space[:-1]
        later &= ~first[:n]
        # the space of a later chunk is the marker left out
        kept = data[~later]
        starts = np.flatnonzero(later | first[:n])
        bounds = np.append(starts - (np.cumsum(later[starts]) - later[starts]), len(kept))
        codes = tb.pieces(kept, bounds).dictionary_encode()
        place = self.places(codes.dictionary.cast(pa.large_string()))
        return place[np.asarray(codes.indices)], np.searchsorted(starts, offsets)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _plain(column: pa.Array) -> pa.Array:
    """A mark in the text itself stands for a space, as it does for the library."""
    column = pc.fill_null(column, "")
    return pc.replace_substring(column, MARK, " ") if pc.any(pc.match_substring(column, MARK)).as_py() else column


def _joined(column: pa.Array, places: pa.Array, at: np.ndarray) -> list[memoryview]:
    """The taken values of each text in one, without the sign that begins it."""
    data, offsets = tb.raw(column.take(places))
    view, ends = memoryview(data), offsets[at].tolist()
    return [view[a + 1 : b] for a, b in zip(ends[:-1], ends[1:])]


def _texts(c: Codec, column: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
    """(number of ids, ids in decimal joined by commas, decoded UTF-8) of each text."""
    data, offsets = tb.flat(_plain(column))
    for i, j in tb.slices(offsets, SLICE_BYTES):
        part = offsets[i : j + 1]
        codes, at = c.chunks(data[part[0] : part[-1]], part - part[0])
        places = pa.array(codes)
        sizes = np.concatenate([[0], np.cumsum(c.sizes[codes])])[at]
        yield from zip(np.diff(sizes).tolist(), _joined(c.ids, places, at), _joined(c.texts, places, at))


def _ids(written: memoryview) -> np.ndarray:
    return np.fromstring(bytes(written).decode(), np.int32, sep=",") if len(written) else np.zeros(0, np.int32)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in tb.tidy(batches):
            ids, texts = [], []
            for _, written, decoded in _texts(c, batch.column(1)):
                ids.append(_ids(written))
                texts.append(bytes(decoded).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").transform(tb.bounded).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` without handing the ids to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in tb.tidy(batches):
            n_tokens, id_digests, text_digests = [], [], []
            for n, written, decoded in _texts(c, batch.column(1)):
                n_tokens.append(n)
                id_digests.append(hashlib.sha256(written).hexdigest())
                text_digests.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").transform(tb.bounded).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(docs: DataFrame) -> DataFrame:
    return digests(docs, model_path())
