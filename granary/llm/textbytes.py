"""Texts of an Arrow batch as one run of UTF-8 bytes, worked on by numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: separators of words "[^\x20\x09-\x0D]+"
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: text in one Arrow batch; Spark's own bound would hold 10,000 texts of any length
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(frame: DataFrame) -> DataFrame:
    """``frame``, whose session sends Arrow batches of about ``BATCH_BYTES`` unless it was told a size."""
    conf = frame.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return frame


#: gives freed memory back to the system, where the C library can
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, memory no longer used goes back, for idle Python workers stay and add up."""
    pa.set_memory_pool(pa.system_memory_pool())  # what it frees, the C library can give back
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return raw(pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary()))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a large binary array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes each; a longer text comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def pieces(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The binary array whose items are data[bounds[i]:bounds[i + 1]], without a copy."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]
    )


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the index of its first word (with the total at the end)."""
    word = ~separator[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    before &= ~edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = _R_INV if inverse else _R
        size = max(n, 1 << 20)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if size > (1 << 21) + 1024:  # a very long text: not kept
            return out[:n]
        _powers[key] = have = out
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of ``values`` (any unsigned integers), one longer than they are."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal contents wherever they stand."""
    inv = powers(len(prefix), inverse=True)
    return mixed((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
