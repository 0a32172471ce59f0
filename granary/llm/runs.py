"""Runs of equal keys in a sorted stream of Arrow batches.

Edge cases: empty batches are passed over; a run may span any number of batches
and is held whole, so callers bound their groups; no rows give no runs; keys have no nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table for each run of rows equal in the first ``keys`` columns (integers without nulls)."""
    held: list[pa.RecordBatch] = []
    before: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(v[a]) for v in values)
            if held and key != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            before = key
    if held:
        yield pa.Table.from_batches(held)
