"""Folds over the rows of each key in order: rows stream through tasks sorted, a key's state is a few values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

FLUSH = 10_000


class Machine(Protocol):
    """The state of one key."""

    def take(self, *row) -> list[tuple]:
        """What one more row makes come out."""

    def close(self) -> list[tuple]:
        """What comes out at the end of the key's rows."""


def folded(rows: DataFrame, key: str, order: list[Column], fields: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """(key, schema): what a machine of its own makes of each key's rows (``fields``) in ``order``.

    Each key's rows go through one task as a sorted stream that spills; no
    array of them is made.  Null keys are a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    full = rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}").schema
    types, names = [to_arrow_type(f.dataType) for f in full], full.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, *row in zip(*columns):
                if held is None or k != now:
                    if held is not None:
                        out += [(now, *x) for x in held.close()]
                    now, held = k, machine()
                out += [(k, *x) for x in held.take(*row)]
            if len(out) >= FLUSH:
                yield flushed()
        if held is not None:
            out += [(now, *x) for x in held.close()]
        if out:
            yield flushed()

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, *fields).mapInArrow(run, full)
