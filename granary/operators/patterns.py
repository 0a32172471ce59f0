"""Which patterns of a table each text of another holds: one pass over the texts for a block of patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes and number of patterns in a block: what is broadcast has this bound
BLOCK_BYTES = 4 << 20
BLOCK_PATTERNS = 100_000
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """The block's automaton, built once in a worker; only the last one is kept."""
    if shared.value[0] not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for pattern in shared.value[1]:
            made.add_word(pattern, pattern)
        made.make_automaton()
        _built[shared.value[0]] = made
    return _built[shared.value[0]]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                own = {pattern for _, pattern in automaton.iter(text.as_py())}
                rows += [k] * len(own)
                found += own
            kept = batch.take(pa.array(rows, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*batch.schema.names[:-1], "pattern"])

    return run


def _blocks(patterns: DataFrame) -> Iterator[list[str]]:
    """Bounded blocks of the different patterns, none empty."""
    total, count = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-int(total) // BLOCK_BYTES), -(-int(count) // BLOCK_PATTERNS))
    for k in range(n):
        block = [r[0] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k).collect()]
        if block:
            yield block


def held(texts: DataFrame, text: str | Column, patterns: DataFrame, pattern: str = "pattern", any_case: bool = False) -> DataFrame:
    """The other columns of ``texts`` with every different ``pattern`` that the text holds.

    Patterns are found by an Aho-Corasick automaton of a counted block at a
    time, so a text is read once for a block, however many patterns it has.
    ``any_case`` compares lower-cased forms and returns patterns so.  An empty
    pattern lies in every text; null texts and patterns match nothing.
    """
    fold = F.lower if any_case else lambda x: x
    spark, at = texts.sparkSession, texts[text] if isinstance(text, str) else text
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, fold(at).alias("__text")).where("__text IS NOT NULL")
    own = patterns.select(fold(F.col(pattern)).alias("pattern")).where("pattern IS NOT NULL").distinct()
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), "pattern string"])
    out = rows.drop("__text").join(own.where("pattern = ''").hint("broadcast"), how="cross") if not own.where("pattern = ''").isEmpty() else None
    for block in _blocks(own.where("pattern <> ''")):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        found = rows.mapInArrow(_search(shared), kinds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select(*rest, F.lit("").alias("pattern")).limit(0)


def counted(patterns: DataFrame, found: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, n) of every different pattern: the number of rows of ``found`` that have it, 0 for one that none has."""
    hits = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    own = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    return own.join(hits, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))
