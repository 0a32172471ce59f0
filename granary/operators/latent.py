"""Truncated singular value decomposition of weighted terms, and projection of texts.

The row space is found by a randomised power iteration: every pass over the rows
sums a' (a X) by blocks of terms, so no task and no table holds more than the
fixed size of X: terms of the vocabulary times dimensions (60,000 x 272 floats
at most by the parameters).  Only such matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.tables import written

OVERSAMPLE, PASSES, SEED = 16, 2, 42
TERMS_A_BLOCK = 4096


@dataclass
class Latent:
    """Terms, their components (terms x dimensions) and singular values."""

    terms: list[str]
    components: np.ndarray
    singular: np.ndarray


def _rows(weights: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, at, w): each row's terms by place."""
    return weights.join(F.broadcast(places), "term").groupBy(key).agg(F.collect_list(F.struct(F.col("place").alias("at"), F.col("weight").alias("w"))).alias("x")).select(
        key, F.transform("x", lambda s: s["at"]).alias("at"), F.transform("x", lambda s: s["w"]).alias("w")
    )


def _cells(at: pa.ListArray, w: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every cell of a batch."""
    row = np.repeat(np.arange(len(at)), np.diff(np.asarray(at.offsets)))
    return row, np.asarray(at.flatten()), np.asarray(w.flatten()).astype(np.float64)


def _products(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """A' A x over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(shared.value.T)
        total = np.zeros_like(columns)
        for batch in batches:
            row, place, value = _cells(batch.column(0), batch.column(1))
            for own, sums in zip(columns, total):
                sums += np.bincount(place, value * np.bincount(row, value * own[place], batch.num_rows)[row], len(sums))
        for k in range(0, total.shape[1], TERMS_A_BLOCK):
            part = total[:, k : k + TERMS_A_BLOCK].T
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["block", "m"])

    def summed(table: pa.Table) -> pa.Table:
        m = np.sum([np.frombuffer(b, np.float64) for b in table.column("m").to_pylist()], axis=0)
        return pa.table({"block": table.column("block")[:1], "m": pa.array([m.tobytes()], pa.binary())})

    parts = rows.select("at", "w").mapInArrow(run, "block long, m binary")
    # two levels, so that a block of very many partitions is no one task's
    parts = parts.withColumn("deal", F.spark_partition_id() % 64).groupBy("block", "deal").applyInArrow(summed, "block long, m binary")
    out = np.zeros_like(x)
    for block, m in parts.groupBy("block").applyInArrow(summed, "block long, m binary").collect():  # one row for TERMS_A_BLOCK terms
        own = np.frombuffer(bytes(m), np.float64).reshape(-1, x.shape[1])
        out[block : block + len(own)] = own
    return out


def decompose(weights: DataFrame, dims: int = 256, key: str = "doc_id") -> Latent:
    """The largest ``dims`` singular directions of rows (key, term, weight)."""
    vocabulary = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # at most the vocabulary's own bound
    if not vocabulary:
        return Latent([], np.zeros((0, 0)), np.zeros(0))
    return decompose_rows(written(_rows(weights, _places(weights.sparkSession, vocabulary), key)), vocabulary, dims)


def decompose_rows(rows: DataFrame, terms: list[str], dims: int = 256) -> Latent:
    """The same of written rows (key, at, w), whose places count in ``terms``; they are read once a pass, nothing but sums is shuffled."""
    n = rows.count()
    if not terms or not n:
        return Latent([], np.zeros((0, 0)), np.zeros(0))
    dims = max(1, min(dims, len(terms) - 1, n - 1))
    x = np.random.default_rng(SEED).standard_normal((len(terms), min(dims + OVERSAMPLE, len(terms))))
    for _ in range(PASSES + 1):
        x, _ = np.linalg.qr(_products(rows, x))
    values, vectors = np.linalg.eigh(x.T @ _products(rows, x))
    order = np.argsort(-values)[:dims]
    return Latent(terms, x @ vectors[:, order], np.sqrt(np.maximum(values[order], 0)))


def _places(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, place int")


def projected(weights: DataFrame, model: Latent, key: str = "doc_id") -> DataFrame:
    """(key, embedding): rows (key, term, weight) in the model's directions, of length one; unknown terms do not count."""
    return projected_rows(_rows(weights, _places(weights.sparkSession, model.terms), key), model, key)


def projected_rows(rows: DataFrame, model: Latent, key: str = "doc_id") -> DataFrame:
    """The same of rows (key, at, w), whose places count in the model's terms."""
    dims = model.components.shape[1] if len(model.terms) else 0
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.components.T))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, value = _cells(batch.column(1), batch.column(2))
            out = np.zeros((batch.num_rows, dims), np.float32)
            for k, own in enumerate(shared.value[:dims]):
                out[:, k] = np.bincount(row, value * own[place], batch.num_rows)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1)
            offsets = pa.array(np.arange(batch.num_rows + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[key, "embedding"])

    return rows.select(key, "at", "w").mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
