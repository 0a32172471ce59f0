"""Vector joins by blocks of matrix products: neighbours of all rows, and search of stated queries.

Vectors are dealt to blocks by a hash.  A join of all rows with all rows takes the
pairs of blocks, each in a task of fixed size, and hands on only what passes the
threshold and is among a row's best of the block.  Products are made tile by tile
in single precision; what may pass is computed anew in double precision.
Zero vectors have a similarity of 0 with all others; nulls are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a block: if all pairs are asked for, if each row's best are, and at least; blocks that there should be
BLOCK, BEST_BLOCK, LEAST_BLOCK, BLOCKS = 2048, 16_384, 1024, 8
DIGITS = 6
TILE = 512


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    x = np.asarray(column.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _margin(d: int) -> float:
    """How far a product of unit vectors in single precision may lie from the rounded one, at most."""
    return 0.6 * 10.0**-DIGITS + (d + 8) * 2.0**-23


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded cosines of the rows of ``x`` with those of ``y`` beside them; the same from both sides."""
    return np.round(np.einsum("ij,ij->i", x, y), DIGITS)


class Held:
    """The ``top`` largest values of each of ``n`` rows that are at least ``least``, ties by id."""

    def __init__(self, n: int, top: int, least: float):
        self.top, self.least = top, least
        self.value = np.full((n, top), -np.inf)
        self.id = np.full((n, top), np.iinfo(np.int64).max)
        self.floor = np.full(n, float(least))

    def merge(self, u: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        """Values of ids for the rows ``u``."""
        good = value >= self.floor[u]
        if not good.any():
            return
        u, ids, value = u[good], ids[good], value[good]
        hit = np.unique(u)
        row, ids = np.append(u, np.repeat(hit, self.top)), np.append(ids, self.id[hit].ravel())
        value = np.append(value, self.value[hit].ravel())
        order = np.lexsort((ids, -value, row))
        row, ids, value = row[order], ids[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.top
        self.value[row[first], place[first]], self.id[row[first], place[first]] = value[first], ids[first]
        self.floor[hit] = np.maximum(self.least, self.value[hit, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, value) of all that is held."""
        row, k = np.nonzero(np.isfinite(self.value))
        return row, self.id[row, k], self.value[row, k]


class Best(Held):
    """The best cosines of each row of ``x``, while tiles of columns pass."""

    def __init__(self, x: np.ndarray, top: int, least: float):
        super().__init__(len(x), top, least)
        self.x, self.margin = x, _margin(x.shape[1])

    def take(self, at: int, s: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        """A tile: products ``s`` (-inf: does not count) of the rows from ``at`` on with ``y``, whose ``ids`` ascend."""
        floor = (self.floor[at : at + len(s)] - self.margin).astype(np.float32)[:, None]
        # read in the order in which it lies in memory
        if s.flags.c_contiguous:
            u, v = np.divmod(np.flatnonzero(s >= floor), s.shape[1])
        else:
            v, u = np.divmod(np.flatnonzero(s.T >= floor.T), s.shape[0])
        if not len(u):
            return
        crowd = np.flatnonzero(np.bincount(u, minlength=len(s)) > max(4 * self.top, 64))
        if len(crowd) and s.shape[1] > self.top:
            exact = np.rint((self.x[at + crowd] @ y.T) * 10.0**DIGITS)
            turn = np.where(np.isfinite(s[crowd]), exact, -1e12).astype(np.int64) * TILE + np.arange(s.shape[1])[::-1]
            chosen = np.argpartition(-turn, self.top - 1, axis=1)[:, : self.top]
            rows = np.repeat(crowd, self.top)
            good = np.isfinite(s[rows, chosen.ravel()])
            few = ~np.isin(u, crowd)
            u, v = np.append(u[few], rows[good]), np.append(v[few], chosen.ravel()[good])
        self.merge(u + at, ids[v], _cosines(self.x[u + at], y[v]))


def _all_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, row of ``y``, cosine) of all that are at least ``least``."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b, s in _tiles(x, y):
        u, v = np.nonzero(s >= np.float32(least - _margin(x.shape[1])))
        value = _cosines(x[a + u], y[b + v])
        good = value >= least
        out.append((a + u[good], b + v[good], value[good]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, products) of the tiles of x y'."""
    single = x.astype(np.float32), y.astype(np.float32)
    for a in range(0, len(x), TILE):
        for b in range(0, len(y), TILE):
            yield a, b, single[0][a : a + TILE] @ single[1][b : b + TILE].T


def alike(vectors: DataFrame, least: float, top: int | None = None, block: int | None = None) -> DataFrame:
    """(x, y, s) for vectors (vec_id, embedding): cosines of different rows of at least ``least``.

    Without ``top`` every pair once, x < y; with it each row's ``top`` best, ties
    by id, so a pair may come from both its ends.  A row goes to as many tasks as there are blocks.
    """
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    most, n = block or (BLOCK if top is None else BEST_BLOCK), rows.count()
    blocks = max(1, -(-n // min(most, max(LEAST_BLOCK, -(-n // BLOCKS)))))
    a = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")),
        lambda b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")),
    )
    dealt = rows.select("vec_id", "embedding", a.alias("a"), F.explode(pair).alias("pair")).select("vec_id", "embedding", "a", "pair.p", "pair.q")

    def run(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        table = table.sort_by("vec_id")
        side = np.asarray(table.column("a"))
        ids, x = np.asarray(table.column("vec_id")), matrix(table.column("embedding"))
        (own, mine), (other, theirs) = ((ids[side == k], x[side == k]) for k in (p, q))
        if top is None:
            u, v, value = _all_pairs(mine, theirs, least)
            left, right = own[u], other[v]
            good = left < right if p == q else np.full(len(u), True)
            left, right, value = np.minimum(left, right)[good], np.maximum(left, right)[good], value[good]
        else:
            best, back = Best(mine, top, least), Best(theirs, top, least)
            for i, j, s in _tiles(mine, theirs):
                columns, lines = slice(j, j + TILE), slice(i, i + TILE)
                if p == q:
                    s[own[lines][:, None] == other[columns][None, :]] = -np.inf
                else:
                    back.take(j, s.T, mine[lines], own[lines])
                best.take(i, s, theirs[columns], other[columns])
            (u, right, value), (v, left, more) = best.rows(), back.rows()
            left, right, value = np.append(own[u], other[v]), np.append(right, left), np.append(value, more)
        return pa.table({"x": pa.array(left, pa.int64()), "y": pa.array(right, pa.int64()), "s": pa.array(value, pa.float64())})

    found = dealt.groupBy("p", "q").applyInArrow(run, "x long, y long, s double")
    if top is None:
        return found
    r = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("s"), "y"))
    return found.withColumn("r", r).where(F.col("r") <= top).drop("r")


def nearest(vectors: DataFrame, queries: DataFrame, top: int, block: int = BEST_BLOCK, group: str | None = None) -> DataFrame:
    """(query, vec_id, cosine, rank): exact search of stated queries (query, vector) against all vectors.

    Queries go a block at a time, which bounds the broadcast; every block is a
    pass over the vectors.  Each task hands on its ``top`` best of a query.
    Vectors of another length than most queries have are of another model and left out.  With ``group``, a column of the
    vectors, a query sees only rows whose group is in its ``allowed`` array (null: all).
    """
    asked = queries.where("vector IS NOT NULL").withColumn("allowed", F.col("allowed") if group else F.lit(None).cast("array<string>")).select("query", "vector", F.col("allowed").cast("array<string>"))
    count, size = asked.agg(F.count(F.lit(1)), F.mode(F.size("vector"))).first()
    asked = asked.where(F.size("vector") == F.lit(size or 0))
    own = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = vectors.where(F.size("embedding") == F.lit(size or 0)).select("vec_id", "embedding", own.alias("group"))
    blocks = max(1, -(-count // block))
    context = vectors.sparkSession.sparkContext
    found = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).toArrow()
        shared = context.broadcast((np.asarray(part.column("query").combine_chunks(), np.int64) if part.num_rows else np.zeros(0, np.int64), matrix(part.column("vector")), part.column("allowed").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query, q, allowed = shared.value
            best = Best(q, top, -2.0)
            kinds = {own: k for k, own in enumerate({tuple(sorted({x for x in own if x is not None})) for own in allowed if own is not None})}
            kind = np.array([-1 if own is None else kinds[tuple(sorted({x for x in own if x is not None}))] for own in allowed], np.int64)
            for batch in batches:
                if not batch.num_rows or not len(query):
                    continue
                batch = batch.sort_by("vec_id")
                ids, x = np.asarray(batch.column(0)), matrix(batch.column(1))
                # the last line is for queries that see all
                seen = np.array([np.asarray(pc.is_in(batch.column(2), pa.array(own, pa.string())).to_numpy(zero_copy_only=False), dtype=bool) for own in kinds] + [np.full(len(ids), True)])
                for i, j, s in _tiles(q, x):
                    if kinds:
                        s[~seen[kind[i : i + TILE], j : j + TILE]] = -np.inf
                    best.take(i, s, x[j : j + TILE], ids[j : j + TILE])
            u, found, value = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(query[u], pa.int64()), pa.array(found, pa.int64()), pa.array(value, pa.float64())], names=["query", "vec_id", "cosine"])

        best = rows.mapInArrow(run, "query long, vec_id long, cosine double")
        found = best if found is None else found.unionByName(best)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
