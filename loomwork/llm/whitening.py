"""Embedding whitening by a tiled covariance.

Vectors are taken in fixed point, so that equal ones are equal and sums are exact. The covariance is that of the distinct vectors.
Its dimensions are cut into blocks of ``block``, and a tile is a pair of blocks. Each task cuts its rows, centred, into row blocks and these into
column blocks; a column block travels to the tiles that it is a side of, by tile and a group of row blocks. There the two
sides of a row block meet and are multiplied, products of a group are summed as they come, and groups are summed by tile.
What the driver assembles and decomposes is the matrix, dimensions by dimensions, whatever the number of rows.
The components, a few rows of it, are broadcast.

Centring is exact but for one rounding: the mean's whole part is taken off the whole numbers, then its rest.

Defined results: vectors that are null or hold a null, a NaN, an infinity or an entry whose fixed point is beyond 2**52 are dropped.
A vector shorter than the longest counts as one with zeros behind it. Repeated rows and null ids stay rows of the result; other columns
of any name aren't looked at. Components whose variance is 0 to rounding aren't returned, so that equal vectors, or one, have none; an
empty table gives an empty result. A ``deviation`` beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, drop_saved, saved, ship, worker_udf

#: Dimensions of a tile's side, rows of a row block, and the groups of row blocks that the tiles' work is dealt over.
BLOCK, ROW_BLOCK, GROUPS = 32, 2048, 64


def fixed_point(rows: DataFrame, vector_col: str, into: str = "x", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``rows`` with ``into``: floor(scale * entry) + offset of each entry; rows that have none are dropped."""
    entry = lambda c: c.cast("double")
    valid = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: F.coalesce(F.abs(entry(c)) < float(1 << 52) / scale, F.lit(False)))  # NaN isn't less
    fixed = F.transform(vector_col, lambda c: F.floor(entry(c) * scale) + offset)
    kept = rows.filter(valid)
    longest = kept.agg(F.max(F.size(vector_col))).first()[0] or 0
    return kept.withColumn(into, F.when(F.size(vector_col) < longest, F.concat(fixed, F.array_repeat(F.lit(offset).cast("long"), F.lit(longest) - F.size(vector_col)))).otherwise(fixed))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _sums(table: DataFrame, of: Callable[[pa.ListArray], np.ndarray], kind: str) -> dict[int, float]:
    """Sums by dimension; a task's own come as a row, which Spark adds up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + of(batch.column(0)).sum(axis=0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])

    parts = table.mapInArrow(batches_of(add), f"s array<{kind}>").select(F.posexplode("s").alias("at", "s"))
    return {r["at"]: r["s"] for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect()}  # a row per dimension


def tiled_covariance(table: DataFrame, centred: Callable[[pa.ListArray], np.ndarray], dims: int, n: int, *, block: int = BLOCK, row_block: int = ROW_BLOCK, groups: int = GROUPS) -> np.ndarray:
    """The covariance, divisor ``n``, of the rows of ``table``'s one column, which ``centred`` makes a matrix whose columns have mean 0."""
    blocks = -(-dims // block)

    tiles = [(i, j, side, k) for i in range(blocks) for j in range(i, blocks) for side, k in enumerate((i, j) if i < j else (i,))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # of a row block
        for batch in batches:
            for at in range(0, batch.num_rows, row_block):
                x = centred(batch.column(0).slice(at, row_block))
                sides = [np.ascontiguousarray(x[:, k * block : (k + 1) * block]).tobytes() for k in range(blocks)]
                for a in range(0, len(tiles), 64):  # a batch holds a bounded number of sides
                    some = tiles[a : a + 64]
                    fields = [*(pa.array([t[c] for t in some], pa.int32()) for c in range(3)), pa.array([number] * len(some), pa.int64()), pa.array([len(x)] * len(some), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*fields, pa.array([sides[t[3]] for t in some], pa.binary())], ["i", "j", "side", "at", "rows", "data"])
                number += 1

    def as_rows(data: pa.Scalar, rows: int) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(rows, -1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total, left = None, 0, None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch[c][r].as_py() for c in ("i", "j", "group"))
                if key != tile and tile is not None:
                    yield _tile(*tile, total)
                    total = 0
                tile = key
                x = as_rows(batch["data"][r], batch["rows"][r].as_py())
                if key[0] == key[1]:
                    total = total + x.T @ x
                elif batch["side"][r].as_py() == 0:
                    left = x
                else:
                    total = total + left.T @ x
        if tile is not None:
            yield _tile(*tile, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total = None, 0
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch[c][r].as_py() for c in ("i", "j"))
                if key != tile and tile is not None:
                    yield _tile(*tile, 0, total)
                    total = 0
                tile = key
                total = total + np.frombuffer(batch["data"][r].as_buffer(), dtype=np.float64)
        if tile is not None:
            yield _tile(*tile, 0, total)

    sides = table.mapInArrow(batches_of(cut), "i int, j int, side int, at bigint, rows int, data binary")
    met = sides.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int")).repartition("i", "j", "group").sortWithinPartitions("i", "j", "group", "at", "side")
    partial = met.mapInArrow(batches_of(multiply), "i int, j int, group int, data binary")
    summed = partial.repartition("i", "j").sortWithinPartitions("i", "j", "group").mapInArrow(batches_of(add), "i int, j int, group int, data binary")
    out = np.zeros((dims, dims))
    for r in summed.select("i", "j", "data").toArrow().to_pylist():
        rows, columns = (slice(k * block, min(dims, (k + 1) * block)) for k in (r["i"], r["j"]))
        tile = np.frombuffer(r["data"], dtype=np.float64).reshape(rows.stop - rows.start, -1) / n
        out[rows, columns], out[columns, rows] = tile, tile.T
    return out


def _tile(i: int, j: int, group: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([group], pa.int32()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["i", "j", "group", "data"])


@dataclass
class Whitening:
    """What whitening needs: the number of distinct vectors, their sums, and the components with their variances."""

    n: int
    sums: np.ndarray
    whole: np.ndarray
    rest: np.ndarray
    variances: np.ndarray
    trace: float
    weights: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.weights.T

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of (n * x - sums) ** 2, whether it fits a long)."""
        fits = (np.square(self.centred(x) * self.n).sum(axis=1)) < 9e18
        part = np.where(fits[:, None], self.n * (x - self.whole) - (self.sums - self.n * self.whole), 0)
        return np.square(part).sum(axis=1), fits


def fit(vectors: DataFrame, x_col: str = "x", components: int = 16, *, block: int = BLOCK, row_block: int = ROW_BLOCK) -> Whitening:
    """Learn from the distinct vectors of a column of equally long arrays of longs."""
    ship(vectors.sparkSession)
    distinct = saved(vectors.select(F.col(x_col).alias("x")).distinct(), "distinct-vectors")
    n = distinct.count()
    sums = _sums(distinct, _matrix, "bigint") if n else {}
    dims = len(sums)
    s = np.array([sums[k] for k in range(dims)], dtype=np.int64)
    if not dims:
        return Whitening(n, s, s, s.astype(float), np.zeros(0), 0.0, np.zeros((0, 0)))
    whole = s // n
    model = Whitening(n, s, whole, (s - n * whole) / n, np.zeros(0), 0.0, np.zeros((0, dims)))
    covariance = tiled_covariance(distinct, lambda x, m=model: m.centred(_matrix(x)), dims, n, block=block, row_block=row_block)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > values.max() * dims * np.finfo(float).eps]
    axes = axes[:, order].T
    axes = axes * np.sign(axes[np.arange(len(order)), np.abs(axes).argmax(axis=1)])[:, None]  # either sign would do
    model = Whitening(n, s, whole, model.rest, values[order], float(np.trace(covariance)), axes / np.sqrt(values[order])[:, None])
    if len(order):
        means = _sums(distinct, lambda x, m=model: m.whitened(_matrix(x)), "double")
        mean = np.array([means[k] for k in range(len(order))]) / n
        again = tiled_covariance(distinct, lambda x, m=model: m.whitened(_matrix(x)) - mean, len(order), n, block=block, row_block=row_block)
        model.identity_error = float(np.abs(again - np.eye(len(order))).max())
    drop_saved(distinct)
    return model


def whitened(docs: DataFrame, model: Whitening, x_col: str = "x") -> Column:
    """struct(whitened array<double>, a value for each component; deviation bigint). The broadcast holds the components."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker_udf("struct<whitened: array<double>, deviation: bigint>")
    def project(vectors: pa.Array) -> pa.Array:
        x, m = _matrix(vectors), shared.value
        values = m.whitened(x)
        deviation, fits = m.deviations(x)
        ends = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, values.ravel()), pa.array(deviation, mask=~fits)], ["whitened", "deviation"])

    return project(F.col(x_col))
