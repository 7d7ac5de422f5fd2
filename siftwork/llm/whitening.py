"""Embedding whitening by a tiled covariance.

1. Entries become whole numbers; the distinct vectors are the *fit list*.
2. Sums per dimension give the centre; each task adds up its own rows first.
3. The fit list is cut into row-blocks of ROWS vectors and column blocks of
   TILE dimensions.  Each column block travels to its row-block, where every
   tile key (i, j) with i <= j multiplies its two centred blocks; the products
   are summed per tile and position.
4. The tiles are assembled into one dims x dims matrix on the driver (8 bytes
   for each pair of dimensions, whatever the number of rows) and decomposed.
5. A second pass projects rows; another one measures how far the covariance of
   the whitened fit list is from the identity.

Rows are centred as whole numbers: x less the floor of the mean is exact, and
only the fraction of the mean is subtracted as a double.

Defined cases: null vectors and vectors with null or non-finite entries have no
result; vectors of another length than the most frequent one (ties: the
longest) have none either; empty vectors count as null; equal vectors count
once in the fit, but every row has its result; an empty table gives no rows.
Entries beyond 2**41 count as 2**41.  A direction without variance (fewer
distinct vectors than dimensions, constant dimensions) has explained 0 and no
whitened value.  ``deviation`` is null where it does not fit a long.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

#: Vectors of a row-block and dimensions of a column block at most.
ROWS, TILE = 1024, 64
_MOST = float(1 << 47)
_LONG = 1 << 63


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """rows whose vector is whole and finite, with x = floor(scale * entry) + shift as array<long>."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    entry = lambda c: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c.cast("double") * F.lit(float(scale))))) + F.lit(shift)
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.coalesce(finite, F.lit(False))).withColumn("x", F.transform(vector, entry))


def common_length(rows: DataFrame) -> int:
    """The most frequent length of x; 0 for no rows."""
    found = rows.groupBy(F.size("x").alias("dims")).count().agg(F.max_by("dims", F.struct("count", "dims"))).first()[0]
    return found or 0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += _matrix(batch.column(0), dims).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(s) for s in total])], names=["dim", "n", "s"])

    return run


def centre(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""
    parts = fit.select("x").mapInArrow(_sums(dims), "dim int, n long, s string")
    found = parts.groupBy("dim").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect()
    total = [0] * dims
    for dim, _, s in found:
        total[dim] = int(s)
    return (found[0][1] if found else 0), total


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n: whole part exactly, then the fraction."""
    low = np.array([s // n for s in total], np.int64)
    part = np.array([(s % n) / n for s in total])
    return (x - low).astype(np.float64) - part


def _column_blocks(dims: int, n: int, total: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            y = _centred(_matrix(batch.column(0), dims), n, total)
            for at in range(0, len(y), ROWS):
                block = y[at : at + ROWS]
                parts = [np.ascontiguousarray(block[:, c : c + TILE]).tobytes() for c in range(0, dims, TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([first + done] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["row_block", "col", "data"])
                done += 1

    return run


def _products(dims: int):
    """Products of tile pairs, added up by tile as far as a task goes (dims * dims / 2 doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(k).to_pylist() for k in ("i", "j", "a", "b"))):
                left = np.frombuffer(a).reshape(-1, min(TILE, dims - i * TILE))
                right = np.frombuffer(b).reshape(-1, min(TILE, dims - j * TILE))
                tiles[i, j] = tiles.get((i, j), 0) + left.T @ right
        for (i, j), product in tiles.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([product.ravel()], pa.list_(pa.float64()))], names=["i", "j", "product"])

    return run


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the vectors of fit(x), centred before the tiles are multiplied."""
    dims = len(total)
    blocks = materialize(fit.select("x").mapInArrow(_column_blocks(dims, n, total), "row_block long, col int, data binary"), "columns")
    left = blocks.select("row_block", F.col("col").alias("i"), F.col("data").alias("a"))
    right = blocks.select("row_block", F.col("col").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "a", "b")
    sums = pairs.mapInArrow(_products(dims), "i int, j int, product array<double>").select("i", "j", F.posexplode("product").alias("at", "v"))
    whole = np.zeros((dims, dims))
    # As many rows as there are pairs of dimensions: bounded by dims, not by the vectors.
    for i, j, values in sums.groupBy("i", "j", "at").agg(F.sum("v").alias("v")).groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).getField("v").alias("v")).toLocalIterator():
        rows, cols = slice(i * TILE, min((i + 1) * TILE, dims)), slice(j * TILE, min((j + 1) * TILE, dims))
        tile = np.array(values).reshape(rows.stop - rows.start, -1) / n
        whole[rows, cols] = tile
        whole[cols, rows] = tile.T
    return whole


class Whitening:
    """The fitted centre, components and eigenvalues; small enough to travel with each task."""

    def __init__(self, n: int, total: list[int], matrix: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1], vectors[:, ::-1]
        self.n, self.total, self.trace = n, total, float(np.trace(matrix))
        self.size = min(components, len(total))
        # Variance below the rounding of the decomposition is none.
        least = max(values[0], 0) * len(total) * np.finfo(float).eps
        self.rank = int((values[: self.size] > least).sum())
        self.values = np.where(np.arange(self.size) < self.rank, values[: self.size], 0.0)
        self.axes = vectors[:, : self.rank] / np.sqrt(self.values[: self.rank])
        self.explained = self.values / self.trace if self.trace > 0 else self.values

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.total) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - total)**2 of each row."""
        low = np.array([s // self.n for s in self.total], np.int64)
        rest = [s % self.n for s in self.total]
        y = x - low
        if (float(np.abs(y).max(initial=0)) + 1) * self.n * len(self.total) ** 0.5 < 2.0**31:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return [d if d < _LONG else None for d in exact]


def _moments(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((model.rank, model.rank))
        for batch in batches:
            w = model.whiten(_matrix(batch.column(0), len(model.total)))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    return run


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity; null without a component."""
    if model.rank == 0:
        return None
    found = fit.select("x").mapInArrow(_moments(model), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros(model.rank * model.rank)
    for at, v in found:
        matrix[at] = v / model.n
    return float(np.abs(matrix.reshape(model.rank, -1) - np.eye(model.rank)).max())


def _projected(model: Whitening, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.size
        for batch in batches:
            x = _matrix(batch.column("x"), len(model.total))
            if not len(x):
                continue
            w = np.full((len(x), k), np.nan)
            w[:, : model.rank] = model.whiten(x)
            flat = w.ravel()
            rows = len(flat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array([error] * rows, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(rows: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of rows(vec_id, <vector>) and component."""
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole_vectors(rows.select("vec_id", vector), vector, scale, shift).select("vec_id", "x")
    dims = common_length(vectors)
    vectors = vectors.where(F.size("x") == dims)
    if dims == 0:
        return rows.sparkSession.createDataFrame([], schema)
    # Partial aggregation drops copies before the shuffle, so a vector that many rows share is no hot key.
    fit = materialize(vectors.select("x").distinct(), "fit")
    n, total = centre(fit, dims)
    model = Whitening(n, total, covariance(fit, n, total), components)
    return vectors.mapInArrow(_projected(model, identity_error(fit, model)), schema)
