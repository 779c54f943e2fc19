"""Whitening of embeddings by a tiled covariance.

Rows become row blocks, and a row block is cut into column blocks of WIDTH dimensions.  A tile is a pair of column blocks;
each column block is sent to the tiles it is part of, shuffled by tile and row block, so that the two blocks of a tile meet for
every row block; there they are multiplied and added to the tile's running sum.  A task holds one tile's sum at a time, the sums of
all tasks are added in two steps, and only the finished tiles (dimensions squared numbers, MAX_DIMS at most) come to the
driver, which assembles and decomposes them.  Nothing that grows with the rows does.

Entries are scaled to integers.  Before anything is multiplied they are centred on the integers next to the means, which keeps
products and sums exact (whole numbers below 2^53 for usual data, in any order of adding); the fraction that the centre lacks is taken
out of the finished covariance.  Column blocks travel in the smallest type that holds them.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; the dimension is the most
frequent length of the others (ties: the larger) and vectors of another length are dropped, too; components whose eigenvalue is zero
but for rounding can't be whitened and are not returned, so that equal or single vectors give no rows; a null or repeated vec_id passes
through; entries beyond 2^54 in size count as that; a deviation that no long holds is null; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Dimensions of a column block, rows of a row block, and the dimensions up to which the driver decomposes (134 MB).
WIDTH, ROWS, MAX_DIMS = 16, 1024, 4096
COMPONENTS = 32
#: Values of one output batch; partial sums of a tile that are added by one task before the last step.
HELD, SPREAD = 1 << 16, 64
_EXTREME = float(1 << 60)


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`vec_id, v` of the rows whose vector is there and whose entries are finite numbers, as doubles."""
    v = F.col(column).cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & ok).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scaled(v: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(v * SCALE, -_EXTREME, _EXTREME)).astype(np.int64) + OFFSET


# -- sums by dimension --


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = scaled(_matrix(batch.column(0), d))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "high", "low"])

    return run


def totals(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S): the rows and the exact sum of each dimension's integers."""
    parts = rows.select("v").mapInArrow(_sums(d), "dim int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = parts.groupBy("dim").agg(*wide).orderBy("dim").collect()
    return (int(found[0].n), [(int(r.high) << 32) + int(r.low) for r in found]) if found else (0, [0] * d)


# -- the tiled product --


def _narrow(block: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them; others as doubles."""
    most = np.abs(block).max(initial=0)
    for kind in ("i1", "i2", "i4"):
        if most <= np.iinfo(kind).max and (block == np.rint(block)).all():
            return kind, block.astype(f"<{kind}").tobytes()
    return "f8", block.astype("<f8").tobytes()


_BLOCKS = "left int, right int, row_block bigint, side int, width int, kind string, data binary"


def _blocks(d: int, width: int, vectors: Callable[[pa.Array], np.ndarray]):
    """Column blocks of each row block, once for every tile they are part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, many = TaskContext.get().partitionId() << 32, -(-d // width)
        for batch in batches:
            y = vectors(batch.column(0))
            for k in range(0, len(y), ROWS):
                out = []
                for c in range(many):
                    part = np.ascontiguousarray(y[k : k + ROWS, c * width : (c + 1) * width])
                    kind, data = _narrow(part)
                    out += [(min(c, o), max(c, o), block, int(c > o), part.shape[1], kind, data) for o in range(many)]
                block += 1
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return run


_TILES = "left int, right int, part bigint, shape int, data binary"


def _tile(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    values = [[key[0]], [key[1]], [TaskContext.get().partitionId()], [total.shape[1]], [total.astype("<f8").tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _TILES.split(", ")])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by tile, row block and side: multiplies what meets, and sums until the tile ends."""
    key, total, first = None, None, None
    for batch in batches:
        for left, right, _, side, width, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (left, right) != key:
                if key is not None:
                    yield _tile(key, total)
                key, total = (left, right), None
            block = np.frombuffer(data, f"<{kind}").reshape(-1, width).astype(np.float64)
            if side == 0:
                first = block
            if side == 1 or left == right:
                product = first.T @ block
                total = product if total is None else total + product
    if key is not None:
        yield _tile(key, total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, total = None, None
    for batch in batches:
        for left, right, _, shape, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (left, right) != key:
                if key is not None:
                    yield _tile(key, total)
                key, total = (left, right), 0.0
            total = total + np.frombuffer(data, "<f8").reshape(-1, shape)
    if key is not None:
        yield _tile(key, total)


def tiled_product(rows: DataFrame, d: int, vectors: Callable[[pa.Array], np.ndarray], width: int = WIDTH) -> np.ndarray:
    """The sum over all rows of y y^T, y being the vectors of d entries that `vectors` makes of column v."""
    blocks = rows.select("v").mapInArrow(_blocks(d, width, vectors), _BLOCKS)
    met = blocks.repartition("left", "right", "row_block").sortWithinPartitions("left", "right", "row_block", "side")
    sums = met.mapInArrow(_products, _TILES)
    for keys in (["left", "right", F.col("part") % SPREAD], ["left", "right"]):
        sums = sums.repartition(*keys).sortWithinPartitions("left", "right", "part").mapInArrow(_added, _TILES)
    out = np.zeros((d, d))
    for r in sums.collect():
        part = np.frombuffer(r.data, "<f8").reshape(-1, r.shape)
        i, j = r.left * width, r.right * width
        out[i : i + part.shape[0], j : j + part.shape[1]] = part
        out[j : j + part.shape[1], i : i + part.shape[0]] = part.T
    return out


# -- whitening --


class Fit:
    """What the fit list gives: n, integer centres and what they lack, the projection, and the share of each component."""

    def __init__(self, n: int, sums: list[int], product: np.ndarray, components: int):
        self.n = n
        self.centre = centres(n, sums)
        self.lack = np.array([s - n * int(m) for s, m in zip(sums, self.centre, strict=True)], np.int64)
        part = self.lack / n
        v = product / n - np.outer(part, part)
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = min(components, int((values > values.max(initial=0) * len(values) * 1e-14).sum()))
        self.projection = vectors[:, :kept] / np.sqrt(values[:kept])
        self.explained = values[:kept] / max(np.trace(v), np.finfo(float).tiny)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 = (n y - lack)^2, as whole numbers."""
        most = float(self.n) * (np.abs(y).max(initial=0) + 1.0)
        if most * most * max(y.shape[1], 1) < 2.0**62:
            return ((self.n * y - self.lack) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.lack.tolist(), strict=True)) for row in y.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y - self.lack / self.n) @ self.projection


def centres(n: int, sums: list[int]) -> np.ndarray:
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _whitened(fit: Fit, d: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.explained)
        step = max(1, HELD // k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                y = scaled(_matrix(part.column(1), d)) - fit.centre
                rows = len(y)
                of = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    part.column(0).take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fit.n)),
                    pa.array(fit.deviations(y), pa.int64()).take(of),
                    pa.array(fit.whiten(y).ravel()),
                    pa.array(np.tile(fit.explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, width: int = WIDTH) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = finite(vectors, column)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    if d == 0:
        return spark.createDataFrame([], _OUT)
    if d > MAX_DIMS:
        raise ValueError(f"{d} dimensions; the driver decomposes {MAX_DIMS} at most")
    rows = rows.where(F.size("v") == d)
    n, sums = totals(rows, d)
    middle = centres(n, sums)
    centred = lambda v: scaled(_matrix(v, d)) - middle
    fit = Fit(n, sums, tiled_product(rows, d, centred, width), components)
    k = len(fit.explained)
    if k == 0:
        return spark.createDataFrame([], _OUT)
    # the whitened vectors are measured as they come out, with a dimension of ones for their mean
    again = tiled_product(rows, k + 1, lambda v: np.column_stack([fit.whiten(centred(v)), np.ones(len(v))]), width)
    mean = again[k, :k] / n
    error = float(np.abs(again[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return rows.select(F.col("vec_id").cast("bigint"), "v").mapInArrow(_whitened(fit, d, error), _OUT)
