"""Embedding whitening: exact sums by Spark, leading components by contour integration.

Two passes gather exact integers: the vectors' number and sums, then the products of the entries'
distances from the whole number next to their mean. From these the covariance follows without any
rounding but the last. It is as large as two vectors multiply to, whatever the number of rows, and
its leading eigenpairs are found on the driver (``contour``). A third pass measures the covariance
of the whitened rows, and the rows themselves are whitened as they are read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contour import EPS, leading

SCALE, SHIFT = 64, 1_000_000
#: A matrix of this many rows and columns is the most that is sent to the driver.
MOST_DIMENSIONS = 2048


@dataclass(frozen=True)
class Whitening:
    """The fit: vectors, whole mean of each dimension and what the sums leave over it, eigenpairs."""

    n: int
    size: int
    middle: tuple[int, ...]
    rest: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return vectors.where(_whole(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrices(batch: pa.RecordBatch, size: int, step: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """The whole numbers x of a batch's vectors, ``step`` rows at a time, with their first row."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy()
    for at in range(0, len(batch), step):
        x = np.floor(SCALE * flat[at * size : (at + step) * size]).reshape(-1, size)
        if x.size and np.abs(x).max() >= 2.0**52:
            raise ArithmeticError("an entry is too large for a whole number of its scale")
        yield at, x.astype(np.int64) + SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` exactly, as Python's whole numbers."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * max(1, len(y)) < 1 << 53:  # all sums are exact doubles
        return (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object)
    if len(y) > 1 and most < 1 << 26:
        return _products(y[: len(y) // 2]) + _products(y[len(y) // 2 :])
    wide = y.astype(object)
    return wide.T @ wide


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> Whitening | None:
    """Fits on all vectors whose entries are finite numbers; None where there are none.

    Vectors of another length than most are left out (of lengths met equally often, the longest one
    counts). Repeated rows count each. Components without variance, up to rounding, are none.
    """
    rows = _prepared(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return None
    size, n = lengths[0]["size"], lengths[0]["count"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of at most {MOST_DIMENSIONS} entries")
    same = rows.where(F.size("v") == size).select("v")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            for _, x in _matrices(batch, size):
                total += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([decimal.Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in same.mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    total = [found[i] for i in range(size)]
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre = np.array(middle, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size), object)
        for batch in batches:
            for _, x in _matrices(batch, size):
                own = own + _products(x - centre)
        for i in range(size):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (size - i), pa.int32()), pa.array(range(i, size), pa.int32()), pa.array([decimal.Decimal(int(t)) for t in own[i, i:]], pa.decimal128(38, 0))], ["i", "j", "s"])

    gathered = same.mapInArrow(products, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    covariance = np.zeros((size, size))
    for r in gathered:
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)
    values, block = leading(covariance, min(components, size))
    trace = float(np.trace(covariance))
    kept = values > size * EPS * trace
    return Whitening(n, size, tuple(middle), tuple(rest), values[kept], block[:, kept], trace)


def _distances(model: Whitening, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ``x - middle`` and the whitened rows."""
    centre, over = np.array(model.middle, np.int64), np.array([r / model.n for r in model.rest])
    project = model.vectors / np.sqrt(model.values)
    for at, x in _matrices(batch, model.size):
        y = x - centre
        yield at, y, (y - over) @ project


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from all of them."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, _, w in _distances(model, batch):
                first += w.sum(0)
                second += w.T @ w
        for i in range(k):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (k + 1), pa.int32()), pa.array(range(-1, k), pa.int32()), pa.array([first[i], *second[i]])], ["i", "j", "s"])

    out = np.zeros((k, k + 1))
    for r in rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"] + 1] = r["s"]
    mean = out[:, 0] / model.n
    return float(np.abs(out[:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened``: each vector's exact sum of ``(n * x - S) ** 2`` and its whitened entries, one
    for each component. Rows without a vector, with another length or with an entry that is no finite number are left out; null ids stay
    null, repeated rows stay."""
    rows = _prepared(vectors, id_col, vec_col).where(F.size("v") == model.size)
    rest = np.array(model.rest, object)
    wide = max((abs(r) for r in model.rest), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y, w in _distances(model, batch):
                most = model.n * int(np.abs(y).max()) + wide if y.size else 0
                if most * most * model.size < 1 << 63:
                    deviation = ((model.n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [sum(v * v for v in row) for row in (model.n * y.astype(object) - rest).tolist()]
                ids = batch.column(0).slice(at, len(y))
                yield pa.RecordBatch.from_arrays([ids, pa.array([decimal.Decimal(d) for d in deviation], pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. An empty table, and vectors without any variance, give no rows; a deviation that no long holds is an error."""
    spark = vectors.sparkSession
    model = fit_whitening(vectors, id_col, vec_col, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = _prepared(vectors, id_col, vec_col).where(F.size("v") == model.size)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(vectors, model, id_col, vec_col).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
