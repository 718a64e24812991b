"""Operator 12, whitening of embeddings with the singular value decomposition of Spark MLlib.

Entries c become whole numbers x = floor(64 c) + 1000000, so sums and deviations are exact.  The *fit list* holds each
distinct x vector once.  With its n vectors and their sums S per dimension, the rows of the decomposed matrix are
(n x - S) / n: the numerator is exact, so rows are centred before anything is multiplied.  ``RowMatrix.computeSVD`` over
them, distributed, gives the components; a singular value s is the square root of n times a component's variance, so
variances are s^2 / n.  All components are asked for, as MLlib then solves the summed products in full, not by iteration.
The total variance is computed on its own, from the exact deviations: the sum of (n x - S)^2 over rows and dimensions
divided by n^3.  Whitened vectors of the fit list have their own covariance taken, by which the fit is judged.

To the driver come sums per dimension and the products of dimensions, whose sizes follow the width of the vectors alone.

Cases: rows whose vector is null, empty, or holds null, non-finite or entries of 2^25 and more are dropped, and so are rows
whose width is not the commonest (ties: the greater).  Equal vectors are in the fit list once and every row of them gets its
own result; a null id stays null.  Components whose variance is under 1e-10 of the first one's, which rounding alone could
make, have nothing to whiten and are left out; so one distinct vector, or none, gives an empty result.  A deviation that no
long can hold is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Entries are multiplied by SCALE, and OFFSET is added to them.
SCALE, OFFSET, MOST = 64, 1_000_000, float(1 << 25)
#: Singular values below this share of the first are taken for rounding.
LEAST_SHARE = 1e-5


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of the fit list, per dimension
    components: np.ndarray  # dimensions x components
    variances: np.ndarray
    total: float  # variance over all dimensions
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and x (whole numbers) of the rows that remain."""
    c = F.col("c")
    fits = F.col("c").isNotNull() & (F.size("c") > 0) & F.forall(c, lambda e: F.coalesce(F.abs(e) < MOST, F.lit(False)))  # NaN is above all numbers
    held = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("c")).where(fits)
    found = held.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + OFFSET).alias("x"))
    widths = {r[0]: r[1] for r in found.groupBy(F.size("x")).count().collect()}  # a row per width
    width = max(widths, key=lambda w: (widths[w], w), default=0)
    return found.where(F.size("x") == width)


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and their sums per dimension, from partial sums of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([matrix(batch).sum(0)], pa.list_(pa.int64()))], names=["n", "s"])

    parts = vectors.select("x").mapInArrow(run, "n long, s array<long>").select("n", F.posexplode("s").alias("at", "s"))
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (rows[0]["n"] if rows else 0), np.array([r["s"] for r in rows], np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per vector the exact sum of (n x - S)^2, in whole numbers of any size where 64 bits might not do."""
    if not len(x):
        return []
    reach = max(abs(int(x.min())), abs(int(x.max()))) * 2 * n
    if x.shape[1] * reach * reach < 1 << 62:
        return ((n * x - sums) ** 2).sum(1).tolist()
    return [sum(v * v for v in row) for row in (n * x.astype(object) - sums.astype(object)).tolist()]


def total_deviation(vectors: DataFrame, n: int, sums: np.ndarray) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Decimal(sum(deviations(matrix(batch), n, sums)))], pa.decimal128(38, 0))], names=["d"])

    return int(vectors.select("x").mapInArrow(run, "d decimal(38,0)").agg(F.sum("d")).first()[0] or 0)


def products(vectors: DataFrame, model: Whitening) -> np.ndarray:
    """The covariance of the whitened fit list; a row per pair of components from every task, summed."""
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = model.project(matrix(batch))
                gram += w.T @ w
                first += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[gram.reshape(-1), first]], pa.list_(pa.float64()))], names=["g"])

    parts = vectors.select("x").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "g"))
    found = np.array([r["g"] for r in parts.groupBy("at").agg(F.sum("g").alias("g")).orderBy("at").collect()]) / model.n
    mean = found[k * k :]
    return found[: k * k].reshape(k, k) - np.outer(mean, mean)


def fit(vectors: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening of distinct vectors ``x``; None where they do not vary.  ``vectors`` is read several times."""
    n, sums = summed(vectors)
    deviation = total_deviation(vectors, n, sums) if n > 1 else 0
    if not deviation:
        return None
    s = F.array(*[F.lit(int(v)) for v in sums])
    centred = vectors.select(array_to_vector(F.zip_with("x", s, lambda x, t: (n * x - t).cast("double") / float(n))).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(len(sums), False, LEAST_SHARE)
    k = min(most, len(found.s))
    model = Whitening(n, sums, found.V.toArray()[:, :k], np.array(found.s.toArray()[:k]) ** 2 / n, deviation / n**3, 0.0)
    model.identity_error = float(np.abs(products(vectors, model) - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened vector of rows with ``x``."""
    kind = rows.select("vec_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                own = [d if d < 1 << 63 else None for d in deviations(x, model.n, model.sums)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(own, pa.int64()), pa.array(list(model.project(x)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """A row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    held = whole_vectors(rows, key, vector)
    model = fit(materialize(held.select("x").distinct(), "whitening-fit"), most)
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return held.select("vec_id").limit(0).select("vec_id", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in out.split(", ")))
    share = F.array(*[F.lit(float(v)) for v in model.variances / model.total])
    wide = transform(held, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
