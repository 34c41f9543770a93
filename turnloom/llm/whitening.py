"""Whitening of embeddings: covariance by Chan's merge, eigenvectors on the driver, a second pass that verifies the result.

Every task sums up its vectors batch by batch as count, mean and scatter about the mean, merging two such summaries by Chan, Golub and
LeVeque's formula; the summaries of tasks, one row each, are merged the same way by treeReduce. They have dim x dim numbers, whatever the
number of rows. The driver takes the eigenvectors. A second pass whitens all rows and merges their summaries likewise: how far their
covariance is from the identity is the error that comes with the result.

Components are whole numbers, floor(scale * c) + shift, so counts and sums are exact: 64-bit in a batch, Python's beyond. Summaries hold
the sums beside the means. The deviation of a row is exact as well: it is computed in 64 bits where the largest term allows, with Python's
integers elsewhere.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; an empty vector has no components and so no
rows. Repeated rows count as often as they are there; rows with a null vec_id take part. Vectors of unlike lengths are fitted apart,
each length for itself. Components beyond 2**53 / scale are taken as that, so that whole numbers stay exact doubles. A component
without variance (all rows alike, or fewer independent rows than components) can't be scaled: whitened is null, it isn't part of
identity_error, and explained is null if nothing varies at all. deviation is a decimal of 38 digits, and null beyond. Equal
eigenvalues leave the choice of their vectors open. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import staged

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**53)
#: An eigenvalue below this part of the greatest, times the dimension, is no variance but rounding.
NOTHING = 1e-14

Summary = tuple[int, list[int], np.ndarray, np.ndarray]  # count, exact sums, mean, scatter


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of two lists of vectors from theirs."""
    n = a[0] + b[0]
    apart = b[2] - a[2]
    scatter = a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, [x + y for x, y in zip(a[1], b[1])], a[2] + apart * (b[0] / n), scatter


def merged_by_dim(a: dict[int, Summary], b: dict[int, Summary]) -> dict[int, Summary]:
    return {d: merged(a[d], b[d]) if d in a and d in b else (a.get(d) or b[d]) for d in a.keys() | b.keys()}


def summary(x: np.ndarray, sums: list[int]) -> Summary:
    mean = x.mean(axis=0)
    centred = x - mean
    rest = centred.mean(axis=0)  # what rounding left
    return len(x), sums, mean + rest, centred.T @ centred - len(x) * np.outer(rest, rest)


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) * len(x) < 2**62:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(column) for column in x.T.tolist()]


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(scale * c) + shift for each component; the product with a power of two is exact."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def by_dim(batch: pa.RecordBatch):
    """For each length of vectors in a batch: the rows that have it, and their whole numbers."""
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = np.diff(np.asarray(column.offsets))
    flat, starts = np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, whole_numbers(flat[starts[rows][:, None] + np.arange(d)])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that are fitted."""
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)


_SUMMARY = "dim int, n long, sums array<string>, mean array<double>, scatter array<double>"


def _summed(rows: DataFrame, numbers) -> dict[int, Summary]:
    """The summaries of rows by length, numbers(dim, x) being what is summed up, with the exact sums of x."""

    def task(batches):
        total: dict[int, Summary] = {}
        for batch in batches:
            for d, _, x in by_dim(batch):
                total = merged_by_dim(total, {d: summary(numbers(d, x), exact_sums(x))})
        rows = [(d, n, [str(s) for s in sums], mean, scatter.ravel()) for d, (n, sums, mean, scatter) in total.items()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["dim", "n", "sums", "mean", "scatter"])

    def of_row(row) -> dict[int, Summary]:
        k = len(row["mean"])
        return {row["dim"]: (row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["scatter"]).reshape(k, k))}

    parts = staged(rows.mapInArrow(task, _SUMMARY), "summaries").rdd.map(of_row)
    if parts.isEmpty():
        return {}
    return parts.treeReduce(merged_by_dim, depth=max(2, math.ceil(math.log(parts.getNumPartitions(), 32))))


class Fit:
    """What whitens vectors of one length."""

    def __init__(self, fitted: Summary, components: int):
        self.n, self.sums, mean, scatter = fitted
        # The exact mean, as a whole number and what is over.
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.over = np.array([s % self.n / self.n for s in self.sums])
        values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / self.n)
        self.values, self.trace = np.maximum(values[::-1][:components], 0.0), float(np.trace(scatter)) / self.n
        self.varies = self.values > max(NOTHING * len(mean) * self.values[0], 0.0)
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        self.to = vectors[:, ::-1][:, :components] * scale
        self.error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole) - self.over) @ self.to

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - sums)**2) of each row."""
        rest = [s % self.n for s in self.sums]
        apart = x - self.whole
        largest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if largest * largest * x.shape[1] < 2**63:
            return ((self.n * apart - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in apart.tolist()]

    def check(self, of_whitened: Summary) -> None:
        """The largest absolute entry of the whitened rows' covariance less the identity, over components that vary."""
        off = (of_whitened[3] / self.n - np.eye(len(self.values)))[np.ix_(self.varies, self.varies)]
        self.error = float(np.abs(off).max()) if off.size else None


_WHITENED = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the greatest components of each row of vectors."""
    rows = usable(vectors)
    fits = {d: Fit(s, components) for d, s in _summed(rows, lambda d, x: x - float(SHIFT)).items()}
    for d, s in _summed(rows, lambda d, x: fits[d].whitened(x)).items():
        fits[d].check(s)

    def place(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for d, at, x in by_dim(batch):
                fit = fits[d]
                k, rows = len(fit.values), len(at)
                # Decimals by their digits: Arrow has no conversion from whole numbers of more than 64 bits.
                deviation = [str(v) if v < 10**38 else None for v in fit.deviations(x)]
                explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
                each = lambda v, kind: pa.array(np.tile(v, rows), kind, from_pandas=True)
                white = np.where(fit.varies, fit.whitened(x), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        each(np.arange(1, k + 1), pa.int32()),
                        pa.array(np.full(rows * k, fit.n)),
                        pa.array(deviation, pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(white.ravel(), pa.float64(), from_pandas=True),
                        each(explained, pa.float64()),
                        pa.array([fit.error] * (rows * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(place, T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(_WHITENED).fields]))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
