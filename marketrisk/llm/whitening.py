"""Whitening of embeddings by a covariance found from variances alone (polarisation).

Entries become whole numbers, x = floor(1024 c) + 100000, so that every sum is exact.  One aggregation gives the
sums, a second the sums of squares of the centred values of every dimension and of the sum of every two dimensions:
cov(a, b) = (var(a + b) - var(a) - var(b)) / 2.  Centred means less the whole part of the mean; the rest of the mean,
a fraction of exact whole numbers, is taken off exactly afterwards.  The matrix of doubles nearest to the exact
covariances goes to ``eigh``, and a narrow map projects the rows.

Each task sends one row of sums per dimension or pair, so what is shuffled and what reaches the driver depends on
the number of dimensions and tasks, not on rows; equal rows need no care.

Defined cases: vectors that are null, hold null or non-finite entries or ones whose x does not fit 62 bits, or are not of
the most frequent length (of equally frequent ones the greatest), are dropped; repeated rows and null ids are rows like
others; without a remaining vector the result is empty.  Directions without variance (equal vectors, fewer vectors
than dimensions) have null for the whitened value; when all vectors are equal, the explained share is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100_000
#: Exact whole numbers travel as limbs of so many bits.
LIMB, LIMBS = 40, 5
#: Rows whose pair sums are taken together.
ROWS = 2048
#: Whitened products are summed in units of 2**-UNIT.
UNIT = 30


def scaled(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows remain, their x as rows of 64-bit whole numbers) of a column of lists of doubles."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    entries = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(entries.reshape(-1, dims) * SCALE)
    fine = (np.isfinite(x) & (np.abs(x) < 2.0**62)).all(axis=1)
    right[right] = fine
    return right, x[fine].astype(np.int64) + SHIFT


def _whole_sums(rows: DataFrame, sums: Callable[[pa.Array], list[int]]) -> list[int]:
    """Exact sums, over all batches of the only column of ``rows``, of the lists of whole numbers ``sums`` gives."""
    names = ["key", *[f"limb{k}" for k in range(LIMBS)]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            found = sums(batch.column(0))
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            limbs = [[(v >> (LIMB * k)) & ((1 << LIMB) - 1) for v in total] for k in range(LIMBS - 1)]
            limbs.append([v >> (LIMB * (LIMBS - 1)) for v in total])
            columns = [pa.array(range(len(total)), pa.int64()), *[pa.array(x, pa.int64()) for x in limbs]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = rows.mapInArrow(partial, ", ".join(f"{name} long" for name in names))
    added = parts.groupBy("key").agg(*[F.sum(name).alias(name) for name in names[1:]])
    found = {r["key"]: sum(r[f"limb{k}"] << (LIMB * k) for k in range(LIMBS)) for r in added.collect()}
    return [found[k] for k in range(len(found))]


def column_sums(column: pa.Array, dims: int) -> list[int]:
    """Number of rows that remain, and the sum of each dimension's x."""
    _, x = scaled(column, dims)
    most = int(np.abs(x).max(initial=0))
    if most * (len(x) + 1) < 2**62:
        return [len(x), *x.sum(axis=0).tolist()]
    return [len(x), *x.astype(object).sum(axis=0).tolist()]


def pairs(dims: int) -> Iterator[tuple[int, int]]:
    """Order of the sums of squares: every dimension with itself and those after it."""
    return ((i, j) for i in range(dims) for j in range(i, dims))


def square_sums(column: pa.Array, middle: list[int]) -> list[int]:
    """Per pair (i, j) the sum of (y_i + y_j)**2, for i = j of y_i**2, where y is x less ``middle``."""
    dims = len(middle)
    total = [0] * (dims * (dims + 1) // 2)
    _, x = scaled(column, dims)
    for first in range(0, len(x), ROWS):
        part = x[first : first + ROWS]
        y = part - np.array(middle, np.int64)
        if int(np.abs(y).max(initial=0)) >= 2**24:  # squares of sums would leave 64 bits
            y = part.astype(object) - np.array(middle, object)
        found: list[int] = []
        for i in range(dims):
            sums = y[:, i:] + y[:, i : i + 1]
            sums[:, 0] = y[:, i]
            found += (sums * sums).sum(axis=0).tolist()
        total = [a + b for a, b in zip(total, found, strict=True)]
    return total


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Doubles nearest to the exact covariances, divisor n, from sums of squares of y and sums ``rest`` of y."""
    dims = len(rest)
    spread = {}  # n**2 times the variance of y_i (i = j) or y_i + y_j
    for (i, j), q in zip(pairs(dims), squares, strict=True):
        spread[i, j] = n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2
    found = np.empty((dims, dims))
    for i, j in pairs(dims):
        exact = spread[i, i] if i == j else (spread[i, j] - spread[i, i] - spread[j, j]) // 2  # no remainder
        found[i, j] = found[j, i] = exact / (n * n)
    return found


@dataclass
class Whitening:
    """What the rows say: n, whole parts and remaining sums of the means, components as columns, variances falling."""

    n: int
    middle: list[int]
    rest: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = field(default=0.0)

    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.variances]

    def solid(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        least = len(self.middle) * np.finfo(float).eps * (self.variances[0] if len(self.variances) else 0)
        return self.variances > least

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; NaN along directions without variance."""
        centred = (x - np.array(self.middle, np.int64)).astype(np.float64) - np.array([t / self.n for t in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.solid(), 1 / np.sqrt(np.maximum(self.variances, 0)), np.nan)
        return (centred @ self.components) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of (n x - S)**2."""
        y = x - np.array(self.middle, np.int64)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(self.middle) * most**2 < 2**63:
            each = self.n * y - np.array(self.rest, np.int64)
        else:
            each = self.n * y.astype(object) - np.array(self.rest, object)
        return (each * each).sum(axis=1).tolist()


def fitted(vectors: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The model of all remaining vectors; None when none remains."""
    rows = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    lengths = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("dims")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return None
    dims = common["dims"]
    counted = _whole_sums(rows, lambda column: column_sums(column, dims))
    if not counted or not counted[0]:
        return None
    n, sums = counted[0], counted[1:]
    middle, rest = [s // n for s in sums], [s % n for s in sums]
    squares = _whole_sums(rows, lambda column: square_sums(column, middle))
    v = covariance(n, rest, squares)
    variances, directions = np.linalg.eigh(v)
    variances, directions = variances[::-1][:components], directions[:, ::-1][:, :components]
    # Either sign is right; the entry of greatest size is made positive so that reruns agree.
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[largest, np.arange(directions.shape[1])])
    model = Whitening(n, middle, rest, directions, variances, float(np.trace(v)))
    model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened values less the identity, measured over all rows."""
    solid, dims = model.solid(), len(model.middle)
    k = int(solid.sum())
    if not k:
        return 0.0

    def products(column: pa.Array) -> list[int]:
        _, x = scaled(column, dims)
        w = model.projected(x)[:, solid]
        sums = [*w.sum(axis=0), *(w.T @ w).ravel()]
        return [round(math.ldexp(float(s), UNIT)) for s in sums]

    # Whole numbers add up to the same sum in any order of the tasks.
    sums = np.array([math.ldexp(v, -UNIT) for v in _whole_sums(rows, products)]) / model.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(
    vectors: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, deviation (exact; null beyond 38 digits) and whitened (a value per component) of the vectors that remain."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema["vec_id"]]).add("deviation", T.DecimalType(38, 0))
    schema = schema.add("whitened", T.ArrayType(T.DoubleType()))
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = len(model.middle)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, x = scaled(batch.column(1), dims)
            w = model.projected(x)
            values = pa.array(w.ravel(), from_pandas=True)
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            deviations = model.deviations(x)
            columns = [
                batch.column(0).filter(pa.array(right)),
                pa.array([d if d < 10**38 else None for d in deviations], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(ends, values),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
