"""All refits of a linear head at once, from moments summed over growing histories.

A refit at position r knows the dates before r.  One aggregation adds up the moments (products of features and target)
of the rows that enter at each refit; running sums over the refits, one narrow row each, are the moments of every
training set; a small solve per refit gives its coefficients, and rows are scored by a join.  No model is fitted on
the driver, and no row is visited once per refit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.operators.folds import numbered_dates, refit_schedule


def solved(
    gram: np.ndarray, cross: np.ndarray, penalty: float = 0.0, l1_ratio: float = 0.5, sweeps: int = 10_000
) -> np.ndarray:
    """Coefficients of centred moments (per row): least squares, or the elastic net of standardized features.

    The elastic net minimizes  b'Gb / 2 - c'b + penalty (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)  with G and c in units
    of the features' deviations, by coordinate descent until nothing moves.  A feature that does not vary gets 0.
    """
    spread = np.sqrt(np.maximum(np.diag(gram), 0))
    varies = spread > 1e-12 * max(1.0, float(spread.max(initial=0)))
    scale = np.where(varies, spread, 1.0)
    g = np.where(np.outer(varies, varies), gram / np.outer(scale, scale), 0.0)
    c = np.where(varies, cross / scale, 0.0)
    if not penalty:
        return np.linalg.lstsq(g, c, rcond=None)[0] / scale * varies
    lasso, ridge = penalty * l1_ratio, penalty * (1 - l1_ratio)
    b = np.zeros(len(c))
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(varies):
            rest = c[j] - g[j] @ b + g[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - lasso, 0.0) / (g[j, j] + ridge)
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < 1e-13 * max(1.0, float(np.abs(b).max(initial=0))):
            break
    return b / scale


def expanding_coefficients(
    rows: DataFrame,
    target: str,
    columns: Sequence[str],
    initial: int = 252,
    every: int = 20,
    date: str = "session_date",
    by: Sequence[str] = (),
    penalty: float = 0.0,
    l1_ratio: float = 0.5,
) -> DataFrame:
    """Per key and refit: refit_at, trained_on (rows), intercept, coefficients.  Rows must be free of nulls.

    Refits are at ``initial`` and then at every multiple of ``every`` among the distinct dates.  A key without a row
    before a refit has no coefficients there.
    """
    by, p = list(by), len(columns)
    shift = rows.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate([*columns, target])])  # one row; any shift would do
    at = F.col("position")
    enters = F.when(at < initial, F.lit(initial)).otherwise((F.floor(at / every) + 1) * every).cast("long")
    places = numbered_dates(rows, date).select(date, enters.alias("refit_at"))
    moved = [(F.col(c) - F.col(f"_m{k}")).alias(f"_x{k}") for k, c in enumerate([*columns, target])]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = {f"_s{i}": F.sum(f"_x{i}") for i in range(p + 1)}
    sums |= {f"_s{i}_{j}": F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs}
    entering = (
        rows.join(F.broadcast(places), date)  # one row per calendar date
        .crossJoin(F.broadcast(shift))
        .select(*by, "refit_at", *moved)
        .groupBy(*by, "refit_at")
        .agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in sums.items()])
    )
    refits = refit_schedule(rows, initial, every, 1.0, date).select("refit_at").distinct()
    wanted = refits
    if by:
        keys = entering.select(*by).distinct()
        wanted = keys.crossJoin(F.broadcast(refits))  # one row per refit
    known = Window.partitionBy(*by).orderBy("refit_at").rowsBetween(Window.unboundedPreceding, 0)
    names = ["_n", *sums]
    running = (
        wanted.join(entering, [*by, "refit_at"], "left")
        .select(*by, "refit_at", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(known).alias(c) for c in names])
        .filter(F.col("_n") > 0)
        .crossJoin(F.broadcast(shift))
    )
    schema = ", ".join(
        [f"`{c}` {running.schema[c].dataType.simpleString()}" for c in [*by, "refit_at"]]
        + ["trained_on long", "intercept double", "coefficients array<double>"]
    )
    out = [*by, "refit_at", "trained_on", "intercept", "coefficients"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_numpy() for c in batch.schema.names if c not in by}
            intercepts, coefficients = [], []
            for k in range(batch.num_rows):
                n = of["_n"][k]
                mean = np.array([of[f"_s{i}"][k] for i in range(p + 1)]) / n
                m = np.zeros((p + 1, p + 1))
                for i, j in pairs:
                    m[i, j] = m[j, i] = of[f"_s{i}_{j}"][k] / n - mean[i] * mean[j]
                b = solved(m[:p, :p], m[:p, p], penalty, l1_ratio)
                center = mean + np.array([of[f"_m{i}"][k] for i in range(p + 1)])
                intercepts.append(float(center[p] - center[:p] @ b))
                coefficients.append(b.tolist())
            columns_out = [batch.column(c) for c in [*by, "refit_at", "_n"]]
            columns_out += [pa.array(intercepts, pa.float64()), pa.array(coefficients, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns_out, names=out)

    return running.mapInArrow(solve, schema)


def expanding_forecasts(
    rows: DataFrame,
    target: str,
    columns: Sequence[str],
    initial: int = 252,
    every: int = 20,
    date: str = "session_date",
    by: Sequence[str] = (),
    penalty: float = 0.0,
    l1_ratio: float = 0.5,
    name: str = "hat",
) -> DataFrame:
    """Every date from ``initial`` on with ``name``, the forecast of the refit last before it, and training_size."""
    fitted = expanding_coefficients(rows, target, columns, initial, every, date, by, penalty, l1_ratio)
    schedule = refit_schedule(rows, initial, every, 1.0, date).select(date, "training_size", "refit_at")
    hat = F.col("intercept")
    for k, c in enumerate(columns):
        hat = hat + F.get(F.col("coefficients"), k) * F.col(c)
    placed = rows.join(F.broadcast(schedule), date)  # one row per calendar date
    return placed.join(fitted, [*by, "refit_at"]).withColumn(name, hat).drop("intercept", "coefficients")
