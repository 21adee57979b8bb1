"""Quantile forest, monotone rearrangement, nearest-level and conformal intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.ordered import exact_quantiles

LEVELS = (0.05, 0.5, 0.95)
SEED = 42
#: Values that stand for the targets of a leaf: evenly spaced quantiles of theirs.
LEAF_VALUES = 64
LEAF_ACCURACY = 10_000
MAX_LEAF_CELLS = 50_000_000


def level_name(q: float) -> str:
    """0.05 -> 'q05'."""
    return f"q{round(q * 100):02d}"


def fit_quantile_forest(
    train: DataFrame,
    target: str,
    levels: Sequence[float] = LEVELS,
    trees: int = 100,
    depth: int = 10,
    features: str = "features",
) -> Callable[[DataFrame], DataFrame]:
    """Forest whose leaves know the quantiles of their training targets.

    A prediction is the quantile of the targets pooled over the row's leaves, each tree weighing the same.  A leaf's
    targets are represented by ``LEAF_VALUES`` evenly spaced quantiles from one mergeable sketch (accuracy
    ``LEAF_ACCURACY``), so a leaf may hold any number of rows.  The leaf table has at most trees x 2^(depth + 1) rows,
    checked before it is read; it travels to the scoring tasks like the forest itself.
    """
    if trees * 2 ** (depth + 1) * LEAF_VALUES > MAX_LEAF_CELLS:
        raise ValueError("the leaf table would be too large; use fewer trees or less depth")
    estimator = RandomForestRegressor(
        featuresCol=features, labelCol=target, numTrees=trees, maxDepth=depth, leafCol="_leaf", seed=SEED
    )
    model = estimator.fit(train)
    grid = F.array(*[F.lit((k + 0.5) / LEAF_VALUES) for k in range(LEAF_VALUES)])
    leaves = (
        model.transform(train)
        .select(target, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
        .groupBy("tree", F.col("leaf").cast("int").alias("leaf"))
        .agg(F.percentile_approx(target, grid, F.lit(LEAF_ACCURACY)).alias("q"))
        .collect()
    )
    table = np.zeros((trees, max(r["leaf"] for r in leaves) + 1, LEAF_VALUES))
    for r in leaves:
        table[r["tree"], r["leaf"]] = r["q"]
    shared = train.sparkSession.sparkContext.broadcast(table)

    wanted = [float(q) for q in levels]

    @F.pandas_udf("array<double>")
    def looked_up(leaf: pd.Series) -> pd.Series:
        at = np.stack(leaf.to_numpy()).astype(int)
        out = []
        for first in range(0, len(at), 256):
            some = at[first : first + 256]
            pooled = shared.value[np.arange(some.shape[1]), some].reshape(len(some), -1)
            out.append(np.quantile(pooled, wanted, axis=1).T)
        return pd.Series(list(np.concatenate(out)))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("_q", looked_up(vector_to_array("_leaf")))
        made = {level_name(q): F.get(F.col("_q"), i) for i, q in enumerate(levels)}
        return out.withColumns(made).drop("_q", "_leaf", "prediction")

    return predict


def monotone(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sort the quantile columns of each row (given in ascending level order)."""
    ordered = df.withColumn("_s", F.array_sort(F.array(*columns)))
    return ordered.withColumns({c: F.get(F.col("_s"), i) for i, c in enumerate(columns)}).drop("_s")


def nearest(levels: Sequence[float], wanted: float) -> float:
    return min(sorted(levels), key=lambda q: abs(q - wanted))


def with_interval(df: DataFrame, columns: dict[float, str], coverage: float = 0.9) -> DataFrame:
    """Interval from the predicted levels nearest to the wanted tails."""
    tail = (1 - coverage) / 2
    return df.withColumns(
        {
            "interval_low": F.col(columns[nearest(list(columns), tail)]),
            "interval_high": F.col(columns[nearest(list(columns), 1 - tail)]),
        }
    )


def conformal_radius(calibration: DataFrame, actual: str, median: str, alpha: float = 0.1) -> float:
    """Quantile of |actual - median| at ceil((1-alpha)(n+1))/n, read once."""
    errors = calibration.select(F.abs(F.col(actual) - F.col(median)).alias("_e")).filter(F.col("_e").isNotNull())
    n = errors.count()
    if n == 0:
        raise ValueError("no calibration rows")
    level = min(1.0, max(0.0, math.ceil((1 - alpha) * (n + 1)) / n))
    return exact_quantiles(errors, [], {"radius": ("_e", level)}).first()["radius"]


def with_conformal(df: DataFrame, radius: float, median: str) -> DataFrame:
    return df.withColumns(
        {"conformal_low": F.col(median) - F.lit(radius), "conformal_high": F.col(median) + F.lit(radius)}
    )
