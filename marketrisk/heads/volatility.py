"""Volatility heads: HAR regression and a stacked ensemble."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.concurrent import concurrently
from marketrisk.functions.frames import rolling_mean
from marketrisk.series import Series

SEED = 42
HAR = ("har_daily", "har_weekly", "har_monthly")
FEATURES = "features"


def with_har_features(daily: DataFrame, series: Series, rv: str = "RV_daily") -> DataFrame:
    """RV of the day, the week (5) and the month (22)."""
    days = series.days()
    return daily.withColumns(
        {
            "har_daily": F.col(rv),
            "har_weekly": rolling_mean(rv, days, 5, 1),
            "har_monthly": rolling_mean(rv, days, 22, 1),
        }
    )


def elastic_net(penalty: float = 0.1, l1_ratio: float = 0.5) -> LinearRegression:
    return LinearRegression(regParam=penalty, elasticNetParam=l1_ratio)


def boosted(rounds: int = 100, depth: int = 5, rate: float = 0.05) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED)


def forest(trees: int = 100, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED)


@dataclass(frozen=True)
class Base:
    """A regressor and the feature columns it uses."""

    estimator: Callable[[], object]
    columns: tuple[str, ...]


def default_bases(columns: Sequence[str]) -> dict[str, Base]:
    wide = tuple(columns)
    return {
        "har_rv": Base(lambda: elastic_net(0.01), HAR),
        "boosted": Base(boosted, wide),
        "forest": Base(forest, wide),
        "elastic_net": Base(elastic_net, wide),
    }


def fit_base(name: str, base: Base, train: DataFrame, target: str):
    """Fitted function adding the column ``hat_<name>``."""
    assembler = VectorAssembler(inputCols=list(base.columns), outputCol=FEATURES)
    model = base.estimator().setFeaturesCol(FEATURES).setLabelCol(target).fit(assembler.transform(train))
    model = model.setPredictionCol(f"hat_{name}")
    return lambda df: model.transform(assembler.transform(df)).drop(FEATURES)


def fit_har(train: DataFrame, target: str):
    return fit_base("har_rv", default_bases(())["har_rv"], train, target)


def out_of_fold(rows: DataFrame, bases: dict[str, Base], target: str, fold_numbers: Sequence[int]) -> DataFrame:
    """Predictions of all bases for the test rows of every fold, each made by models of that fold's train rows.

    ``rows`` carry ``fold`` and ``role``.  The fits run side by side.
    """
    in_role = lambda number, role: rows.filter((F.col("fold") == number) & (F.col("role") == role))
    wanted = [(number, name) for number in fold_numbers for name in bases]
    fits = [partial(fit_base, name, bases[name], in_role(number, "train"), target) for number, name in wanted]
    models = dict(zip(wanted, concurrently(rows.sparkSession, fits), strict=True))
    parts = []
    for number in fold_numbers:
        test = in_role(number, "test")
        for name in bases:
            test = models[number, name](test)
        parts.append(test)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_ensemble(
    rows: DataFrame, everything: DataFrame, bases: dict[str, Base], target: str, fold_numbers: Sequence[int]
):
    """Bases refitted on everything, and an elastic-net meta model of their out-of-fold predictions."""
    hats = [f"hat_{name}" for name in bases]

    def fit_meta():
        meta_rows = out_of_fold(rows, bases, target, fold_numbers)
        return fit_base("ensemble", Base(lambda: elastic_net(0.01), tuple(hats)), meta_rows, target)

    refits = [partial(fit_base, name, base, everything, target) for name, base in bases.items()]
    meta, *fitted = concurrently(rows.sparkSession, [fit_meta, *refits])

    def predict(df: DataFrame) -> DataFrame:
        for one in fitted:
            df = one(df)
        return meta(df)

    return predict
