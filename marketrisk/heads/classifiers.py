"""Three-class heads.  A fitted head turns rows into probabilities p_0, p_1, p_2.

Fitting runs Spark jobs (MLlib); scoring stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div
from marketrisk.functions.concurrent import concurrently

CLASSES = 3
SEED = 42
FEATURES, LABEL, WEIGHT = "features", "label", "weight"


def assembled(df: DataFrame, columns: Sequence[str], output: str = FEATURES) -> DataFrame:
    """Feature columns as one vector; rows must be free of nulls (see ``operators.impute``)."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def label_indexer(train: DataFrame, column: str, output: str = LABEL):
    """Alphabetical label encoding and its inverse."""
    model = StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc").fit(train)
    return model, lambda index_column, name: IndexToString(inputCol=index_column, outputCol=name, labels=model.labels)


def _weighted(estimator, train: DataFrame):
    return estimator.setWeightCol(WEIGHT) if WEIGHT in train.columns else estimator


@dataclass(frozen=True)
class Head:
    """A fitted classifier: ``score`` adds p_0..p_2; ``importances`` are per feature, if any."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    importances: Sequence[float] | None = None
    parts: tuple = field(default=(), repr=False)


def _normalized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Class scores divided by their row sum (equal shares if all are zero)."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumns(
        {f"p_{k}": F.coalesce(div(F.col(c), total), F.lit(1.0 / len(columns))) for k, c in enumerate(columns)}
    ).drop(*columns)


def _multiclass(name: str, model, importances) -> Head:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("_p", vector_to_array("probability"))
        made = {f"p_{k}": F.get(F.col("_p"), k) for k in range(CLASSES)}
        return out.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in made.items()}).drop(
            "_p", "probability", "rawPrediction", "prediction"
        )

    return Head(name, score, importances, (model,))


def boosted_trees(
    train: DataFrame, rounds: int = 100, depth: int = 6, rate: float = 0.05, validation: str | None = None
) -> Head:
    """One boosted binary model per class, probabilities normalized.

    ``validation`` names a boolean column; its rows are held out to stop early.
    """
    models = []
    for k in range(CLASSES):
        one = GBTClassifier(
            featuresCol=FEATURES, labelCol="_is", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED
        )
        if validation:
            one = one.setValidationIndicatorCol(validation)
        labelled = train.withColumn("_is", (F.col(LABEL) == k).cast("double"))
        fitted = _weighted(one, train).fit(labelled)
        fitted = fitted.setPredictionCol(f"_c{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_v{k}")
        models.append(fitted)

    def score(df: DataFrame) -> DataFrame:
        for k, model in enumerate(models):
            df = model.transform(df).withColumn(f"_s{k}", vector_to_array(f"_v{k}")[1])
            df = df.drop(f"_c{k}", f"_r{k}", f"_v{k}")
        return _normalized(df, [f"_s{k}" for k in range(CLASSES)])

    importances = np.mean([m.featureImportances.toArray() for m in models], axis=0).tolist()
    return Head("boosted_trees", score, importances, tuple(models))


def random_forest(train: DataFrame, trees: int = 100, depth: int = 10) -> Head:
    estimator = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=SEED)
    model = _weighted(estimator, train).fit(train)
    return _multiclass("random_forest", model, model.featureImportances.toArray().tolist())


def elastic_net_logistic(train: DataFrame, penalty: float = 0.01, l1_ratio: float = 0.5, rounds: int = 1000) -> Head:
    estimator = LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        family="multinomial",
        regParam=penalty,
        elasticNetParam=l1_ratio,
        maxIter=rounds,
    )
    model = _weighted(estimator, train).fit(train)
    importances = np.abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return _multiclass("elastic_net", model, importances)


def fourier_features(width: int, size: int, gamma: float, seed: int = SEED) -> Callable[[Column], Column]:
    """Random Fourier features whose inner products approximate an RBF kernel."""
    draw = np.random.default_rng(seed)
    directions = draw.normal(0.0, np.sqrt(2 * gamma), (width, size))
    phases = draw.uniform(0.0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / size) * np.cos(np.stack(x.to_numpy()) @ directions + phases)
        return pd.Series(list(z))

    return lambda vector: array_to_vector(mapped(vector_to_array(vector)))


def kernel_svm(
    train: DataFrame, width: int, size: int = 200, penalty: float = 0.01, rounds: int = 50, folds: int = 3
) -> Head:
    """Linear SVMs per class on random Fourier features, with logistic calibration of the margin.

    The calibration sees margins of machines that did not see the row: rows are dealt into ``folds`` by a hash of their
    features, so equal rows share a fold.
    """
    spread = train.select(F.explode(vector_to_array(FEATURES)).alias("v")).agg(F.var_pop("v")).first()[0]
    lift = fourier_features(width, size, gamma=1.0 / (width * spread) if spread else 1.0)
    lifted = train.withColumn("_z", lift(F.col(FEATURES)))
    lifted = lifted.withColumn("_fold", F.pmod(F.xxhash64(vector_to_array(FEATURES)), F.lit(folds)))

    def machine(k: int, rows: DataFrame):
        rows = rows.withColumn("_is", (F.col(LABEL) == k).cast("double"))
        one = LinearSVC(featuresCol="_z", labelCol="_is", regParam=penalty, maxIter=rounds)
        return _weighted(one, train).fit(rows).setRawPredictionCol(f"_r{k}").setPredictionCol(f"_c{k}")

    wanted = [(k, fold) for k in range(CLASSES) for fold in (None, *range(folds))]
    parts = {fold: lifted.filter(F.col("_fold") != fold) for fold in range(folds)} | {None: lifted}
    fits = [partial(machine, k, parts[fold]) for k, fold in wanted]
    machines = dict(zip(wanted, concurrently(train.sparkSession, fits), strict=True))
    pairs = []
    for k in range(CLASSES):
        held_out = [_margin(machines[k, f].transform(lifted.filter(F.col("_fold") == f)), k) for f in range(folds)]
        margins = reduce(DataFrame.unionByName, held_out).withColumn("_is", (F.col(LABEL) == k).cast("double"))
        platt = LogisticRegression(featuresCol=f"_m{k}", labelCol="_is", maxIter=50)
        platt = platt.fit(margins).setProbabilityCol(f"_v{k}").setRawPredictionCol(f"_w{k}").setPredictionCol(f"_d{k}")
        pairs.append((machines[k, None], platt))

    def score(df: DataFrame) -> DataFrame:
        df = df.withColumn("_z", lift(F.col(FEATURES)))
        for k, (machine, platt) in enumerate(pairs):
            df = platt.transform(_margin(machine.transform(df), k))
            df = df.withColumn(f"_s{k}", vector_to_array(f"_v{k}")[1])
            df = df.drop(f"_r{k}", f"_c{k}", f"_m{k}", f"_v{k}", f"_w{k}", f"_d{k}")
        return _normalized(df.drop("_z"), [f"_s{k}" for k in range(CLASSES)])

    return Head("kernel_svm", score, None, tuple(pairs))


def _margin(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn(f"_m{k}", array_to_vector(F.array(vector_to_array(f"_r{k}")[1])))


def importance_rows(spark, heads: Sequence[Head], names: Sequence[str]) -> DataFrame:
    """(model, feature, importance) rows of the heads that have importances."""
    rows = [(h.name, n, float(v)) for h in heads if h.importances is not None for n, v in zip(names, h.importances)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def mean_importance(rows: DataFrame) -> DataFrame:
    """Importance of each feature averaged over the models."""
    return rows.groupBy("feature").agg(F.avg("importance").alias("importance"))
