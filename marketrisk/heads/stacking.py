"""Out-of-fold stacking of classifiers and score-weighted blends."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div
from marketrisk.functions.concurrent import concurrently
from marketrisk.heads.classifiers import CLASSES, FEATURES, LABEL, WEIGHT, Head, _multiclass, assembled

Fit = Callable[[DataFrame], Head]
PROBABILITIES = tuple(f"p_{k}" for k in range(CLASSES))


def scored_as(head: Head, df: DataFrame, name: str) -> DataFrame:
    """Probabilities of a head as <name>_p_0 .. <name>_p_2."""
    return head.score(df).withColumnsRenamed({p: f"{name}_{p}" for p in PROBABILITIES})


def argmax(columns: Sequence[str]) -> Column:
    """Index of the first largest column."""
    return F.array_position(F.array(*columns), F.greatest(*columns)) - 1


def meta_columns(names: Sequence[str]) -> list[str]:
    return [f"{n}_{p}" for n in sorted(names) for p in PROBABILITIES] + (["disagreement"] if len(names) > 1 else [])


def with_disagreement(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Variance of the classes the models vote for."""
    votes = [argmax([f"{n}_{p}" for p in PROBABILITIES]).cast("double") for n in sorted(names)]
    mean = sum(votes[1:], votes[0]) / len(votes)
    squares = sum((v * v for v in votes[1:]), votes[0] * votes[0]) / len(votes)
    return df.withColumn("disagreement", F.greatest(squares - mean * mean, F.lit(0.0)))


def out_of_fold(rows: DataFrame, bases: dict[str, Fit], fold_numbers: Sequence[int]) -> DataFrame:
    """Test rows of every fold with the probabilities of models fitted on that fold's train rows.

    Rows outside all test folds have no out-of-fold prediction and do not appear.  The fits run side by side.
    """
    in_role = lambda number, role: rows.filter((F.col("fold") == number) & (F.col("role") == role))
    wanted = [(number, name) for number in fold_numbers for name in bases]
    fits = [partial(bases[name], in_role(number, "train")) for number, name in wanted]
    heads = dict(zip(wanted, concurrently(rows.sparkSession, fits), strict=True))
    parts = []
    for number in fold_numbers:
        test = in_role(number, "test")
        for name in bases:
            test = scored_as(heads[number, name], test, name)
        parts.append(test)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_stack(
    rows: DataFrame,
    everything: DataFrame,
    bases: dict[str, Fit],
    fold_numbers: Sequence[int],
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    penalty: float = 0.0,
) -> tuple[Callable[[DataFrame], DataFrame], Head]:
    """Base models refitted on everything and a logistic meta model of out-of-fold probabilities.

    ``weigh`` may add a ``weight`` column to the meta rows (utility weights, say).
    """
    names = list(bases)
    columns = meta_columns(names)

    def meta_rows(df: DataFrame) -> DataFrame:
        df = with_disagreement(df, names) if len(names) > 1 else df
        return assembled(df.drop(FEATURES), columns)

    def fit_meta() -> Head:
        train = meta_rows(out_of_fold(rows, bases, fold_numbers))
        train = weigh(train) if weigh else train
        learner = LogisticRegression(
            featuresCol=FEATURES, labelCol=LABEL, family="multinomial", regParam=penalty, maxIter=200
        )
        model = (learner.setWeightCol(WEIGHT) if WEIGHT in train.columns else learner).fit(train)
        return _multiclass("stack", model, abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist())

    refits = [partial(fit, everything) for fit in bases.values()]
    meta, *heads = concurrently(rows.sparkSession, [fit_meta, *refits])
    fitted = dict(zip(names, heads, strict=True))

    def predict(df: DataFrame) -> DataFrame:
        for name, head in fitted.items():
            df = scored_as(head, df, name)
        out = meta.score(meta_rows(df)).drop(FEATURES)
        return out.withColumn("predicted_class", argmax(PROBABILITIES).cast("int"))

    return predict, meta


def accuracy_weights(validation: DataFrame, truth: str = "y_true", model: str = "model") -> DataFrame:
    """Share of each model in the summed validation accuracies (equal if all are zero).

    ``validation`` is long: one row per model and validation row, with p_0..p_2.
    """
    hit = (argmax(PROBABILITIES) == F.col(truth)).cast("double")
    scores = validation.groupBy(model).agg(F.avg(hit).alias("score"))
    return _shares(scores, F.col("score"))


def error_weights(validation: DataFrame, actual: str = "actual", predicted: str = "predicted", model: str = "model") -> DataFrame:
    """Shares of the negative mean squared errors, shifted so that the worst counts one."""
    error = F.col(actual) - F.col(predicted)
    scores = validation.groupBy(model).agg((-F.avg(error * error)).alias("score"))
    models = Window.partitionBy()  # one row per model
    return _shares(scores, F.col("score") - F.min("score").over(models) + 1)


def _shares(scores: DataFrame, amount: Column) -> DataFrame:
    models = Window.partitionBy()  # one row per model
    out = scores.withColumn("_a", amount)
    share = F.coalesce(div("_a", F.sum("_a").over(models)), 1.0 / F.count(F.lit(1)).over(models))
    return out.withColumn("weight", share).drop("_a")


def blended(
    predictions: DataFrame, weights: DataFrame, row: Sequence[str], values: Sequence[str], model: str = "model"
) -> DataFrame:
    """Weighted mean over the models of each row's values (models without a value drop out)."""
    joined = predictions.join(F.broadcast(weights.select(model, "weight")), model)  # one row per model
    return joined.groupBy(*row).agg(
        *[
            div(F.sum(F.col("weight") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))).alias(v)
            for v in values
        ]
    )


def rounded_vote(predictions: DataFrame, row: Sequence[str], index: str = "class_index") -> DataFrame:
    """Class index as the mean over the models, rounded half to even."""
    return predictions.groupBy(*row).agg(F.bround(F.avg(index), 0).cast("int").alias("class_index"))
