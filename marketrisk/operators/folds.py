"""Walk-forward splits as tables: one row per (date, fold) with its role."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div


@dataclass(frozen=True)
class WalkForward:
    """Anchored (expanding) or rolling folds with a purge before and an embargo after each test."""

    n_splits: int = 8
    min_train: int = 252
    test: int = 63
    embargo: int = 1
    purge: int = 1
    anchored: bool = True

    @property
    def required(self) -> int:
        return self.min_train + self.test * self.n_splits + self.embargo * (self.n_splits - 1) + self.purge * self.n_splits

    def ranges(self, fold: Column) -> dict[str, Column]:
        """0-based positions: train [train_start, train_end), test [test_start, test_end)."""
        if self.anchored:
            train_start = F.lit(0)
            test_start = F.lit(self.min_train) + fold * (self.test + self.embargo + self.purge)
        else:
            train_start = fold * (self.test + self.embargo)
            test_start = train_start + self.min_train + self.purge
        return {
            "train_start": train_start,
            "train_end": test_start - self.purge,
            "test_start": test_start,
            "test_end": test_start + self.test,
        }


def numbered_dates(df: DataFrame, date: str = "session_date") -> DataFrame:
    """Distinct dates with 0-based position and their number (a calendar-sized table)."""
    dates = df.select(date).distinct()
    return dates.select(
        date,
        (F.row_number().over(Window.orderBy(date)) - 1).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"),
    )


def per_fold(dates: DataFrame, n_splits: int) -> DataFrame:
    return dates.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))


def fold_status(df: DataFrame, plan: WalkForward = WalkForward(), date: str = "session_date") -> DataFrame:
    """(date, fold, status): train, purge, test or embargo for every date and fold.

    Fails when there are fewer dates than the plan needs.
    """
    shortage = F.concat(
        F.lit(f"not enough data: need {plan.required} dates, have "), F.col("n_dates").cast("string")
    )
    rows = per_fold(numbered_dates(df, date), plan.n_splits).withColumns(plan.ranges(F.col("_fold")))
    at = F.col("position")
    role = (
        F.when(F.col("n_dates") < plan.required, F.raise_error(shortage))
        .when((at >= F.col("train_start")) & (at < F.col("train_end")), "train")
        .when((at >= F.col("test_start")) & (at < F.col("test_end")), "test")
        .when((at >= F.col("train_end")) & (at < F.col("test_start")), "purge")
        .otherwise("embargo")
    )
    return rows.select(date, "position", (F.col("_fold") + 1).alias("fold"), role.alias("status"))


def fold_table(df: DataFrame, plan: WalkForward = WalkForward(), date: str = "session_date") -> DataFrame:
    """Only the train and test rows of :func:`fold_status`, as ``role``."""
    status = fold_status(df, plan, date).withColumnRenamed("status", "role")
    return status.filter(F.col("role").isin("train", "test"))


def group_folds(
    df: DataFrame,
    group: str,
    n_splits: int = 8,
    test_size: int = 20,
    purge: int = 1,
    max_train: int | None = None,
) -> DataFrame:
    """Folds over ordered groups whose tests fill the end of the history."""
    groups = numbered_dates(df, group)
    n, at = F.col("n_dates"), F.col("position")
    rows = per_fold(groups, n_splits).withColumn("_test", n - (n_splits - F.col("_fold")) * test_size)
    start = F.lit(0) if max_train is None else F.greatest(F.lit(0), F.col("_test") - max_train - purge)
    role = (
        F.when(n < n_splits * test_size, F.raise_error(F.lit(f"not enough groups for {n_splits} splits")))
        .when((at >= start) & (at < F.col("_test") - purge), "train")
        .when((at >= F.col("_test")) & (at < F.col("_test") + test_size), "test")
    )
    out = rows.select(group, "position", (F.col("_fold") + 1).alias("fold"), role.alias("role"))
    return out.filter(F.col("role").isNotNull())


def assigned(rows: DataFrame, folds: DataFrame, date: str = "session_date") -> DataFrame:
    """Rows with their fold and role (a row appears once per fold that uses it)."""
    return rows.join(F.broadcast(folds.select(date, "fold", "role")), date)  # dates x folds rows


def refit_schedule(
    df: DataFrame, initial: int = 252, every: int = 20, inner: float = 0.8, date: str = "session_date"
) -> DataFrame:
    """Expanding one-step-ahead plan: which refit serves each date, and its train / validation cut.

    A model is refitted at ``initial`` and then at every multiple of ``every``; it trains on the
    positions before ``inner_train_end`` and validates on the rest up to ``refit_at``.
    """
    at = F.col("position")
    refit = F.greatest(F.lit(initial), F.floor(at / F.lit(every)) * every)
    return (
        numbered_dates(df, date)
        .filter(at >= initial)
        .select(
            date,
            "position",
            at.alias("training_size"),
            refit.alias("refit_at"),
            F.floor(refit * inner).alias("inner_train_end"),
        )
    )


def split_at_date(df: DataFrame, first_test: str, date: str = "session_date") -> DataFrame:
    return df.withColumn("role", F.when(F.col(date) >= F.lit(first_test).cast("date"), "test").otherwise("train"))


def split_by_position(df: DataFrame, test_share: float = 0.2, date: str = "session_date") -> DataFrame:
    """First part train, last part test, by position among the distinct dates."""
    dates = numbered_dates(df, date)
    cut = F.floor(F.col("n_dates") * F.lit(1 - test_share))
    roles = dates.select(date, F.when(F.col("position") < cut, "train").otherwise("test").alias("role"))
    return df.join(F.broadcast(roles), date)  # one row per calendar date


def leakage_check(folds: DataFrame, date: str = "session_date") -> DataFrame:
    """Per fold: last train and first test position and date, the gap, and whether they are apart."""
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    per = folds.groupBy("fold").agg(
        F.max(of("train", "position")).alias("last_train"),
        F.min(of("test", "position")).alias("first_test"),
        F.max(of("train", date)).alias("last_train_date"),
        F.min(of("test", date)).alias("first_test_date"),
    )
    return per.withColumns(
        {
            "gap": F.col("first_test") - F.col("last_train") - 1,
            "no_leakage": (F.col("last_train") < F.col("first_test"))
            & (F.col("last_train_date") < F.col("first_test_date")),
        }
    )


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k count), scaled to mean one over the classes."""
    classes = Window.partitionBy()
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    raw = counts.withColumn(
        "_raw", F.sum("count").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("count"))
    )
    return raw.select(label, "count", div("_raw", F.avg("_raw").over(classes)).alias("weight"))


def with_class_weights(train: DataFrame, label: str) -> DataFrame:
    """Attach the weight of each row's class (one small row per class)."""
    weights = class_weights(train, label).select(label, "weight")
    return train.join(F.broadcast(weights), label, "left")


def with_utility_weights(train: DataFrame, label: str, utility: Sequence[Sequence[float]]) -> DataFrame:
    """Weight of a row: absolute diagonal utility of its class."""
    diagonal = F.array(*[F.lit(abs(float(utility[i][i]))) for i in range(len(utility))])
    return train.withColumn("weight", F.get(diagonal, F.col(label)))
