"""Missing-value rules and train-only standardization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.functions.columns import of_type
from marketrisk.functions.ordered import carried_by_bucket, clock_of, exact_quantiles
from marketrisk.series import Series


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the non-null values, read once (one number per column)."""
    if not columns:
        return {}
    rows = column_medians(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns).collect()
    found = {r["column_name"]: r["median"] for r in rows}
    return {c: found[c] if found.get(c) is not None else 0.0 for c in columns}


def column_medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact median per key and column, as (keys, column_name, median) rows.

    Long form: the plan does not grow with the number of columns.
    """
    long = df.unpivot(list(keys), list(columns), "column_name", "value")
    return exact_quantiles(long, [*keys, "column_name"], {"median": ("value", 0.5)})


def typed_fill(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls: false for booleans, 0 for integers, the median for floats; then NaN / inf to 0.

    ``fit_on`` supplies the medians (pass the training rows); default is ``df`` itself.
    """
    wanted = set(columns)
    booleans = [c for c in of_type(df, T.BooleanType) if c in wanted]
    integers = [c for c in of_type(df, T.IntegralType) if c in wanted]
    floats = [c for c in of_type(df, T.DoubleType, T.FloatType) if c in wanted]
    middle = medians(df if fit_on is None else fit_on, floats)
    made = {c: F.coalesce(F.col(c), F.lit(False)) for c in booleans}
    made |= {c: F.coalesce(F.col(c), F.lit(0)) for c in integers}
    made |= {c: F.coalesce(finite(F.coalesce(F.col(c), F.lit(middle[c]))), F.lit(0.0)) for c in floats}
    return df.withColumns(made)


def fill_gaps(df: DataFrame, columns: Sequence[str], series: Series, backward: bool = False) -> DataFrame:
    """Carry values forward; ``backward=True`` also fills the start from the future (looks ahead).

    Rows are carried within buckets of the session clock and over them, so no task takes a whole instrument.
    """
    keys, at = list(series.keys), series.session
    out = carried_by_bucket(df, keys, at, clock_of(df, at), {f"_f_{c}": c for c in columns})
    if backward:
        out = carried_by_bucket(out, keys, at, clock_of(out, at), {f"_b_{c}": c for c in columns}, backward=True)
    made = {c: F.coalesce(f"_f_{c}", f"_b_{c}") if backward else F.col(f"_f_{c}") for c in columns}
    return out.withColumns(made).select(*df.columns)


def fold_statistics(train: DataFrame, columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Median, and mean / population deviation after median filling, per fold of training rows.

    Filling m nulls with the median moves the first two moments by known amounts, so one
    aggregation of the long form is enough.
    """
    clean = train.select(fold, *[finite(c).alias(c) for c in columns])
    long = clean.unpivot([fold], list(columns), "column_name", "value")
    moments = long.groupBy(fold, "column_name").agg(
        F.count("value").alias("_n"),
        F.count(F.lit(1)).alias("_all"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_var"),
    )
    both = moments.join(F.broadcast(column_medians(clean, columns, [fold])), [fold, "column_name"])  # folds x columns rows
    known = F.col("_n") / F.col("_all")
    middle = F.coalesce(F.col("median"), F.lit(0.0))
    away = F.col("_avg") - middle
    stats = both.select(
        fold,
        "column_name",
        middle.alias("median"),
        (middle + known * away).alias("mean"),
        F.sqrt(known * F.col("_var") + known * (1 - known) * away * away).alias("std"),
    )
    return stats.groupBy(fold).agg(
        *[
            F.max(F.when(F.col("column_name") == c, F.col(k))).alias(f"{k}_{c}")
            for c in columns
            for k in ("median", "mean", "std")
        ]
    )


def standardized(rows: DataFrame, statistics: DataFrame, columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Fill with the fold's training median and scale with its training mean and deviation."""

    def scaled(c: str) -> Column:
        value = F.coalesce(finite(c), F.col(f"median_{c}"), F.lit(0.0))
        spread = F.col(f"std_{c}")
        return (value - F.col(f"mean_{c}")) / F.when(spread > 0, spread).otherwise(1.0)

    joined = rows.join(F.broadcast(statistics), fold)  # one row per fold
    return joined.withColumns({c: scaled(c) for c in columns}).drop(
        *[f"{k}_{c}" for k in ("median", "mean", "std") for c in columns]
    )
