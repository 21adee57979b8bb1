"""Guarded math used by every feature family.

Spark's ANSI mode raises on division by zero, and ``ln`` of a non-positive
number is null; the helpers below make the result null in both cases.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-8


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(num: Column | str, den: Column | str) -> Column:
    """num / den, null when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ln(x: Column | str) -> Column:
    x = col(x)
    return F.when(x > 0, F.log(x))


def root(x: Column | str) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def flag(cond: Column) -> Column:
    """Boolean to 0/1, null stays null."""
    return cond.cast("int")


def yes(cond: Column) -> Column:
    """Boolean to 0/1, null becomes 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def total(x: Column | str) -> Column:
    """Sum that is 0, not null, when every input is null."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def mean_of(*cols: Column) -> Column:
    """Row mean over the non-null inputs."""
    summed = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return div(summed, count)


def prefixed(df: DataFrame, prefixes: str | Iterable[str]) -> list[str]:
    prefixes = (prefixes,) if isinstance(prefixes, str) else tuple(prefixes)
    return [c for c in df.columns if c.startswith(prefixes)]


def of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.NumericType)
