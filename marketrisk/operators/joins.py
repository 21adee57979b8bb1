"""Join shapes: overlap-free left joins, suffixes, semi-joins, release lags and as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.ordered import SALTS, carried_by_bucket, clock_of, same_keys


def left_without_overlap(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that drops right columns the left side already has."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.drop(*clash), list(on), "left")


def left_with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Left join that renames clashing right columns to ``column_name``."""
    renamed = {c: f"{c}_{name}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(renamed), list(on), "left")


def keep_dates(df: DataFrame, dates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key appears in ``dates``."""
    return df.join(dates.select(*on).distinct(), list(on), "left_semi")


def as_of_left(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    tie_break: str | None = None,
) -> DataFrame:
    """For each left row the last right values with right_time <= left_time.

    Of several right rows with one time, the largest ``tie_break`` counts.  The right side is first reduced to its last
    row per key and time.  What is known is then found once for every distinct key and time, in buckets of time (see
    :func:`marketrisk.functions.ordered.carried_by_bucket`), and joined back to the left rows over salts, so that neither
    one key nor one time need fit a task.  A null left time finds nothing, a null right time is never known; null keys
    are one group.  A last right row whose value is null gives null.
    """
    keys = list(keys)
    spot = [*keys, "_at"]
    events = (
        right.filter(F.col(right_time).isNotNull())
        .select(*keys, F.col(right_time).alias("_at"), F.col(tie_break or right_time).alias("_tie"), F.struct(*values).alias("_row"))
        .groupBy(*spot)
        .agg(F.max_by("_row", F.struct(F.col("_tie").isNotNull().alias("known"), "_tie")).alias("_event"))
    )
    asked = left.filter(F.col(left_time).isNotNull()).select(*keys, F.col(left_time).alias("_at")).distinct()
    both = events.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    spots = both.groupBy(*spot).agg(F.max("_event").alias("_event"), F.max("_asked").alias("_asked"))
    found = carried_by_bucket(spots, keys, "_at", clock_of(spots, "_at"), {"_last": "_event"}).filter("_asked")
    told = found.select(*[F.col(c).alias(f"_k_{c}") for c in spot], "_last").withColumn(
        "_k__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    salted = left.withColumn("_at", F.col(left_time)).withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    )
    joined = salted.join(told, same_keys([*spot, "_salt"], "_k_"), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"_last.{v}").alias(v) for v in values])


def released(df: DataFrame, column: str, business_days: int = 3) -> Column:
    """Release date of a value: its date plus business days (Monday to Friday)."""
    day = F.col(column)
    weekday = F.least(F.weekday(day), F.lit(4))  # a weekend date counts from its Friday
    start = F.date_add(day, weekday - F.weekday(day))
    weekends = F.floor((weekday + business_days) / 5).cast("int") * 2
    return F.date_add(start, F.lit(business_days) + weekends)
