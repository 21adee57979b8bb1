"""Checks and reports, each one aggregation of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import numeric_columns, prefixed
from marketrisk.functions.ordered import exact_quantiles
from marketrisk.series import Series

FAMILIES = ("ohlcv_", "iex_", "sip_")
ARRIVALS_PER_BUCKET = 1 << 20


def missing(c: str) -> Column:
    return F.col(c).isNull()


def share_missing(c: str) -> Column:
    return F.avg(missing(c).cast("double"))


def early_null_share(df: DataFrame, prefix: str, cutoff: str, ts: str = "timestamp") -> DataFrame:
    """Mean null share of a column family before a date."""
    columns = prefixed(df, prefix)
    early = df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp"))
    shares = [share_missing(c) for c in columns]
    mean = sum(shares[1:], shares[0]) / len(shares)
    return early.agg(F.count(F.lit(1)).alias("early_rows"), mean.alias("null_share"))


def order_violations(
    df: DataFrame, ts: str, arrival: str, keys: Sequence[str] = (), per_bucket: int = ARRIVALS_PER_BUCKET
) -> DataFrame:
    """Number of rows earlier than the row that arrived before them, per key.

    Neighbours are compared inside arrival buckets; bucket edges are compared on a table
    with one row per bucket.
    """
    keys = list(keys)
    rows = df.select(*keys, ts, arrival).withColumn("_bucket", F.floor(F.col(arrival) / F.lit(per_bucket)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(arrival)
    per = (
        rows.withColumn("_bad", (F.col(ts) < F.lag(ts).over(inside)).cast("int"))
        .groupBy(*keys, "_bucket")
        .agg(
            F.coalesce(F.sum("_bad"), F.lit(0)).alias("_bad"),
            F.count(F.lit(1)).alias("_n"),
            F.min_by(ts, arrival).alias("_first"),
            F.max_by(ts, arrival).alias("_last"),
        )
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    edge = F.coalesce((F.col("_first") < F.lag("_last").over(along)).cast("int"), F.lit(0))
    return (
        per.withColumn("_edge", edge)
        .groupBy(*keys)
        .agg(F.sum("_n").alias("rows"), F.sum(F.col("_bad") + F.col("_edge")).alias("violations"))
    )


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def duplicate_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return duplicates(df, columns).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def asserted(df: DataFrame, failures: DataFrame, message: str) -> DataFrame:
    """Run the check and return ``df``; raise when ``failures`` has rows (looks for one row only)."""
    if not failures.isEmpty():
        raise ValueError(message)
    return df


def completeness(df: DataFrame, families: Sequence[str] = FAMILIES, min_fraction: float = 0.8) -> DataFrame:
    """Null share per column of the families, with the two warning levels."""
    columns = prefixed(df, families)
    long = df.agg(*[share_missing(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "null_share")
    return long.withColumns(
        {"mostly_missing": F.col("null_share") > 0.5, "below_minimum": F.col("null_share") > 1 - min_fraction}
    )


def missing_report(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per column: nulls, percentage, first and last time with a value, and the table's overall percentage."""
    columns = [c for c in df.columns]
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.count_if(missing(c)).alias("nulls"),
                F.min(F.when(~missing(c), F.col(ts))).alias("first_valid"),
                F.max(F.when(~missing(c), F.col(ts))).alias("last_valid"),
            ).alias(c)
            for c in columns
        ],
    )
    total = sum((F.col(f"{c}.nulls") for c in columns[1:]), F.col(f"{columns[0]}.nulls"))
    long = wide.withColumn("_total", total).unpivot(["_rows", "_total"], columns, "column_name", "_s")
    return long.select(
        "column_name",
        F.col("_s.nulls").alias("null_count"),
        (F.col("_s.nulls") / F.col("_rows") * 100).alias("null_pct"),
        F.col("_s.first_valid").alias("first_valid"),
        F.col("_s.last_valid").alias("last_valid"),
        (F.col("_total") / (F.col("_rows") * len(columns)) * 100).alias("overall_missing_pct"),
    )


def worst_columns(report: DataFrame, n: int = 5) -> DataFrame:
    """The n columns with the most nulls."""
    return report.filter(F.col("null_count") > 0).orderBy(F.col("null_pct").desc(), "column_name").limit(n)


def monthly_missing(df: DataFrame, families: Sequence[str] = FAMILIES, ts: str = "timestamp") -> DataFrame:
    """Nulls per month in the first column of each family."""
    firsts = {p: prefixed(df, p)[0] for p in families if prefixed(df, p)}
    per = df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("total_count"), *[F.count_if(missing(c)).alias(p) for p, c in firsts.items()]
    )
    return per.unpivot(["month", "total_count"], list(firsts), "family", "null_count")


def usable_range(df: DataFrame, required: Sequence[str] | None = None, ts: str = "timestamp") -> DataFrame:
    """First and last time at which all required columns (default: the bars) have values."""
    columns = [c for c in (required or prefixed(df, "ohlcv_")) if c in df.columns]
    return df.dropna(subset=columns).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def fingerprint(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Version tag: first eight md5 digits of 'first_last_count' with UTC times."""

    def text(c: Column) -> Column:
        fraction = F.date_format(c, ".SSSSSS")
        return F.concat(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00")
        )

    row = df.agg(F.min(ts).alias("a"), F.max(ts).alias("z"), F.count(F.lit(1)).alias("n"))
    joined = F.concat_ws("_", text(F.col("a")), text(F.col("z")), F.col("n").cast("string"))
    return row.select(F.substring(F.md5(joined), 1, 8).alias("fingerprint"), F.col("n").alias("rows"))


def mostly_missing(df: DataFrame, above: float = 50.0) -> DataFrame:
    """Columns of a daily table with more than ``above`` percent nulls."""
    columns = df.columns
    long = df.agg(*[F.round(share_missing(c) * 100, 2).alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "missing_pct"
    )
    return long.filter(F.col("missing_pct") > above)


def leak_probe(daily: DataFrame, series: Series, close: str = "daily_close", lags: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """How often a close equals the close i sessions later."""
    days = series.days()
    same = {f"_s{i}": (F.col(close) == F.lead(close, i).over(days)).cast("long") for i in lags}
    wide = daily.withColumns(same).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in same])
    rows = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"_s{i}").alias("equal_rows")) for i in lags])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def described(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes, exact quartiles and missing values per numeric column."""
    columns = list(columns or numeric_columns(df))
    basics = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
                F.count_if(missing(c)).alias("missing_count"),
                F.round(share_missing(c) * 100, 2).alias("missing_pct"),
            ).alias(c)
            for c in columns
        ]
    ).unpivot([], columns, "column_name", "_s")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    levels = {"q25": ("value", 0.25), "q50": ("value", 0.5), "q75": ("value", 0.75)}
    quartiles = exact_quantiles(long, ["column_name"], levels)
    return basics.select("column_name", "_s.*").join(F.broadcast(quartiles), "column_name")  # one row per column
