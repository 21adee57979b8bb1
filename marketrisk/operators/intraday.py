"""Minute returns and statistics inside a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, ln, yes
from marketrisk.functions.frames import rolling_frames, so_far
from marketrisk.functions.ordered import exact_quantiles, running_totals
from marketrisk.series import Series


def with_minute_returns(
    df: DataFrame, series: Series, price: str = "ohlcv_close", log: bool = True, name: str = "minute_return"
) -> DataFrame:
    """Return from the previous minute of the same session; the first minute has none."""
    before = F.lag(price).over(series.minutes())
    change = ln(price) - ln(before) if log else div(F.col(price) - before, before)
    return df.withColumn(name, F.when(F.col(series.order) != 1, change))


def with_return_stats(df: DataFrame, series: Series, ret: str = "minute_return") -> DataFrame:
    """Squared, absolute and signed return plus 30-minute mean and deviation."""
    r = F.col(ret)
    out = df.withColumns(
        {
            f"{ret}_sq": r * r,
            f"{ret}_abs": F.abs(r),
            f"{ret}_sign": F.when(r > 0, 1).when(r < 0, -1).otherwise(0),
        }
    )
    wanted = {f"{ret}_ma30": ("mean", ret, 30, 10), f"{ret}_std30": ("std", ret, 30, 10)}
    return rolling_frames(out, series.minutes(), wanted)


def with_cumulative_return(
    df: DataFrame, series: Series, ret: str = "minute_return", rows_per_bucket: int = 65_536
) -> DataFrame:
    """Sum of the returns so far in the session, null where the return is null.

    Takes rows without look-back copies.  A session of known minutes uses one window; one
    with gap-free positions is summed in two levels.
    """
    if series.block is None:
        cumulative = F.sum(ret).over(so_far(series.minutes()))
        return df.withColumn("session_cumulative_return", F.when(F.col(ret).isNotNull(), cumulative))
    out = running_totals(
        df.withColumn("_r", F.coalesce(ret, F.lit(0.0))),
        series.by_session,
        [F.col(series.order)],
        F.floor((F.col(series.order) - 1) / F.lit(rows_per_bucket)),
        {"session_cumulative_return": "_r"},
    ).drop("_r")
    return out.withColumn(
        "session_cumulative_return", F.when(F.col(ret).isNotNull(), F.col("session_cumulative_return"))
    )


def return_checks(df: DataFrame, series: Series, ret: str = "minute_return", limit: float = 0.1) -> DataFrame:
    """One row: extreme returns and nulls after the first minute."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(yes(F.abs(ret) > limit)).alias("extreme_returns"),
        F.sum(yes((F.col(series.order) > 1) & F.col(ret).isNull())).alias("null_returns"),
    )


def return_summary(df: DataFrame, ret: str = "minute_return") -> DataFrame:
    """One row: mean, deviation, extremes and the 1 % / 99 % quantiles of all returns."""
    moments = df.agg(
        F.avg(ret).alias("mean"),
        F.stddev_samp(ret).alias("std"),
        F.min(ret).alias("min"),
        F.max(ret).alias("max"),
    )
    tails = exact_quantiles(df.select(ret), [], {"q01": (ret, 0.01), "q99": (ret, 0.99)})
    return moments.crossJoin(F.broadcast(tails))  # one row each


def last_hour_return(
    df: DataFrame, series: Series, price: str = "ohlcv_close", size: str = "session_rows", rows: int = 60
) -> DataFrame:
    """ln(last close / ``rows``-th close from the end) for sessions longer than ``rows``."""
    from_end = F.col(size) - F.col(series.order)
    ratio = div(
        F.max(F.when(from_end == 0, F.col(price))), F.max(F.when(from_end == rows - 1, F.col(price)))
    )
    return df.groupBy(*series.by_session).agg(
        F.when(F.first(size) > rows, ln(ratio)).alias("last_hour_return")
    )


def hour_after_open_return(
    df: DataFrame, series: Series, price: str = "ohlcv_close", size: str = "session_rows", rows: int = 60
) -> DataFrame:
    """Return from the first row to the one ``rows`` later for sessions longer than ``rows``."""
    first = F.max(F.when(F.col(series.order) == 1, F.col(price)))
    later = F.max(F.when(F.col(series.order) == rows + 1, F.col(price)))
    return df.groupBy(*series.by_session).agg(
        F.when(F.first(size) > rows, div(later - first, first)).alias("hour_after_open_return")
    )
