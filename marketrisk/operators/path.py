"""Path features (``path_``): how a session and the days before it moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import EPS, div, ln, of_type, prefixed, total, yes
from marketrisk.functions.decay import STEP, numbered
from marketrisk.functions.frames import (
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_slope,
    rolling_std,
    rolling_sum,
)
from marketrisk.operators.joins import left_without_overlap
from marketrisk.series import Series, owned

LAST_MINUTES = (30, 60, 120)
DAY_WINDOWS = (5, 10, 20)


def with_sign_flips(minutes: DataFrame, series: Series, ret: str = "minute_return") -> DataFrame:
    """1 where the sign of the return differs from the previous one (both known)."""
    sign = F.signum(F.col(ret))
    return minutes.withColumn("_flip", yes(sign != F.lag(sign).over(series.minutes())))


def intraday_aggs(
    series: Series, size: str = "session_rows", ret: str = "minute_return", last: Sequence[int] = LAST_MINUTES
) -> list[Column]:
    """Last-n-minutes aggregates, time of high and low, efficiency, flips and drawdown."""
    at, r, close, volume = F.col(series.order), F.col(ret), F.col("ohlcv_close"), F.col("ohlcv_volume")
    out = []
    for n in last:
        late = at > F.col(size) - n
        late_close = F.when(late, close)
        out += [
            total(F.when(late, r)).alias(f"path_last_{n}min_return"),
            F.stddev_samp(F.when(late, r)).alias(f"path_last_{n}min_vol"),
            (div(F.max(late_close), F.min(late_close)) - 1).alias(f"path_last_{n}min_range"),
            div(total(F.when(late, volume)), total(volume)).alias(f"path_last_{n}min_vol_pct"),
        ]
    rows = F.count(F.lit(1))
    first_high = F.max(F.struct(F.col("ohlcv_high"), (-at).alias("before")))["before"]
    first_low = F.min(F.struct(F.col("ohlcv_low"), at.alias("after")))["after"]
    out += [
        div(-first_high - 1, rows).alias("path_high_time_pct"),
        div(first_low - 1, rows).alias("path_low_time_pct"),
        div(total(r), total(F.abs(r)) + EPS).alias("path_path_efficiency"),
        F.sum("_flip").alias("path_direction_changes"),
        div(F.max(close) - F.min(close), F.max(close)).alias("path_intraday_drawdown"),
    ]
    return out


def intraday_path(
    minutes: DataFrame, series: Series, size: str = "session_rows", last: Sequence[int] = LAST_MINUTES
) -> DataFrame:
    """One row per session; expects minute returns and positions with session sizes."""
    rows = owned(with_sign_flips(minutes, series), series)
    return rows.groupBy(*series.by_session).agg(*intraday_aggs(series, size, last=last))


def with_gaps(daily: DataFrame, series: Series) -> DataFrame:
    """Overnight gap with its size, direction and rolling statistics."""
    days = series.days()
    before = F.lag("daily_close").over(days)
    known = F.col("overnight_gap") if "overnight_gap" in daily.columns else F.lit(None).cast("double")
    out = daily.withColumn("path_gap", F.coalesce(known, ln(div("daily_open", before))))
    gap = F.col("path_gap")
    return out.withColumns(
        {
            "path_gap_abs": F.abs(gap),
            "path_gap_direction": F.signum(gap),
            "path_gap_ma5": rolling_mean(gap, days, 5, 1),
            "path_gap_vol20": rolling_std(gap, days, 20, 5),
            "path_gap_pct": div(gap, F.abs(before) + EPS),
            "path_gap_cum5": rolling_sum(gap, days, 5, 1),
        }
    )


def true_range(series: Series) -> Column:
    """Largest of high-low and the distances of high and low from the previous close."""
    high, low, before = F.col("daily_high"), F.col("daily_low"), F.lag("daily_close").over(series.days())
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def with_ranges(daily: DataFrame, series: Series) -> DataFrame:
    """True range, normalized and log range, close position, body and shadows."""
    o, h, l, c = (F.col(f"daily_{k}") for k in ("open", "high", "low", "close"))
    span = h - l + EPS
    return daily.withColumns(
        {
            "path_true_range": true_range(series),
            "path_range_pct": div(h - l, c),
            "path_log_range": ln(div(h, l)),
            "path_close_position": div(c - l, span),
            "path_body_ratio": div(F.abs(c - o), span),
            "path_upper_shadow": div(h - F.greatest(o, c), span),
            "path_lower_shadow": div(F.least(o, c) - l, span),
        }
    )


def with_cumulative(daily: DataFrame, series: Series, windows: Sequence[int] = DAY_WINDOWS) -> DataFrame:
    """Cumulative, best and worst return and number of positive days."""
    days, made = series.days(), {}
    rose = F.when(F.col("daily_return").isNotNull(), (F.col("daily_return") > 0).cast("int"))
    for w in windows:
        made[f"path_cum_ret_{w}d"] = rolling_sum("daily_return", days, w, 1)
        made[f"path_max_ret_{w}d"] = rolling_max("daily_return", days, w, 1)
        made[f"path_min_ret_{w}d"] = rolling_min("daily_return", days, w, 1)
        made[f"path_pos_days_{w}d"] = rolling_sum(rose, days, w, 1)
    return daily.withColumns(made)


def with_momentum(daily: DataFrame, series: Series) -> DataFrame:
    """Momentum, rate of change, distance from 20-day extremes and the 20-day slope."""
    days, close = series.days(), F.col("daily_close")
    back = lambda n: F.lag("daily_close", n).over(days)
    out = numbered(daily, series)
    return out.withColumns(
        {
            "path_momentum_5d": div(close, back(5)) - 1,
            "path_momentum_20d": div(close, back(20)) - 1,
            "path_roc_10d": (close - back(10)) / 10,
            "path_dist_from_high20": div(close, rolling_max("daily_high", days, 20, 5)) - 1,
            "path_dist_from_low20": div(close, rolling_min("daily_low", days, 20, 5)) - 1,
            "path_trend_strength_20d": rolling_slope("daily_close", STEP, days, 20, 5),
        }
    ).drop(STEP)


def path_features(minutes: DataFrame, daily: DataFrame, series: Series, size: str = "session_rows") -> DataFrame:
    """The whole family on the daily table."""
    out = left_without_overlap(daily, intraday_path(minutes, series, size), series.by_session)
    out = with_ranges(with_gaps(out, series), series)
    return with_momentum(with_cumulative(out, series), series)


def infinite_audit(df: DataFrame, prefix: str = "path_") -> DataFrame:
    """Number of infinite and NaN values per floating column."""
    from pyspark.sql import types as T

    floats = [c for c in prefixed(df, prefix) if c in set(of_type(df, T.DoubleType, T.FloatType))]
    infinite = lambda c: F.abs(F.col(c)) == F.lit(float("inf"))
    wide = df.agg(
        *[F.struct(F.count_if(infinite(c)).alias("inf"), F.count_if(F.isnan(c)).alias("nan")).alias(c) for c in floats]
    )
    long = wide.unpivot([], floats, "column_name", "found")
    return long.select("column_name", F.col("found.inf").alias("infinite"), F.col("found.nan").alias("not_a_number"))
