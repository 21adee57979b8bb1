"""Liquidity features (``liq_``): volume, dollar volume, price impact and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, ln, root, total
from marketrisk.functions.decay import STEP, numbered
from marketrisk.functions.frames import (
    average_rank,
    rolling_mean,
    rolling_frames,
    rolling_quantile,
    rolling_slope,
    with_expanding,
)
from marketrisk.functions.ordered import join_per_group
from marketrisk.series import Series, owned

WINDOWS = (5, 10, 20, 60)
BUCKETS = 10


#: Trade intensity, for :func:`marketrisk.functions.frames.rolling_frames`.
INTENSITY = {"liq_trade_intensity": ("std", "ohlcv_volume", 30, 10)}


def with_impact(df: DataFrame, ret: str = "minute_return") -> DataFrame:
    """Dollar volume, Amihud ratio, volume rate and a price-impact proxy."""
    volume, r = F.col("ohlcv_volume"), F.abs(F.col(ret))
    dollars = volume * F.col("ohlcv_vwap")
    return df.withColumns(
        {
            "liq_dollar_volume": dollars,
            "liq_log_dollar_volume": ln(dollars + 1),
            "liq_amihud": div(r, dollars + 1),
            "liq_volume_rate": volume,
            "liq_kyle_lambda": div(r, root(volume) + 1),
        }
    )


def with_minute_liquidity(df: DataFrame, series: Series, ret: str = "minute_return") -> DataFrame:
    """Dollar volume, Amihud ratio, volume rate, trade intensity and a price-impact proxy."""
    return rolling_frames(with_impact(df, ret), series.minutes(), INTENSITY)


def daily_aggs() -> list[Column]:
    """Totals, mean impact, Herfindahl index, volume deviation, skew and largest spike."""
    volume, n = F.col("ohlcv_volume"), F.count("ohlcv_volume")
    return [
        total(volume).alias("liq_daily_volume"),
        total("liq_dollar_volume").alias("liq_daily_dollar_volume"),
        ln(total(volume) + 1).alias("liq_log_daily_volume"),
        F.avg("liq_amihud").alias("liq_daily_amihud"),
        F.avg("liq_kyle_lambda").alias("liq_daily_kyle_lambda"),
        div(F.sum(volume * volume), F.sum(volume) * F.sum(volume)).alias("liq_volume_herfindahl"),
        F.stddev_samp(volume).alias("liq_volume_volatility"),
        # third central moment over the cubed *sample* deviation
        F.when(F.stddev_samp(volume) > 0, F.skewness(volume) * F.pow((n - 1) / n, F.lit(1.5))).alias("liq_volume_skew"),
        div(F.max(volume), F.avg(volume)).alias("liq_max_volume_spike"),
    ]


def liquidity_daily(minutes: DataFrame, series: Series) -> DataFrame:
    rows = owned(with_minute_liquidity(minutes, series), series)
    return rows.groupBy(*series.by_session).agg(*daily_aggs())


def volume_profile(
    minutes: DataFrame, series: Series, buckets: int = BUCKETS, session_minutes: int | Column = 390
) -> DataFrame:
    """Volume of the first and last time bucket, the entropy of the bucket shares and the session VWAP of the closes.

    ``session_minutes`` is the sessions' length, a column if it differs between them.

    Two-stage aggregation; the entropy follows from the sums of v and v ln v, so no second
    look at the session total is needed:  -sum (v/V) ln(v/V) = ln V - sum(v ln v) / V.
    """
    at = F.floor((F.col(series.order) - 1) * buckets / session_minutes)
    per_bucket = minutes.groupBy(*series.by_session, at.alias("_bucket")).agg(
        total("ohlcv_volume").alias("_v"),
        F.sum(F.col("ohlcv_close") * F.col("ohlcv_volume")).alias("_cv"),
        F.sum("ohlcv_volume").alias("_known"),
    )
    v = F.col("_v")
    volume = F.sum(v)
    return per_bucket.groupBy(*series.by_session).agg(
        total(F.when(F.col("_bucket") == 0, v)).alias("liq_open_volume"),
        total(F.when(F.col("_bucket") == buckets - 1, v)).alias("liq_close_volume"),
        (ln(volume) - div(total(v * ln(v)), volume)).alias("liq_volume_entropy"),
        div(F.sum("_cv"), F.sum("_known")).alias("liq_daily_vwap"),
    )


def vwap_deviation(minutes: DataFrame, series: Series, profile: DataFrame) -> DataFrame:
    """``profile`` with the mean absolute distance of the closes from its ``liq_daily_vwap``: one more look at the minutes."""
    level = profile.select(*series.by_session, "liq_daily_vwap")
    rows = minutes.select(*series.by_session, series.order, "ohlcv_close")
    away = (
        join_per_group(rows, level, series.by_session, series.order)
        .groupBy(*series.by_session)
        .agg(F.avg(F.abs(F.col("ohlcv_close") - F.col("liq_daily_vwap"))).alias("liq_vwap_deviation"))
    )
    return profile.join(away, series.by_session, "left")


def with_rolling(daily: DataFrame, series: Series, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Rolling volume level and ratio, Amihud, dollar volume and the slope of log volume."""
    days, made = series.days(), {}
    out = numbered(daily, series)
    for w in windows:
        half = max(1, w // 2)
        average = rolling_mean("liq_daily_volume", days, w, half)
        made[f"liq_volume_ma_{w}d"] = average
        made[f"liq_volume_ratio_{w}d"] = div("liq_daily_volume", average)
        made[f"liq_amihud_ma_{w}d"] = rolling_mean("liq_daily_amihud", days, w, half)
        made[f"liq_dollar_volume_ma_{w}d"] = rolling_mean("liq_daily_dollar_volume", days, w, half)
        made[f"liq_volume_trend_{w}d"] = rolling_slope("liq_log_daily_volume", STEP, days, w, max(2, w // 2))
    return out.withColumns(made).drop(STEP)


def with_bucket_ratios(daily: DataFrame) -> DataFrame:
    return daily.withColumns(
        {
            "liq_open_volume_ratio": div("liq_open_volume", "liq_daily_volume"),
            "liq_close_volume_ratio": div("liq_close_volume", "liq_daily_volume"),
        }
    )


def with_relative(daily: DataFrame, series: Series, point_in_time: bool = True) -> DataFrame:
    """Volume percentile (so far, or whole history), abnormal volume and liquidity regime."""
    days, volume, dollars = series.days(), F.col("liq_daily_volume"), F.col("liq_daily_dollar_volume")
    if point_in_time:
        daily = with_expanding(daily, series, {"_rank": ("liq_daily_volume", None)})
    else:
        whole = average_rank(volume, series.whole()) / F.count(F.lit(1)).over(series.whole())
        daily = daily.withColumn("_rank", whole)
    out = daily.withColumn("_ma20", rolling_mean(volume, days, 20, 10))
    third = lambda q: rolling_quantile(dollars, q, days, 60, 30)
    return out.withColumns(
        {
            "liq_volume_percentile": F.when(volume.isNotNull(), F.col("_rank")),
            "liq_abnormal_volume": volume > rolling_quantile("_ma20", 0.95, days, 60, 30),
            "liq_regime": F.when(dollars > third(0.67), 2).when(dollars > third(0.33), 1).otherwise(0),
        }
    ).drop("_ma20", "_rank")


def liquidity_features(
    minutes: DataFrame, daily: DataFrame, series: Series, point_in_time: bool = True
) -> DataFrame:
    """The whole family on the daily table; minutes carry returns."""
    own = owned(minutes, series)
    out = daily
    for part in (liquidity_daily(minutes, series), vwap_deviation(own, series, volume_profile(own, series))):
        out = out.join(part, series.by_session, "left")
    return with_relative(with_bucket_ratios(with_rolling(out, series)), series, point_in_time)


def amihud_20(daily: DataFrame, series: Series, window: int = 20) -> DataFrame:
    """Rolling mean of |return| per dollar traded, times a million, from daily bars."""
    days, close = series.days(), F.col("daily_close")
    change = div(close, F.lag("daily_close").over(days)) - 1
    out = daily.withColumn("_illiquid", div(F.abs(change), F.col("daily_volume") * close) * 1e6)
    return out.withColumn("amihud_illiquidity", rolling_mean("_illiquid", days, window)).drop("_illiquid")


def kyle_lambda(minutes: DataFrame, series: Series, least: int = 10) -> DataFrame:
    """Slope of the minute return on signed volume, for more than ``least`` points."""
    before = F.lag("ohlcv_close").over(series.minutes())
    change = div("ohlcv_close", before) - 1
    rows = owned(minutes.withColumn("_change", change), series)
    signed = F.col("ohlcv_volume") * F.signum("_change")
    return rows.groupBy(*series.by_session).agg(
        F.when(F.count("_change") > least, F.regr_slope(F.col("_change"), signed)).alias("kyle_lambda")
    )
