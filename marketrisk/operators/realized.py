"""Daily realized measures, moments and range estimators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, ln, root, total
from marketrisk.functions.decay import with_ewm_recursive
from marketrisk.functions.frames import carried, rolling, rolling_std
from marketrisk.series import Series, owned

LN2 = math.log(2)
TRADING_DAYS = 252


def with_lagged_abs(df: DataFrame, series: Series, ret: str = "minute_return") -> DataFrame:
    """Absolute return of the previous minute, for bipower products."""
    return df.withColumn("abs_return_lag", F.lag(F.abs(F.col(ret))).over(series.minutes()))


def variation_aggs(ret: str = "minute_return") -> list[Column]:
    """RV, bipower variation and observation count of one session."""
    r = F.col(ret)
    return [
        total(r * r).alias("RV_daily"),
        F.count(r).alias("n_minutes"),
        (total(F.abs(r) * F.col("abs_return_lag")) * F.lit(math.pi / 2)).alias("BV_daily"),
    ]


def moment_aggs(ret: str = "minute_return") -> list[Column]:
    """Realized skewness, kurtosis and the two semivariances."""
    r = F.col(ret)
    sq = F.sum(r * r)
    return [
        div(F.sum(r * r * r), F.pow(sq, F.lit(1.5))).alias("realized_skew"),
        div(F.sum(r * r * r * r), sq * sq).alias("realized_kurt"),
        total(F.when(r < 0, r * r)).alias("downside_var"),
        total(F.when(r > 0, r * r)).alias("upside_var"),
    ]


def bar_aggs(series: Series) -> list[Column]:
    """First open, highest high, lowest low, last close and volume of one session."""
    at = F.col(series.order)
    return [
        F.min_by("ohlcv_open", at).alias("daily_open"),
        F.max("ohlcv_high").alias("daily_high"),
        F.min("ohlcv_low").alias("daily_low"),
        F.max_by("ohlcv_close", at).alias("daily_close"),
        F.min_by("ohlcv_close", at).alias("first_close"),
        total("ohlcv_volume").alias("daily_volume"),
    ]


def variation_columns() -> dict[str, Column]:
    rv, bv = F.col("RV_daily"), F.col("BV_daily")
    jv = F.greatest(rv - bv, F.lit(0.0))
    return {
        "JV_daily": jv,
        "jump_ratio": div(jv, rv),
        "RVol_daily": root(rv),
        "BVol_daily": root(bv),
        "JVol_daily": root(jv),
        "RVol_annual": root(rv * TRADING_DAYS),
        "log_RV_daily": ln(rv),
    }


def range_columns(
    open_: str = "daily_open", high: str = "daily_high", low: str = "daily_low", close: str = "daily_close"
) -> dict[str, Column]:
    """Parkinson, Garman-Klass and Rogers-Satchell variances and the normalized range."""
    hl = ln(div(high, low))
    return {
        "parkinson_var": hl * hl / (4 * LN2),
        "garman_klass_var": 0.5 * hl * hl - (2 * LN2 - 1) * ln(div(close, open_)) * ln(div(close, open_)),
        "rogers_satchell_var": ln(div(high, close)) * ln(div(high, open_)) + ln(div(low, close)) * ln(div(low, open_)),
        "daily_range": div(F.col(high) - F.col(low), close),
    }


def overnight_gap(series: Series, open_: str = "daily_open", close: str = "daily_close") -> Column:
    return ln(div(F.col(open_), F.lag(close).over(series.days())))


def daily_measures(minutes: DataFrame, series: Series, ret: str = "minute_return") -> DataFrame:
    """Everything one session yields, in a single aggregation of the minute table.

    Expects minute returns; look-back copies are used for the bipower lag and then dropped.
    """
    rows = owned(with_lagged_abs(minutes, series, ret), series)
    daily = rows.groupBy(*series.by_session).agg(
        *variation_aggs(ret), *moment_aggs(ret), *bar_aggs(series), total(ret).alias("daily_return_sum")
    )
    daily = daily.withColumns(
        {
            **variation_columns(),
            **range_columns(),
            "variance_ratio": div("downside_var", "upside_var"),
            "daily_return": div("daily_close", "first_close") - 1,
        }
    ).drop("first_close")
    return daily.withColumn("overnight_gap", overnight_gap(series))


def sample_moments(minutes: DataFrame, series: Series, ret: str = "minute_return", least_rows: int = 10) -> DataFrame:
    """Population skewness and excess kurtosis of the returns, for sessions of more than ``least_rows`` rows."""
    long_enough = F.count(F.lit(1)) > least_rows
    return minutes.groupBy(*series.by_session).agg(
        F.when(long_enough, F.skewness(ret)).alias("realized_skewness"),
        F.when(long_enough, F.kurtosis(ret)).alias("realized_kurtosis"),
    )


def yang_zhang(daily: DataFrame, series: Series, window: int = 20) -> DataFrame:
    """Volatility from overnight, open-to-close and Rogers-Satchell variances."""
    k = 0.34 / (1 + (window + 1) / (window - 1))
    days = series.days()
    parts = daily.withColumns(
        {
            "_co": overnight_gap(series),
            "_oc": ln(div("daily_close", "daily_open")),
            "_rs": range_columns()["rogers_satchell_var"],
        }
    )
    var = {c: rolling(F.var_samp, c, days, window) for c in ("_co", "_oc", "_rs")}
    return parts.withColumn("yang_zhang_vol", root(var["_co"] + k * var["_oc"] + (1 - k) * var["_rs"])).drop(
        "_co", "_oc", "_rs"
    )


def close_to_close(daily: DataFrame, series: Series, window: int = 20) -> DataFrame:
    """Annualized deviation of daily log returns."""
    days = series.days()
    step = ln(div(F.col("daily_close"), F.lag("daily_close").over(days)))
    return (
        daily.withColumn("_r", step)
        .withColumn("close_to_close_vol", rolling_std("_r", days, window) * math.sqrt(TRADING_DAYS))
        .drop("_r")
    )


def smoothed_variance(daily: DataFrame, series: Series, keep: float = 0.94, rv: str = "RV_daily") -> DataFrame:
    """Recursive average of RV (gaps carried forward) and the ratio of RV to it."""
    filled = daily.withColumn("_rv", carried(rv, series.days()))
    out = with_ewm_recursive(filled, {"ewma_rv": ("_rv", 1 - keep)}, series)
    return out.withColumn("volatility_ratio", div(rv, "ewma_rv")).drop("_rv")


def volume_measures(minutes: DataFrame, series: Series) -> DataFrame:
    """Log dollar volume and the deviation of log volume inside a session."""
    return minutes.groupBy(*series.by_session).agg(
        ln(1 + total(F.col("ohlcv_close") * F.col("ohlcv_volume"))).alias("dollar_volume"),
        F.stddev_samp(ln(1 + F.col("ohlcv_volume"))).alias("volume_volatility"),
    )


def daily_dollar_volume(close: str = "daily_close", volume: str = "daily_volume") -> Column:
    """Log dollar volume when only daily bars exist."""
    return ln(1 + F.col(close) * F.col(volume))
