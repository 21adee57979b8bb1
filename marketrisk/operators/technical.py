"""Technical indicators on daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div
from marketrisk.functions.decay import STEP, numbered, with_ewm_recursive
from marketrisk.functions.frames import (
    at_least,
    last,
    percent_rank_in,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_std,
    rolling_sum,
    so_far,
)
from marketrisk.operators.path import true_range
from marketrisk.series import Series

CLOSE, HIGH, LOW, VOLUME = "daily_close", "daily_high", "daily_low", "daily_volume"


def _change(series: Series, column: str, n: int = 1) -> Column:
    return F.col(column) - F.lag(column, n).over(series.days())


def _oscillator(ratio: Column) -> Column:
    """100 - 100 / (1 + ratio)."""
    return 100 - div(F.lit(100.0), 1 + ratio)


def rsi(daily: DataFrame, series: Series, period: int = 14) -> DataFrame:
    """Relative strength with simple means; a first row without a change counts as zero."""
    days, step = series.days(), _change(series, CLOSE)
    moves = daily.withColumns({"_up": F.when(step > 0, step).otherwise(0.0), "_down": F.when(step < 0, -step).otherwise(0.0)})
    strength = div(rolling_mean("_up", days, period), rolling_mean("_down", days, period))
    return moves.withColumn("rsi", _oscillator(strength)).drop("_up", "_down")


def macd(daily: DataFrame, series: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two recursive averages, its own average and the histogram."""
    rate = lambda span: 2 / (span + 1)
    out = with_ewm_recursive(daily, {"_fast": (CLOSE, rate(fast)), "_slow": (CLOSE, rate(slow))}, series)
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = with_ewm_recursive(out, {"macd_signal": ("macd", rate(signal))}, series)
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def bollinger(daily: DataFrame, series: Series, window: int = 20, width: float = 2.0) -> DataFrame:
    """Bands around the rolling mean and the close's position between them."""
    days = series.days()
    middle, spread = rolling_mean(CLOSE, days, window), rolling_std(CLOSE, days, window)
    return daily.withColumns(
        {
            "bb_upper": middle + spread * width,
            "bb_lower": middle - spread * width,
            "bb_middle": middle,
            "bollinger_position": div(F.col(CLOSE) - (middle - spread * width), spread * (2 * width)),
        }
    )


def momentum(daily: DataFrame, series: Series) -> DataFrame:
    """Momentum 10 / 20, rate of change 10 and Williams %R 14."""
    days = series.days()
    high, low = rolling_max(HIGH, days, 14), rolling_min(LOW, days, 14)
    return daily.withColumns(
        {
            "momentum_10": _change(series, CLOSE, 10),
            "momentum_20": _change(series, CLOSE, 20),
            "roc_10": div(_change(series, CLOSE, 10), F.lag(CLOSE, 10).over(days)) * 100,
            "williams_r": div((high - F.col(CLOSE)) * -100, high - low),
        }
    )


def stochastic(daily: DataFrame, series: Series, k: int = 14, d: int = 3) -> DataFrame:
    """%K inside the k-day range and its d-day mean."""
    days = series.days()
    low, high = rolling_min(LOW, days, k), rolling_max(HIGH, days, k)
    out = daily.withColumn("stochastic_k", div((F.col(CLOSE) - low) * 100, high - low))
    return out.withColumn("stochastic_d", rolling_mean("stochastic_k", days, d))


def moving_averages(
    daily: DataFrame,
    series: Series,
    simple: Sequence[int] = (5, 10, 20, 50, 100, 200),
    exponential: Sequence[int] = (12, 26, 50),
) -> DataFrame:
    """Simple averages with the price relative to them, and recursive averages."""
    days, made = series.days(), {}
    for n in simple:
        average = rolling_mean(CLOSE, days, n)
        made[f"sma_{n}"] = average
        made[f"price_to_sma_{n}"] = div(CLOSE, average)
    return with_ewm_recursive(daily.withColumns(made), {f"ema_{n}": (CLOSE, 2 / (n + 1)) for n in exponential}, series)


def volume_indicators(daily: DataFrame, series: Series) -> DataFrame:
    """On-balance volume, money flow index, volume rate of change, accumulation line."""
    days = series.days()
    close, high, low, volume = (F.col(c) for c in (CLOSE, HIGH, LOW, VOLUME))
    typical = (high + low + close) / 3
    out = daily.withColumns({"_typical": typical, "_signed": F.coalesce(F.signum(_change(series, CLOSE)) * volume, F.lit(0.0))})
    tp, before = F.col("_typical"), F.lag("_typical").over(days)
    out = out.withColumns(
        {
            "obv": F.sum("_signed").over(so_far(days)),
            "_in": F.when(tp > before, tp * volume).otherwise(0.0),
            "_out": F.when(tp < before, tp * volume).otherwise(0.0),
            "_clv": div((close - low) - (high - close), high - low) * volume,
        }
    )
    flow = div(rolling_sum("_in", days, 14), rolling_sum("_out", days, 14))
    return out.withColumns(
        {
            "obv_ratio": div("obv", rolling_mean("obv", days, 20)),
            "mfi": _oscillator(flow),
            "volume_roc": div(_change(series, VOLUME, 10), F.lag(VOLUME, 10).over(days)) * 100,
            "ad_line": F.sum("_clv").over(so_far(days)),
        }
    ).drop("_typical", "_signed", "_in", "_out", "_clv")


def average_true_range(daily: DataFrame, series: Series, period: int = 14) -> DataFrame:
    out = daily.withColumn("_tr", true_range(series))
    out = out.withColumn("atr", rolling_mean("_tr", series.days(), period)).drop("_tr")
    return out.withColumn("atr_percent", div("atr", CLOSE) * 100)


def directional_index(daily: DataFrame, series: Series, period: int = 14) -> DataFrame:
    """ADX with both directional indicators, from clipped moves and simple means."""
    days = series.days()
    clipped = lambda c: F.when(c < 0, 0.0).otherwise(c)
    out = daily.withColumns(
        {"_up": clipped(_change(series, HIGH)), "_down": clipped(-_change(series, LOW)), "_tr": true_range(series)}
    )
    average = lambda c: rolling_mean(c, days, period)
    out = out.withColumns({"plus_di": div(average("_up"), average("_tr")) * 100, "minus_di": div(average("_down"), average("_tr")) * 100})
    plus, minus = F.col("plus_di"), F.col("minus_di")
    out = out.withColumn("_dx", div(F.abs(plus - minus) * 100, plus + minus))
    return out.withColumn("adx", average("_dx")).drop("_up", "_down", "_tr", "_dx")


def support_resistance(daily: DataFrame, series: Series, window: int = 20) -> DataFrame:
    days, close = series.days(), F.col(CLOSE)
    top, bottom = rolling_max(HIGH, days, window), rolling_min(LOW, days, window)
    return daily.withColumns(
        {
            "resistance": top,
            "support": bottom,
            "distance_from_resistance": div(top - close, close),
            "distance_from_support": div(close - bottom, close),
        }
    )


def trend_and_regime(daily: DataFrame, series: Series, window: int = 20, history: int = 252) -> DataFrame:
    """Correlation of close with time over the previous rows, and the rank of 20-day volatility."""
    days = series.days()
    previous = days.rowsBetween(-window, -1)
    out = numbered(daily, series)
    trend = at_least(F.corr(F.col(STEP).cast("double"), F.col(CLOSE)).over(previous), CLOSE, previous, window)
    out = out.withColumns({"trend_strength": trend, "_r": div(CLOSE, F.lag(CLOSE).over(days)) - 1})
    out = out.withColumn("_vol", rolling_std("_r", days, window))
    frame = last(days, history)
    return out.withColumn("volatility_regime", percent_rank_in("_vol", frame, history)).drop(STEP, "_r", "_vol")


def technical_features(daily: DataFrame, series: Series) -> DataFrame:
    """All indicators."""
    out = daily
    for family in (
        rsi,
        macd,
        bollinger,
        momentum,
        stochastic,
        moving_averages,
        volume_indicators,
        average_true_range,
        directional_index,
        support_resistance,
        trend_and_regime,
    ):
        out = family(out, series)
    return out


