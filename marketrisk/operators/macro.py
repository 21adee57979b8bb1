"""Macro (``macro_``) and calendar (``time_``) features of the daily table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, flag, yes
from marketrisk.functions.decay import STEP, numbered
from marketrisk.functions.frames import last, percent_rank_in, rolling_mean, rolling_quantile, rolling_slope
from marketrisk.operators.joins import as_of_left, released
from marketrisk.series import Series

SERIES_NAMES = ("umcsi", "us_policy_uncertainty", "cboe_VIXCLS")
RELEASE_LAG = 3
CHANGE_SPAN = 20


def session_macro(minutes: DataFrame, series: Series, names: Sequence[str] = SERIES_NAMES) -> DataFrame:
    """Last known value of each macro column per session."""
    at = F.col(series.order)
    return minutes.groupBy(*series.by_session).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in names]
    )


def released_as_of(
    daily: DataFrame, values: DataFrame, stamp: str, names: Sequence[str], series: Series, business_days: int = RELEASE_LAG
) -> DataFrame:
    """As-of join of a release table: a value is visible from its stamp plus business days."""
    known = values.withColumn("_released", released(values, stamp, business_days))
    return as_of_left(daily, known, series.session, "_released", names, series.keys, tie_break=stamp)


def with_lagged(daily: DataFrame, series: Series, names: Sequence[str] = SERIES_NAMES, lag: int = RELEASE_LAG) -> DataFrame:
    """Level lagged by the release delay, and its 20-day change and percentage change."""
    days, made = series.days(), {}
    for c in names:
        now, before = F.lag(c, lag).over(days), F.lag(c, lag + CHANGE_SPAN).over(days)
        made[f"macro_{c}_lagged"] = now
        made[f"macro_{c}_change_20d"] = now - before
        made[f"macro_{c}_pct_change_20d"] = div(now, before) - 1
    return daily.withColumns(made)


def with_macro_signals(daily: DataFrame, series: Series) -> DataFrame:
    """Volatility-index, sentiment and uncertainty signals from the lagged levels."""
    days = series.days()
    vix, mood, doubt = "macro_cboe_VIXCLS_lagged", "macro_umcsi_lagged", "macro_us_policy_uncertainty_lagged"
    out = numbered(daily, series)
    return out.withColumns(
        {
            "macro_vix_term_structure": div(vix, rolling_mean(vix, days, 20, 10)),
            "macro_high_vix_regime": flag(F.col(vix) > 20),
            "macro_vix_percentile": percent_rank_in(vix, last(days, 252)),
            "macro_sentiment_vs_trend": F.col(mood) - rolling_mean(mood, days, 120, 60),
            "macro_sentiment_momentum": rolling_mean("macro_umcsi_change_20d", days, 60, 30),
            "macro_uncertainty_spike": flag(F.col(doubt) > rolling_quantile(doubt, 0.8, days, 252, 126)),
            "macro_uncertainty_trend": rolling_slope(doubt, STEP, days, 60, 30),
        }
    ).drop(STEP)


def month_of(series: Series) -> Column:
    return F.trunc(F.col(series.session), "month")


def with_date_parts(daily: DataFrame, series: Series) -> DataFrame:
    """Weekday (0 = Monday), day, week, month, quarter, year and trading-day counts."""
    d = F.col(series.session)
    in_month = Window.partitionBy(*series.keys, month_of(series)).orderBy(d)
    in_year = Window.partitionBy(*series.keys, F.year(d)).orderBy(d)
    return daily.withColumns(
        {
            "time_day_of_week": F.weekday(d),
            "time_day_of_month": F.dayofmonth(d),
            "time_week_of_year": F.weekofyear(d),
            "time_month": F.month(d),
            "time_quarter": F.quarter(d),
            "time_year": F.year(d),
            "time_trading_day_of_month": F.row_number().over(in_month),
            "time_trading_day_of_year": F.row_number().over(in_year),
        }
    )


def with_holiday_distance(daily: DataFrame, series: Series, holiday: str = "is_holiday") -> DataFrame:
    """Trading days since the last and until the next holiday session (1 = neighbour)."""
    days = series.days()
    out = numbered(daily, series)
    mark = F.when(F.col(holiday), F.col(STEP))
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    after = days.rowsBetween(1, Window.unboundedFollowing)
    return out.withColumns(
        {
            "time_days_since_holiday": F.col(STEP) - F.last(mark, ignorenulls=True).over(before),
            "time_days_until_holiday": F.first(mark, ignorenulls=True).over(after) - F.col(STEP),
        }
    ).drop(STEP)


def with_seasonality(daily: DataFrame, series: Series) -> DataFrame:
    """Sine / cosine encodings and quarter, month-end, January and December flags."""
    made = {}
    for short, column, period in (
        ("month", "time_month", 12),
        ("dow", "time_day_of_week", 5),
        ("dom", "time_day_of_month", 31),
    ):
        angle = F.lit(2 * math.pi) * F.col(column) / period
        made[f"time_{short}_sin"] = F.sin(angle)
        made[f"time_{short}_cos"] = F.cos(angle)
    whole_month = Window.partitionBy(*series.keys, month_of(series))
    tdom = F.col("time_trading_day_of_month")
    made |= {
        "time_is_q1": flag(F.col("time_quarter") == 1),
        "time_is_q4": flag(F.col("time_quarter") == 4),
        "time_is_month_end": flag(tdom >= F.max(tdom).over(whole_month) - 3),
        "time_is_january": flag(F.col("time_month") == 1),
        "time_is_december": flag(F.col("time_month") == 12),
    }
    return daily.withColumns(made)


def with_calendar_anomalies(daily: DataFrame, series: Series, holiday: str = "is_holiday") -> DataFrame:
    """Weekday, turn-of-month, expiry-week, holiday-neighbour and season flags."""
    days = series.days()
    whole_month = Window.partitionBy(*series.keys, month_of(series))
    tdom, month, dow = F.col("time_trading_day_of_month"), F.col("time_month"), F.col("time_day_of_week")
    return daily.withColumns(
        {
            "time_is_monday": flag(dow == 0),
            "time_is_friday": flag(dow == 4),
            "time_turn_of_month": flag((tdom <= 3) | (tdom >= F.max(tdom).over(whole_month) - 2)),
            "time_opex_week": flag((F.col("time_week_of_year") % 4 == 3) & (dow >= 3)),
            "time_pre_holiday": yes(F.lead(holiday).over(days)),
            "time_post_holiday": yes(F.lag(holiday).over(days)),
            "time_is_summer": flag(month.between(5, 8)),
            "time_tax_loss_season": flag(month.between(11, 12)),
        }
    )


def time_features(daily: DataFrame, series: Series, holiday: str = "is_holiday") -> DataFrame:
    out = with_holiday_distance(with_date_parts(daily, series), series, holiday)
    return with_calendar_anomalies(with_seasonality(out, series), series, holiday)


def macro_features(daily: DataFrame, series: Series, names: Sequence[str] = SERIES_NAMES) -> DataFrame:
    return with_macro_signals(with_lagged(daily, series, names), series)
