"""Event flags (``event_``) by calendar rule and market stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, flag, ln, yes
from marketrisk.functions.frames import rolling_quantile, rolling_sum
from marketrisk.series import Series

# Fixed months of quarter ends, earnings seasons and rate meetings.
QUARTER_MONTHS = (3, 6, 9, 12)
EARNINGS_MONTHS = (1, 4, 7, 10)
MEETING_MONTHS = (1, 3, 5, 6, 7, 9, 11, 12)


def third_friday(date: Column) -> Column:
    return (F.weekday(date) == 4) & F.dayofmonth(date).between(15, 21)


def with_expiry_rule(daily: DataFrame, series: Series) -> DataFrame:
    """Add ``is_opx`` by rule where the table has none."""
    if "is_opx" in daily.columns:
        return daily
    return daily.withColumn("is_opx", third_friday(F.col(series.session)))


def nearest(marks: list[Column]) -> Column:
    """1 + index of the first true mark, 0 when none is."""
    out = F.when(marks[0], 1)
    for i, mark in enumerate(marks[1:], start=2):
        out = out.when(mark, i)
    return out.otherwise(0)


def with_expiry_distance(daily: DataFrame, series: Series) -> DataFrame:
    """Sessions to (1..5) and from (1..3) expiry, expiry week, quarterly expiry, index expiry."""
    days, d, opx = series.days(), F.col(series.session), F.col("is_opx")
    ahead = lambda n: F.lead("is_opx", n).over(days)
    behind = lambda n: F.lag("is_opx", n).over(days)
    out = daily.withColumns(
        {
            "event_days_to_opx": nearest([ahead(n) for n in range(1, 6)]),
            "event_days_from_opx": nearest([behind(n) for n in range(1, 4)]),
        }
    )
    return out.withColumns(
        {
            "event_opx_week": flag((F.col("event_days_to_opx") > 0) | (F.col("event_days_from_opx") > 0)),
            "event_quad_witch": yes(opx & F.month(d).isin(*QUARTER_MONTHS)),
            "event_vix_expiry": yes(ahead(2) & (F.weekday(d) == 2)),
        }
    )


def with_rule_events(daily: DataFrame, series: Series) -> DataFrame:
    """Earnings, meetings, data releases and index rebalancing by month and day."""
    d, opx = F.col(series.session), F.col("is_opx")
    month, day = F.month(d), F.dayofmonth(d)
    season = month.isin(*EARNINGS_MONTHS)
    tdom = F.col("time_trading_day_of_month") if "time_trading_day_of_month" in daily.columns else day
    rules = {
        "event_earnings_month": season,
        "event_peak_earnings": season & day.between(15, 31),
        "event_tech_earnings": season & (day > 20),
        "event_pre_earnings": season & (day < 15),
        "event_fomc_week": month.isin(*MEETING_MONTHS) & (F.weekofyear(d) % 6 == 3),
        "event_jackson_hole": (month == 8) & day.between(20, 31),
        "event_nfp_day": (F.weekday(d) == 4) & (day <= 7),
        "event_inflation_data": day.between(10, 15),
        "event_quarter_end_rebal": month.isin(*QUARTER_MONTHS) & (day >= 25),
        "event_month_end_rebal": tdom >= F.dayofmonth(F.last_day(d)) - 3,
        "event_russell_rebal": (month == 6) & (day >= 20),
        "event_sp_rebal": opx & month.isin(*QUARTER_MONTHS),
    }
    return daily.withColumns({name: yes(rule) for name, rule in rules.items()})


def with_stress(daily: DataFrame, series: Series) -> DataFrame:
    """Down days in five, extreme volume, gap day, outside reversal and wide range."""
    days = series.days()
    back = lambda c: F.lag(c).over(days)
    high, low, close, open_ = (F.col(f"daily_{k}") for k in ("high", "low", "close", "open"))
    gap = F.col("overnight_gap") if "overnight_gap" in daily.columns else ln(div(open_, back("daily_close")))
    span = F.col("daily_range") if "daily_range" in daily.columns else div(high - low, close)
    out = daily.withColumn("_span", span)
    made = {
        "event_consecutive_down": rolling_sum(flag(F.col("daily_return") < 0), days, 5, 1),
        "event_gap_day": flag(F.abs(gap) > 0.01),
        "event_reversal_pattern": flag((high > back("daily_high")) & (low < back("daily_low")) & (close < open_)),
        "event_wide_range": flag(F.col("_span") > rolling_quantile("_span", 0.9, days, 20, 10)),
    }
    if "liq_daily_volume" in daily.columns:
        volume = F.col("liq_daily_volume")
        made["event_extreme_volume"] = flag(volume > rolling_quantile(volume, 0.95, days, 60, 30))
    return out.withColumns(made).drop("_span")


def with_combinations(daily: DataFrame) -> DataFrame:
    """Coinciding events and their count."""
    f = lambda name: F.col(f"event_{name}")
    opx = yes(F.col("is_opx"))
    made = {
        "event_earnings_fomc": f("earnings_month") * f("fomc_week"),
        "event_monthend_opx": f("month_end_rebal") * f("opx_week"),
        "event_event_count": f("earnings_month") + f("fomc_week") + f("month_end_rebal") + opx,
    }
    if "event_extreme_volume" in daily.columns:
        made["event_stressed_opx"] = f("extreme_volume") * opx
    return daily.withColumns(made).withColumn("event_multi_event", flag(F.col("event_event_count") >= 2))


def event_features(daily: DataFrame, series: Series) -> DataFrame:
    out = with_expiry_distance(with_expiry_rule(daily, series), series)
    return with_combinations(with_stress(with_rule_events(out, series), series))
