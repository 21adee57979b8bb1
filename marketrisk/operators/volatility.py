"""Volatility features (``vr_``) of the daily table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import EPS, div, flag, ln, root
from marketrisk.functions.decay import with_ewm_mean, with_ewm_std
from marketrisk.functions.frames import (
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_quantile,
    rolling_std,
    with_expanding,
)
from marketrisk.series import Series

WINDOWS = (5, 10, 20, 60)


def with_transforms(daily: DataFrame, series: Series, point_in_time: bool = True) -> DataFrame:
    """Logs, roots, ratios, pass-through moments and the jump flag.

    The jump flag compares JV with the 95 % quantile of RV, of the days so far by default
    or of the whole history with ``point_in_time=False``.
    """
    rv, bv, jv = F.col("RV_daily"), F.col("BV_daily"), F.col("JV_daily")
    if point_in_time:
        daily = with_expanding(daily, series, {"_q95": ("RV_daily", 0.95)})
    else:
        daily = daily.withColumn("_q95", F.percentile(rv, F.lit(0.95)).over(series.whole()))
    return daily.withColumns(
        {
            "vr_log_rv": ln(rv),
            "vr_log_bv": ln(bv),
            "vr_log_jv": ln(jv + EPS),
            "vr_rvol": root(rv),
            "vr_bvol": root(bv),
            "vr_jvol": root(jv),
            "vr_jump_ratio": div(jv, rv + EPS),
            "vr_jump_flag": flag(jv > F.col("_q95")),
            "vr_continuous_ratio": div(bv, rv + EPS),
            "vr_updown_ratio": div("upside_var", F.col("downside_var") + EPS),
            "vr_skew": F.col("realized_skew"),
            "vr_kurt": F.col("realized_kurt"),
        }
    ).drop("_q95")


def with_decayed(daily: DataFrame, series: Series, alpha: float = 0.06) -> DataFrame:
    """Decayed mean of RV and log RV and decayed deviation of RV."""
    out = with_ewm_mean(daily, {"vr_ewma_rv": ("RV_daily", alpha), "vr_ewma_log_rv": ("vr_log_rv", alpha)}, series)
    return with_ewm_std(out, {"vr_ewma_std": ("RV_daily", alpha)}, series)


def with_rolling(daily: DataFrame, series: Series, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Rolling mean, deviation, maximum and minimum of RV (at least half a window)."""
    days, made = series.days(), {}
    for w in windows:
        half = max(1, w // 2)
        made[f"vr_rv_ma{w}"] = rolling_mean("RV_daily", days, w, half)
        made[f"vr_rv_std{w}"] = rolling_std("RV_daily", days, w, half)
        made[f"vr_rv_max{w}"] = rolling_max("RV_daily", days, w, half)
        made[f"vr_rv_min{w}"] = rolling_min("RV_daily", days, w, half)
    return daily.withColumns(made)


def with_regimes(daily: DataFrame, series: Series) -> DataFrame:
    """High / low volatility against the rolling upper and lower quartile."""
    days, rv = series.days(), F.col("RV_daily")
    upper = rolling_quantile("RV_daily", 0.75, days, 60, 30)
    lower = rolling_quantile("RV_daily", 0.25, days, 60, 30)
    return daily.withColumns({"vr_high_vol_regime": flag(rv > upper), "vr_low_vol_regime": flag(rv < lower)})


def with_term_structure(daily: DataFrame) -> DataFrame:
    return daily.withColumns(
        {
            "vr_term_structure_5_20": div("vr_rv_ma5", "vr_rv_ma20"),
            "vr_term_structure_10_60": div("vr_rv_ma10", "vr_rv_ma60"),
        }
    )


def volatility_features(daily: DataFrame, series: Series, point_in_time: bool = True) -> DataFrame:
    """The whole family."""
    out = with_transforms(daily, series, point_in_time)
    out = with_rolling(with_decayed(out, series), series)
    return with_term_structure(with_regimes(out, series))


