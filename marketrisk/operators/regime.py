"""Regime and memory features (``reg_``) of the daily table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, flag, ln, root, yes
from marketrisk.functions.decay import STEP, numbered, with_ewm_mean
from marketrisk.functions.frames import (
    average_rank,
    percent_rank_in,
    rescaled_range,
    rolling_lag1_corr,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_quantile,
    rolling_sum,
    so_far,
    with_expanding,
)
from marketrisk.series import Series

SPANS = (5, 10, 20, 60)
LAGS = (1, 5, 10, 20)
LONG_WINDOWS = (60, 120, 252)
REGIMES = (0, 1, 2, 3)


def with_decayed(daily: DataFrame, series: Series, spans: Sequence[int] = SPANS) -> DataFrame:
    """Decayed RV, log RV, volatility and volatility of volatility, and ratios of all span pairs."""
    numbers = numbered(daily, series)
    alpha = {s: 2 / (s + 1) for s in spans}
    means = {f"reg_ewma_rv_{s}d": ("RV_daily", alpha[s]) for s in spans}
    means |= {f"reg_ewma_log_rv_{s}d": ("log_RV_daily", alpha[s]) for s in spans}
    out = with_ewm_mean(numbers, means, series)
    surprise = {f"_sq_{s}": F.pow(F.col("RV_daily") - F.col(f"reg_ewma_rv_{s}d"), F.lit(2.0)) for s in spans}
    out = with_ewm_mean(out.withColumns(surprise), {f"_vv_{s}": (f"_sq_{s}", alpha[s]) for s in spans}, series)
    made = {f"reg_ewma_vol_{s}d": root(f"reg_ewma_rv_{s}d") for s in spans}
    made |= {f"reg_vol_of_vol_{s}d": root(f"_vv_{s}") for s in spans}
    made |= {
        f"reg_ewma_ratio_{a}_{b}d": div(f"reg_ewma_rv_{a}d", f"reg_ewma_rv_{b}d") for a, b in combinations(spans, 2)
    }
    return out.withColumns(made).drop(STEP, *surprise, *[f"_vv_{s}" for s in spans])


def quantile_bucket(x: Column, edges: Column, count: int) -> Column:
    """How many of the edges lie below x (bins closed on the right)."""
    above = sum((yes(x > F.get(edges, i)) for i in range(1, count)), yes(x > F.get(edges, 0)))
    return F.when(x.isNotNull(), above)


def with_variance_ratio(
    daily: DataFrame, series: Series, spans: Sequence[int] = SPANS, bins: int = 5, point_in_time: bool = True
) -> DataFrame:
    """RV over yesterday's decayed RV, its log and deviation from one, quintile and yearly rank.

    Quintile edges and ranks use the days so far; ``point_in_time=False`` uses the whole
    history and the whole calendar year.
    """
    days, made = series.days(), {}
    for s in spans:
        ratio = div("RV_daily", F.lag(f"reg_ewma_rv_{s}d").over(days))
        made[f"reg_vr_{s}d"] = ratio
        made[f"reg_log_vr_{s}d"] = ln(ratio)
        made[f"reg_vr_deviation_{s}d"] = F.abs(ratio - 1)
    out = daily.withColumns(made)
    vr, year = F.col("reg_vr_20d"), F.year(F.col(series.session))
    in_year = Window.partitionBy(*series.keys, year)
    levels = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    if point_in_time:
        names = [f"_edge{i}" for i in range(1, bins)]
        out = with_expanding(out, series, {n: ("reg_vr_20d", i / bins) for i, n in enumerate(names, 1)})
        edges = F.when(F.col(names[0]).isNotNull(), F.array(*names))
        frame = so_far(in_year.orderBy(series.session))
        rank = percent_rank_in(vr, frame) * F.count(vr).over(frame)
    else:
        edges = F.percentile(vr, levels).over(series.whole())
        rank = average_rank(vr, in_year)
    return (
        out.withColumns({"_edges": edges, "reg_vr_percentile": rank})
        .withColumn("reg_vr_quintile", quantile_bucket(vr, F.col("_edges"), bins - 1))
        .drop("_edges", *[f"_edge{i}" for i in range(1, bins)])
    )


def with_regimes(daily: DataFrame, series: Series) -> DataFrame:
    """Volatility regime 0-3, trend, jump, mean-reversion and clustering regimes."""
    days, rv = series.days(), F.col("RV_daily")
    out = daily.withColumn("_q", rolling_quantile(rv, (0.25, 0.75, 0.9), days, 252, 126))
    edge = lambda i: F.get(F.col("_q"), i)
    return out.withColumns(
        {
            "reg_vol_regime": F.when(rv > edge(2), 3).when(rv > edge(1), 2).when(rv > edge(0), 1).otherwise(0),
            "reg_vol_trend": yes(F.col("reg_ewma_rv_5d") > F.col("reg_ewma_rv_20d")),
            "reg_jump_regime": flag(F.col("jump_ratio") > 0.1),
            "reg_mean_reversion_regime": flag(F.col("reg_vr_deviation_20d") > 0.5),
            "reg_vol_clustering": rolling_sum(flag(rv > F.col("reg_ewma_rv_20d")), days, 5, 1),
        }
    ).drop("_q")


def with_expiry_regimes(daily: DataFrame) -> DataFrame:
    """Expiry day inside a high-volatility or mean-reverting regime."""
    opx = F.col("is_opx")
    return daily.withColumns(
        {
            "reg_opx_high_vol": flag(opx & (F.col("reg_vol_regime") >= 2)),
            "reg_opx_mean_revert": flag(opx & (F.col("reg_mean_reversion_regime") == 1)),
        }
    )


def with_memory(daily: DataFrame, series: Series, lags: Sequence[int] = LAGS) -> DataFrame:
    """Lags of RV, log RV, return and z-score, RV change, AR(1) residual."""
    days, made = series.days(), {}
    for n in lags:
        back = lambda c: F.lag(c, n).over(days)  # noqa: B023, E731
        made[f"reg_rv_lag_{n}d"] = back("RV_daily")
        made[f"reg_log_rv_lag_{n}d"] = back("log_RV_daily")
        made[f"reg_return_lag_{n}d"] = back("daily_return")
        made[f"reg_z_lag_{n}d"] = back("z_score_next")
        made[f"reg_rv_change_{n}d"] = div("RV_daily", back("RV_daily")) - 1
    made["reg_ar1_residual"] = F.col("log_RV_daily") - 0.8 * F.lag("log_RV_daily", 1).over(days)
    return daily.withColumns(made)


def with_persistence(daily: DataFrame, series: Series) -> DataFrame:
    """Rolling lag-1 autocorrelation and rescaled range of log RV."""
    days = series.days()
    out = daily.withColumn("_before", F.lag("log_RV_daily").over(days))
    return out.withColumns(
        {
            "reg_rolling_autocorr": rolling_lag1_corr("log_RV_daily", "_before", days, 60, 30),
            "reg_hurst_proxy": rescaled_range("log_RV_daily", days, 60, 30),
        }
    ).drop("_before")


def with_transitions(daily: DataFrame, series: Series, regimes: Sequence[int] = REGIMES) -> DataFrame:
    """Regime changes, run length, change frequency, quintile stability and directed counts."""
    days, now = series.days(), F.col("reg_vol_regime")
    out = daily.withColumns(
        {
            "_was": F.lag("reg_vol_regime").over(days),
            "_same_bin": flag(F.col("reg_vr_quintile") == F.lag("reg_vr_quintile").over(days)),
        }
    )
    out = out.withColumn("reg_regime_change", flag(now != F.col("_was")))
    out = out.withColumn("_island", F.sum(F.coalesce("reg_regime_change", F.lit(0))).over(so_far(days)))
    run = Window.partitionBy(*series.keys, "_island").orderBy(series.session)
    made = {
        "reg_regime_duration": F.row_number().over(run),
        "reg_transition_frequency": rolling_sum("reg_regime_change", days, 60, 30),
        "reg_vr_stability": rolling_sum("_same_bin", days, 5, 1),
    }
    for a in regimes:
        for b in regimes:
            if a != b:
                moved = flag((F.col("_was") == a) & (now == b))
                made[f"reg_trans_{a}_to_{b}"] = rolling_sum(moved, days, 60, 30)
    return out.withColumns(made).drop("_was", "_same_bin", "_island")


def with_long_memory(daily: DataFrame, series: Series, windows: Sequence[int] = LONG_WINDOWS) -> DataFrame:
    """Long averages of RV and distance from them, summed log changes, one-year extremes."""
    days, rv = series.days(), F.col("RV_daily")
    out = daily.withColumn("_step_log", F.col("log_RV_daily") - F.lag("log_RV_daily").over(days))
    made = {}
    for w in windows:
        average = rolling_mean(rv, days, w, w // 2)
        made[f"reg_rv_lta_{w}d"] = average
        made[f"reg_rv_vs_lta_{w}d"] = div(rv, average) - 1
        made[f"reg_frac_diff_{w}d"] = rolling_sum("_step_log", days, w, w // 2)
    top, bottom = rolling_max(rv, days, 252, 126), rolling_min(rv, days, 252, 126)
    made |= {
        "reg_dist_from_52w_high": div(rv, top),
        "reg_dist_from_52w_low": div(rv, bottom),
        "reg_new_52w_high": flag(rv == top),
        "reg_new_52w_low": flag(rv == bottom),
    }
    return out.withColumns(made).drop("_step_log")


def regime_features(daily: DataFrame, series: Series, point_in_time: bool = True) -> DataFrame:
    """The whole family; needs RV, returns and next-day z-scores."""
    out = with_variance_ratio(with_decayed(daily, series), series, point_in_time=point_in_time)
    out = with_regimes(out, series)
    if "is_opx" in out.columns:
        out = with_expiry_regimes(out)
    out = with_persistence(with_memory(out, series), series)
    return with_long_memory(with_transitions(out, series), series)
