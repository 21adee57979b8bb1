"""Labels and forward targets of the daily table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import EPS, div, ln, mean_of, root, yes
from marketrisk.functions.decay import with_ewm_mean
from marketrisk.functions.frames import carried, rolling_mean, rolling_std, so_far, with_expanding
from marketrisk.series import Series

GAMMAS = (1.5, 2.0, 2.5, 3.0)
# Upper and lower cut-offs of the next-day return (fixed values).
EXTREME_CRASH, CRASH, MILD_DOWN = -0.03, -0.015, -0.005
MILD_UP, BOOM, EXTREME_BOOM = 0.005, 0.015, 0.03
NEUTRAL_BAND = 0.002
WEEK_BAND = 0.03


def tag(gamma: float) -> str:
    """1.5 -> '1_5', for use in column names."""
    return f"{gamma:g}".replace(".", "_") if gamma % 1 else f"{gamma:.1f}".replace(".", "_")


def with_next_day(daily: DataFrame, series: Series) -> DataFrame:
    days = series.days()
    return daily.withColumns(
        {
            "next_day_return": F.lead("daily_return").over(days),
            "next_day_return_sum": F.lead("daily_return_sum").over(days),
        }
    )


def with_z_score(daily: DataFrame, series: Series, estimator: str = "RV") -> DataFrame:
    """Next-day return over today's volatility (RV, BV or decayed RV), also clipped to +-10."""
    column = {"RV": "RVol_daily", "BV": "BVol_daily", "EWMA": "ewma_vol"}[estimator]
    if estimator == "EWMA":
        daily = with_ewm_mean(daily, {"_e": ("RV_daily", 0.06)}, series).withColumn("ewma_vol", root("_e")).drop("_e")
    z = div("next_day_return", column)
    return daily.withColumns(
        {
            "z_score_next": z,
            "volatility_for_z": F.col(column),
            "z_score_next_clipped": F.when(z.isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z))),
        }
    )


def three_way(z: Column, gamma: float, low, middle, high) -> Column:
    return F.when(z <= -gamma, low).when(z >= gamma, high).otherwise(middle)


def with_labels(daily: DataFrame, gammas: Sequence[float] = GAMMAS, z: str = "z_score_next") -> DataFrame:
    """Crash / normal / boom per gamma as text and 0 / 1 / 2, and distances to the thresholds.

    A missing z-score is labelled normal.
    """
    made, score = {}, F.col(z)
    for g in gammas:
        t = tag(g)
        made[f"label_gamma_{t}"] = three_way(score, g, "crash", "normal", "boom")
        made[f"label_gamma_{t}_numeric"] = three_way(score, g, 0, 1, 2)
        made[f"dist_to_crash_{t}"] = score + g
        made[f"dist_to_boom_{t}"] = score - g
        made[f"min_dist_threshold_{t}"] = F.least(F.abs(score + g), F.abs(score - g))
    return daily.withColumns(made)


def label_distribution(labelled: DataFrame, gammas: Sequence[float] = GAMMAS) -> DataFrame:
    """Count and share of every label at every gamma, in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(float(g)).alias("gamma"), F.col(f"label_gamma_{tag(g)}").alias("label")) for g in gammas])
    )
    counts = labelled.select(pairs.alias("_p")).groupBy("_p.gamma", "_p.label").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("gamma")))


def label_checks(labelled: DataFrame, gammas: Sequence[float] = GAMMAS, z: str = "z_score_next") -> DataFrame:
    """Per gamma: null labels and labels on the wrong side of their threshold."""
    score = F.col(z)
    wide = labelled.agg(
        *[
            F.struct(
                F.count_if(F.col(f"label_gamma_{tag(g)}").isNull()).alias("null_labels"),
                F.count_if((F.col(f"label_gamma_{tag(g)}") == "crash") & (score > -g)).alias("wrong_crash"),
                F.count_if((F.col(f"label_gamma_{tag(g)}") == "boom") & (score < g)).alias("wrong_boom"),
            ).alias(f"{g:g}")
            for g in gammas
        ]
    )
    long = wide.unpivot([], [f"`{g:g}`" for g in gammas], "gamma", "found")
    return long.select(F.col("gamma").cast("double").alias("gamma"), "found.*")


def z_summary(labelled: DataFrame, z: str = "z_score_next") -> DataFrame:
    return labelled.agg(
        F.avg(z).alias("mean"), F.stddev_samp(z).alias("std"), F.min(z).alias("min"), F.max(z).alias("max")
    )


def with_forward_targets(daily: DataFrame, series: Series) -> DataFrame:
    """Log RV one and five days ahead, return one day ahead, summed return of the next five."""
    days = series.days()
    ahead = days.rowsBetween(1, 5)
    return daily.withColumns(
        {
            "target_log_rv_1d": F.lead("log_RV_daily", 1).over(days),
            "target_return_1d": F.lead("daily_return", 1).over(days),
            "target_log_rv_5d": F.lead("log_RV_daily", 5).over(days),
            "target_return_5d": F.when(
                F.count("daily_return").over(ahead) == 5, F.sum("daily_return").over(ahead)
            ),
        }
    )


def with_close_returns(daily: DataFrame, series: Series, close: str = "daily_close") -> DataFrame:
    """Simple and log return from the previous close."""
    before = F.lag(close).over(series.days())
    return daily.withColumns({"close_return": div(close, before) - 1, "log_return": ln(div(close, before))})


def with_blended_volatility(daily: DataFrame, series: Series, lookback: int = 20, default: float = 0.02) -> DataFrame:
    """Mean of rolling deviation, decayed volatility and rolling Parkinson volatility.

    Carried forward over gaps; ``default`` before the first estimate.  Needs ``log_return``,
    ``RV_daily`` and ``parkinson_var``.
    """
    days = series.days()
    out = with_ewm_mean(daily, {"_decayed": ("RV_daily", 0.06)}, series)
    seen = F.count("RV_daily").over(so_far(days))
    blended = mean_of(
        rolling_std("log_return", days, lookback, 10),
        F.when(seen >= 10, root("_decayed")),
        root(rolling_mean("parkinson_var", days, lookback, 10)),
    )
    out = out.withColumn("_blend", blended)
    return out.withColumn("volatility_estimate", F.coalesce(carried("_blend", days), F.lit(default))).drop(
        "_blend", "_decayed"
    )


def with_sigma_labels(daily: DataFrame, series: Series, gamma: float = 1.5) -> DataFrame:
    """Labels from the next log return over the blended volatility, with one-hot columns."""
    ahead = F.lead("log_return").over(series.days())
    out = daily.withColumn("next_log_return", ahead).withColumn(
        "standardized_return", div("next_log_return", "volatility_estimate")
    )
    z = F.col("standardized_return")
    return out.withColumns(
        {
            "crash": yes(z <= -gamma),
            "boom": yes(z >= gamma),
            "normal": yes((z > -gamma) & (z < gamma)),
            "crash_boom_label": three_way(z, gamma, "crash", "normal", "boom"),
        }
    )


def with_log_rv_target(daily: DataFrame, series: Series) -> DataFrame:
    """Next-day log variance: RV when present, else the squared next return."""
    days = series.days()
    if "RV_daily" in daily.columns:
        ahead = F.lead("RV_daily").over(days)
    else:
        ahead = F.pow(F.lead("log_return").over(days), F.lit(2.0))
    return daily.withColumn("rv_next", ahead).withColumn("log_rv_next", ln(F.col("rv_next") + EPS))


def with_quantile_targets(
    daily: DataFrame, series: Series, levels: Sequence[float] = (0.05, 0.5, 0.95), least: int = 20
) -> DataFrame:
    """Return quantiles of the days before, and whether the next return exceeds today's quantile."""
    days = series.days()
    seen = so_far(days)
    known = F.count("log_return").over(seen) >= least
    names = [f"_q{i}" for i in range(len(levels))]
    out = with_expanding(daily, series, {n: ("log_return", q) for n, q in zip(names, levels, strict=True)})
    out = out.withColumn("_q", F.when(known, F.array(*names))).drop(*names)
    ahead = F.lead("log_return").over(days)
    made = {}
    for i, q in enumerate(levels):
        name = int(round(q * 100))
        made[f"quantile_{name}"] = F.get(F.lag("_q").over(days), i)
        made[f"exceeds_q{name}"] = yes(ahead > F.get(F.col("_q"), i))
    return out.withColumns(made).drop("_q")


def seven_way(r: Column) -> Column:
    """Direction class of a return; a missing return is normal."""
    return (
        F.when(r <= EXTREME_CRASH, "extreme_crash")
        .when(r <= CRASH, "crash")
        .when(r <= MILD_DOWN, "mild_down")
        .when(r >= EXTREME_BOOM, "extreme_boom")
        .when(r >= BOOM, "boom")
        .when(r >= MILD_UP, "mild_up")
        .otherwise("normal")
    )


def with_direction_targets(daily: DataFrame, series: Series, close: str = "daily_close") -> DataFrame:
    """Day, week and month returns ahead, direction and outlook classes, extreme-move indicators."""
    days = series.days()
    ahead = lambda n: div(F.lead(close, n).over(days), close) - 1
    out = daily.withColumns(
        {"next_day_return": ahead(1), "next_week_return": ahead(5), "next_month_return": ahead(21)}
    )
    day, week = F.col("next_day_return"), F.col("next_week_return")
    return out.withColumns(
        {
            "market_direction_7class": seven_way(day),
            "direction_3class": F.when(day < -NEUTRAL_BAND, "down").when(day > NEUTRAL_BAND, "up").otherwise("neutral"),
            "week_outlook": F.when(week < -WEEK_BAND, "week_crash")
            .when(week > WEEK_BAND, "week_boom")
            .otherwise("week_normal"),
            "crash_probability_1d": yes(day < CRASH),
            "boom_probability_1d": yes(day > BOOM),
            "crash_probability_1w": yes(week < -WEEK_BAND),
            "boom_probability_1w": yes(week > WEEK_BAND),
        }
    )


def with_volatility_target(daily: DataFrame, series: Series) -> DataFrame:
    """Next-day log RV, or the next day's 20-day return deviation where RV is absent."""
    days = series.days()
    if "RV_daily" in daily.columns:
        return daily.withColumn("volatility_forecast", ln(F.lead("RV_daily").over(days) + EPS))
    out = daily.withColumn("_std", rolling_std("close_return", days, 20))
    return out.withColumn("volatility_forecast", F.lead("_std").over(days)).drop("_std")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise correlations as (first, second, correlation) rows, from one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(b).alias("first"), F.lit(a).alias("second"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(c).alias("first"), F.lit(c).alias("second"), F.lit(1.0).alias("correlation")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def with_known_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(targets))


def without_last_day(daily: DataFrame, series: Series) -> DataFrame:
    """Drop each instrument's last session, which has no next day."""
    return (
        daily.withColumn("_next", F.lead(series.session).over(series.days()))
        .filter(F.col("_next").isNotNull())
        .drop("_next")
    )


def crash_boom_labels(
    daily: DataFrame, series: Series, gammas: Sequence[float] = GAMMAS, estimator: str = "RV"
) -> DataFrame:
    """Next-day returns, z-scores, labels and forward targets."""
    out = with_z_score(with_next_day(daily, series), series, estimator)
    return with_forward_targets(with_labels(out, gammas), series)
