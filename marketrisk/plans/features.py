"""From minute bars to the daily feature table, the model table and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import prefixed, total
from marketrisk.functions.frames import rolling_frames
from marketrisk.functions.lineage import checkpointed
from marketrisk.functions.ordered import WIDE_ACCURACY, sketch_aggs
from marketrisk.heads.classifiers import FEATURES, assembled, elastic_net_logistic, random_forest
from marketrisk.heads.stacking import fit_stack, out_of_fold
from marketrisk.operators import events, folds, impute, intraday, liquidity, macro, metrics, path, realized, regime
from marketrisk.operators import microstructure as quotes
from marketrisk.operators import targets, technical, volatility
from marketrisk.operators.decision import UTILITY, best_thresholds, threshold_grid
from marketrisk.series import Series, owned
from marketrisk.sources.sinks import write_csv, write_features, write_reports

FEATURE_PREFIXES = ("vr_", "iex_", "path_", "liq_", "macro_", "time_", "reg_", "event_")


def minute_columns(minutes: DataFrame, series: Series) -> DataFrame:
    """Every minute-level column the families aggregate, on one partitioning of the minute table.

    The rolling columns of both minute families come last, together: rows are no longer partitioned behind them.
    """
    out = intraday.with_minute_returns(minutes, series)
    out = path.with_sign_flips(realized.with_lagged_abs(out, series), series)
    out = quotes.with_depth(quotes.with_spreads(liquidity.with_impact(out)))
    out = quotes.with_mid_dynamics(out, series)
    return rolling_frames(out, series.minutes(), liquidity.INTENSITY | quotes.rolling_quotes()).drop("_mid_step")


def session_table(
    minutes: DataFrame, series: Series, size: str = "session_rows", bars: DataFrame | None = None
) -> DataFrame:
    """All per-session aggregates in one aggregation, plus the two that need a second look.

    ``bars`` are the same minutes without look-back copies, if they are at hand.
    """
    if "is_last_hour" not in minutes.columns:
        minutes = minutes.withColumn("is_last_hour", F.col(series.order) > F.col(size) - 60)
    rows = owned(minute_columns(minutes, series), series)
    quote_aggs, quantiles = quotes.daily_aggs(prefixed(rows, "iex_"))
    daily = rows.groupBy(*series.by_session).agg(
        *realized.variation_aggs(),
        *realized.moment_aggs(),
        *realized.bar_aggs(series),
        total("minute_return").alias("daily_return_sum"),
        *path.intraday_aggs(series, size),
        *liquidity.daily_aggs(),
        *quote_aggs,
        *quotes.extra_aggs(series),
        *sketch_aggs(quantiles, WIDE_ACCURACY),
    )
    daily = quotes.with_quantiles(daily, rows, series, quantiles)
    bars = owned(minutes, series) if bars is None else bars
    # one row per session: its levels meet the minutes without a shuffle of these
    profile = checkpointed(liquidity.volume_profile(bars, series, session_minutes=F.col(size)))
    daily = daily.join(liquidity.vwap_deviation(bars, series, profile), series.by_session, "left")
    daily = daily.withColumns(
        {
            **realized.variation_columns(),
            **realized.range_columns(),
            "variance_ratio": F.try_divide("downside_var", "upside_var"),
            "daily_return": F.try_divide("daily_close", "first_close") - 1,
        }
    ).drop("first_close")
    return daily.withColumn("overnight_gap", realized.overnight_gap(series))


def daily_features(
    daily: DataFrame,
    series: Series,
    gammas: Sequence[float] = targets.GAMMAS,
    point_in_time: bool = True,
    with_technical: bool = False,
) -> DataFrame:
    """Labels and every feature family from a session table that carries calendar flags.

    Families are computed side by side from the (checkpointed) session table and joined on
    the session, which keeps each plan small; all of them are calendar-sized.
    """
    base = targets.crash_boom_labels(daily, series, gammas)
    bars = [f"daily_{k}" for k in ("open", "high", "low", "close", "volume", "return", "range")] + ["overnight_gap"]

    def slim(*columns: str) -> DataFrame:
        """Only what a family reads, so that its windows carry narrow rows."""
        return base.select(*series.by_session, *[c for c in columns if c in base.columns])

    moves = path.with_cumulative(path.with_ranges(path.with_gaps(slim(*bars), series), series), series)
    volumes = liquidity.with_bucket_ratios(liquidity.with_rolling(slim(*prefixed(base, "liq_")), series))
    variation = ["RV_daily", "BV_daily", "JV_daily", "upside_var", "downside_var", "realized_skew", "realized_kurt"]
    memory = ["RV_daily", "log_RV_daily", "daily_return", "z_score_next", "jump_ratio", "is_opx"]
    dated = macro.with_date_parts(slim(*bars, "liq_daily_volume", "is_opx"), series)
    families = [
        volatility.volatility_features(slim(*variation), series, point_in_time),
        quotes.filled(slim(*prefixed(base, "iex_")), series),
        path.with_momentum(moves, series),
        liquidity.with_relative(volumes, series, point_in_time),
        macro.time_features(slim("is_holiday"), series),
        regime.regime_features(slim(*memory), series, point_in_time),
        events.event_features(dated, series),
    ]
    if set(macro.SERIES_NAMES) <= set(base.columns):
        families.append(macro.macro_features(slim(*macro.SERIES_NAMES), series))
    if with_technical:
        families.append(technical.technical_features(slim(*bars), series))
    out = base.drop(*prefixed(base, "iex_"))
    for family in families:
        added = [c for c in family.columns if c not in out.columns]
        out = out.join(family.select(*series.by_session, *added), series.by_session, "left")
    return out


def model_table(features: DataFrame, label: str, first_test: str | None = None) -> DataFrame:
    """Rows with known targets, typed null fill (medians of the rows before ``first_test``), one vector."""
    known = targets.with_known_targets(features, [label, "target_log_rv_1d", "target_return_1d"])
    columns = prefixed(known, FEATURE_PREFIXES)
    fit_on = known.filter(F.col("session_date") < F.lit(first_test).cast("date")) if first_test else None
    filled = impute.typed_fill(known, columns, fit_on)
    numbers = filled.withColumns({c: F.col(c).cast("double") for c in columns})
    return assembled(numbers, columns).withColumn("label", F.col(label).cast("double"))


def classify_and_report(
    table: DataFrame, plan: folds.WalkForward, label: str, series: Series, bases=None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Out-of-fold stacked probabilities and the report tables made from them.

    Thresholds are tuned on the out-of-fold rows of the base models, never on rows a model saw.
    """
    bases = bases or {"forest": random_forest, "elastic_net": elastic_net_logistic}
    rows = checkpointed(
        folds.assigned(table.select(*series.by_session, "label", label, FEATURES), folds.fold_table(table, plan))
    )
    numbers = list(range(1, plan.n_splits + 1))
    weigh = lambda df: folds.with_utility_weights(df, label, UTILITY)
    last = numbers[-1]
    predict, _ = fit_stack(
        rows.filter(F.col("fold") < last), rows.filter(f"fold = {last} and role = 'train'"), bases, numbers[:-1], weigh
    )
    names = {"p_0": "p_crash", "p_1": "p_normal", "p_2": "p_boom"}
    scored = predict(rows.filter(f"fold = {last} and role = 'test'"))
    scored = checkpointed(
        scored.withColumnsRenamed(names)
        .withColumn("y_true", F.col(label).cast("int"))
        .withColumnRenamed("predicted_class", "y_pred")
    )
    first = next(iter(bases))
    tuning = out_of_fold(rows.filter(F.col("fold") < last), {first: bases[first]}, numbers[:-1])
    tuning = tuning.withColumnsRenamed({f"{first}_{k}": v for k, v in names.items()})
    tuning = tuning.withColumn("y_true", F.col(label).cast("int"))
    reports = {
        "classes": metrics.class_report(scored),
        "summary": metrics.summary(scored),
        "confusion": metrics.confusion(scored),
        "utility_cells": metrics.utility_decomposition(scored),
        "reliability": metrics.reliability(scored),
        "thresholds": best_thresholds(threshold_grid(tuning)),
    }
    return scored, reports


def run(
    minutes: DataFrame,
    series: Series,
    out: str,
    gamma: float = 2.0,
    plan: folds.WalkForward = folds.WalkForward(),
    first_test: str | None = None,
    bases=None,
) -> None:
    """The whole job: features parquet, prediction CSV and report CSVs under ``out``."""
    daily = checkpointed(session_table(minutes, series))
    if "is_holiday" not in daily.columns:
        daily = daily.withColumn("is_holiday", F.lit(False))
    features = checkpointed(daily_features(daily, series, (gamma,)))
    write_features(features, f"{out}/features")
    label = f"label_gamma_{targets.tag(gamma)}_numeric"
    scored, reports = classify_and_report(model_table(features, label, first_test), plan, label, series, bases)
    keep = [*series.by_session, "y_true", "y_pred", "p_crash", "p_normal", "p_boom"]
    write_csv(scored.select(*keep), f"{out}/predictions")
    write_reports(reports, f"{out}/reports")


