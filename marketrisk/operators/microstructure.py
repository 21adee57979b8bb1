"""Top-of-book features (``iex_``): minute columns, then one row per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, ln, prefixed, total
from marketrisk.functions.frames import carried, rolling_mean, rolling_frames
from marketrisk.functions.lineage import checkpointed
from marketrisk.functions.ordered import WIDE_ACCURACY, quantiles_in_place, sketch_aggs
from marketrisk.series import Series, owned

LOOK_BACKS = (30, 60, 120)
# First day with top-of-book data (fixed value).
AVAILABLE_FROM = "2020-08-28"


def with_spreads(df: DataFrame) -> DataFrame:
    """Mid price and absolute, relative, effective and log spread."""
    bid, ask = F.col("iex_bid_price"), F.col("iex_ask_price")
    mid = (bid + ask) / 2
    return df.withColumns(
        {
            "iex_mid_price": mid,
            "iex_spread_abs": ask - bid,
            "iex_spread_rel": div(ask - bid, mid),
            "iex_effective_spread": 2 * F.abs(F.col("ohlcv_close") - mid),
            "iex_log_spread": ln(ask - bid + 0.0001),
        }
    )


def with_depth(df: DataFrame) -> DataFrame:
    """Total depth, imbalance, log sizes, depth ratio and dollar depths."""
    bid, ask = F.col("iex_bid_size"), F.col("iex_ask_size")
    return df.withColumns(
        {
            "iex_total_depth": bid + ask,
            "iex_depth_imbalance": div(ask - bid, ask + bid + 1),
            "iex_log_bid_size": ln(bid + 1),
            "iex_log_ask_size": ln(ask + 1),
            "iex_depth_ratio": div(bid, ask + 1),
            "iex_bid_dollar_depth": bid * F.col("iex_bid_price"),
            "iex_ask_dollar_depth": ask * F.col("iex_ask_price"),
        }
    )


def with_mid_dynamics(df: DataFrame, series: Series) -> DataFrame:
    """Mid return, price pressure and spread change."""
    w, mid, rel = series.minutes(), F.col("iex_mid_price"), F.col("iex_spread_rel")
    return df.withColumns(
        {
            "iex_mid_return": div(mid, F.lag(mid).over(w)) - 1,
            "iex_price_pressure": div(F.col("ohlcv_close") - mid, mid),
            "iex_spread_change": rel - F.lag(rel).over(w),
            "_mid_step": F.abs(mid - F.lag(mid).over(w)),
        }
    )


def rolling_quotes(look_backs: Sequence[int] = LOOK_BACKS) -> dict[str, tuple[str, str, int, int]]:
    """30-minute mid deviation; rolling spread level and deviation, imbalance and quote intensity.

    Windows need at least a third of their rows (ten of thirty for the mid deviation).
    """
    wanted = {"iex_mid_vol_30m": ("std", "iex_mid_price", 30, 10)}
    for n in look_backs:
        least = max(1, n // 3)
        wanted[f"iex_spread_ma_{n}m"] = ("mean", "iex_spread_rel", n, least)
        wanted[f"iex_spread_vol_{n}m"] = ("std", "iex_spread_rel", n, least)
        wanted[f"iex_imbalance_ma_{n}m"] = ("mean", "iex_depth_imbalance", n, least)
        wanted[f"iex_quote_intensity_{n}m"] = ("sum", "_mid_step", n, least)
    return wanted


def with_rolling_quotes(df: DataFrame, series: Series, look_backs: Sequence[int] = LOOK_BACKS) -> DataFrame:
    """The columns of :func:`rolling_quotes`."""
    return rolling_frames(df, series.minutes(), rolling_quotes(look_backs)).drop("_mid_step")


def minute_quotes(df: DataFrame, series: Series, look_backs: Sequence[int] = LOOK_BACKS) -> DataFrame:
    """All minute columns; needs look-back copies of at least the longest window plus one row."""
    return with_rolling_quotes(with_mid_dynamics(with_depth(with_spreads(df)), series), series, look_backs)


def is_distribution(name: str) -> bool:
    return any(part in name for part in ("spread", "imbalance", "vol"))


def is_quantity(name: str) -> bool:
    return any(part in name for part in ("depth", "size"))


def daily_aggs(columns: Sequence[str]) -> tuple[list[Column], dict[str, tuple[str, float]]]:
    """Aggregates chosen by column name, and the quantiles wanted besides them."""
    aggs, quantiles = [], {}
    for c in columns:
        if is_distribution(c):
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
            quantiles[f"{c}_q75"] = (c, 0.75)
        elif is_quantity(c):
            aggs += [total(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean")]
        else:
            aggs.append(F.avg(c).alias(f"{c}_mean"))
    return aggs, quantiles


def extra_aggs(series: Series) -> list[Column]:
    """Spread in the last hour and at the close, largest imbalance and mid noise."""
    return [
        F.avg(F.when(F.col("is_last_hour"), F.col("iex_spread_rel"))).alias("iex_spread_last_hour"),
        F.max_by("iex_spread_rel", series.order).alias("iex_spread_close"),
        F.max(F.abs(F.col("iex_depth_imbalance"))).alias("iex_max_imbalance"),
        F.stddev_samp("iex_mid_return").alias("iex_noise_proxy"),
    ]


def microstructure_daily(minutes: DataFrame, series: Series, look_backs: Sequence[int] = LOOK_BACKS) -> DataFrame:
    """One row per session: one aggregation, and a second pass for the exact quantiles that it has bracketed.

    The second pass builds the columns it needs anew, from the narrow minutes: writing all of them out costs more.  Keep
    minutes that are dear to build (see :func:`marketrisk.plans.tables.kept_ticks`).
    """
    if "is_last_hour" not in minutes.columns:
        minutes = minutes.withColumn("is_last_hour", F.lit(None).cast("boolean"))
    rows = owned(minute_quotes(minutes, series, look_backs), series)
    aggs, quantiles = daily_aggs(prefixed(rows, "iex_"))
    daily = rows.groupBy(*series.by_session).agg(*aggs, *extra_aggs(series), *sketch_aggs(quantiles, WIDE_ACCURACY))
    return with_quantiles(daily, rows, series, quantiles)


def with_quantiles(daily: DataFrame, rows: DataFrame, series: Series, quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Replace the sketches of a session table by exact quantiles.

    The session table is checkpointed: its edges meet the rows and its other columns the result, without a second pass.
    """
    daily = checkpointed(daily)
    narrow = rows.select(*series.by_session, series.order, *dict.fromkeys(c for c, _ in quantiles.values()))
    exact = quantiles_in_place(narrow, daily, series.by_session, quantiles, salt_by=series.order)
    return daily.drop(*[f"_s_{n}" for n in quantiles]).join(exact, series.by_session, "left")


def filled(daily: DataFrame, series: Series, how: str = "forward_fill") -> DataFrame:
    """Fill gaps by the last value, zero or the mean of the last 20 rows; flag days before the feed."""
    columns = prefixed(daily, "iex_")
    days = series.days()
    rules = {
        "forward_fill": lambda c: carried(c, days),
        "zero": lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)),
        "mean": lambda c: F.coalesce(F.col(c), rolling_mean(c, days, 20, 1)),
    }
    if how not in rules:
        raise ValueError(f"unknown fill rule {how!r}")
    out = daily.withColumns({c: rules[how](c) for c in columns})
    return out.withColumn("iex_pre_data_flag", F.col(series.session) < F.lit(AVAILABLE_FROM).cast("date"))


def bound_checks(daily: DataFrame) -> DataFrame:
    """Largest value per spread / imbalance column and whether it leaves its bound (10 %, 1)."""
    spreads = [c for c in prefixed(daily, "iex_") if "spread_rel" in c]
    imbalances = [c for c in prefixed(daily, "iex_") if "imbalance" in c]
    wide = daily.agg(
        *[F.max(c).alias(c) for c in spreads],
        *[F.max(F.abs(F.col(c))).alias(c) for c in imbalances],
    )
    long = wide.unpivot([], spreads + imbalances, "column_name", "largest")
    limit = F.when(F.col("column_name").contains("spread_rel"), 0.1).otherwise(1.0)
    return long.withColumn("out_of_bounds", F.coalesce(F.col("largest") > limit, F.lit(False)))
