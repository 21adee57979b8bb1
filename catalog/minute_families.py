"""Volatility, microstructure, path and liquidity families."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.sessions_and_measures import ONE, daily, returns
from catalog.rounding import rounded
from marketrisk.functions.columns import prefixed
from marketrisk.operators import liquidity as liq
from marketrisk.operators import microstructure as micro
from marketrisk.operators import path as pth
from marketrisk.operators import volatility as vol
from marketrisk.plans import tables as tb
from marketrisk.series import owned


def pick(df, prefix, *also, digits=8):
    return rounded(df.select("session_date", *also, *prefixed(df, prefix)), digits)


def vol_transforms(spark, sf):
    return pick(vol.with_transforms(daily(spark, sf), ONE), "vr_")


def vol_jump_flag_full_history(spark, sf):
    return vol.with_transforms(daily(spark, sf), ONE, point_in_time=False).select("session_date", "vr_jump_flag")


def vol_decayed(spark, sf):
    out = vol.with_decayed(vol.with_transforms(daily(spark, sf), ONE), ONE)
    return rounded(out.select("session_date", "vr_ewma_rv", "vr_ewma_log_rv", "vr_ewma_std"))


def vol_rolling(spark, sf):
    out = vol.with_term_structure(vol.with_rolling(daily(spark, sf), ONE))
    return pick(out, ("vr_rv_", "vr_term_"))


def vol_regimes(spark, sf):
    return pick(vol.with_regimes(daily(spark, sf), ONE), "vr_")


def quotes_minute(spark, sf):
    minutes, series = tb.ticks(spark, sf)
    rows = owned(micro.minute_quotes(minutes, series), series)
    made = [c for c in prefixed(rows, "iex_") if c not in tb.BAR_COLUMNS]
    return rounded(rows.select("session_date", "minute_of_session", *made))


def quotes_daily(spark, sf):
    minutes, series, _ = tb.kept_ticks(spark, sf)
    minutes = minutes.withColumn("is_last_hour", F.col("minute_of_session") > F.col("session_rows") - 60)
    return rounded(micro.microstructure_daily(minutes, series), 7)


def sparse_quotes(spark, sf):
    """Daily quotes with holes, for the fill rules."""
    bars = tb.bars(tb.order_lines(spark, sf))
    hole = F.dayofmonth("session_date") % 4 == 0
    made = bars.groupBy("session_date").agg(F.avg("iex_bid_price").alias("_b"), F.sum("iex_bid_size").alias("_s"))
    return made.select(
        "session_date",
        F.when(~hole, F.col("_b")).alias("iex_bid"),
        F.when(~hole, F.col("_s")).alias("iex_size"),
    )


def quotes_filled(spark, sf):
    df = sparse_quotes(spark, sf)
    out = micro.filled(df, ONE, "forward_fill")
    for how in ("zero", "mean"):
        other = micro.filled(df, ONE, how).select(
            "session_date", F.col("iex_bid").alias(f"iex_bid_{how}"), F.col("iex_size").alias(f"iex_size_{how}")
        )
        out = out.join(other, "session_date")
    return rounded(out)


def quotes_bounds(spark, sf):
    minutes, series = tb.ticks(spark, sf, look_back=2)
    rows = owned(micro.with_depth(micro.with_spreads(minutes)), series)
    per_day = rows.groupBy("session_date").agg(
        F.max("iex_spread_rel").alias("iex_spread_rel_max"),
        F.max("iex_depth_imbalance").alias("iex_imbalance_max"),
        F.min("iex_depth_imbalance").alias("iex_imbalance_min"),
    )
    return rounded(micro.bound_checks(per_day))


def path_intraday(spark, sf):
    minutes, series = returns(spark, sf, look_back=2)
    return rounded(pth.intraday_path(minutes, series, last=(5, 10, 30)))


def path_intraday_hours(spark, sf):
    """The same over the last half hour, hour and two hours."""
    minutes, series = returns(spark, sf, look_back=2)
    return rounded(pth.intraday_path(minutes, series, last=(30, 60, 120)))


def path_daily(spark, sf):
    df = daily(spark, sf)
    out = pth.with_momentum(pth.with_cumulative(pth.with_ranges(pth.with_gaps(df, ONE), ONE), ONE), ONE)
    return pick(out, "path_", digits=7)


def path_infinite_audit(spark, sf):
    out = pth.with_gaps(daily(spark, sf), ONE)
    return pth.infinite_audit(out)


def liquidity_minute(spark, sf):
    minutes, series = returns(spark, sf, look_back=30)
    rows = owned(liq.with_minute_liquidity(minutes, series), series)
    made = [c for c in prefixed(rows, "liq_")]
    return rounded(rows.select("session_date", "minute_of_session", *made))


def liquidity_daily(spark, sf):
    minutes, series = returns(spark, sf, look_back=30)
    return rounded(liq.liquidity_daily(minutes, series))


def volume_profile(spark, sf):
    rows = tb.sessions_of_ticks(spark, sf)
    out = liq.vwap_deviation(rows, ONE, liq.volume_profile(rows, ONE, session_minutes=40))
    volume = rows.groupBy("session_date").agg(F.sum("ohlcv_volume").alias("liq_daily_volume"))
    return rounded(liq.with_bucket_ratios(out.join(volume, "session_date")))


def _liquidity_base(spark, sf):
    minutes, series = returns(spark, sf, look_back=30)
    return liq.liquidity_daily(minutes, series)


def liquidity_rolling(spark, sf):
    out = liq.with_rolling(_liquidity_base(spark, sf), ONE)
    made = [c for c in out.columns if c[-2].isdigit() and c.endswith("d")]
    return rounded(out.select("session_date", *made), 7)


def liquidity_relative(spark, sf):
    out = liq.with_relative(_liquidity_base(spark, sf), ONE)
    return rounded(out.select("session_date", "liq_volume_percentile", "liq_abnormal_volume", "liq_regime"))


def liquidity_percentile_full_history(spark, sf):
    out = liq.with_relative(_liquidity_base(spark, sf), ONE, point_in_time=False)
    return rounded(out.select("session_date", "liq_volume_percentile"))


def amihud_kyle(spark, sf):
    minutes, series = returns(spark, sf, look_back=2)
    kyle = liq.kyle_lambda(minutes, series)
    amihud = liq.amihud_20(daily(spark, sf), ONE).select("session_date", "amihud_illiquidity")
    return rounded(kyle.join(amihud, "session_date"))


QUERIES = {
    f.__name__: f
    for f in (
        vol_transforms, vol_jump_flag_full_history, vol_decayed, vol_rolling, vol_regimes, quotes_minute, quotes_daily,
        quotes_filled, quotes_bounds, path_intraday, path_intraday_hours, path_daily, path_infinite_audit, liquidity_minute,
        liquidity_daily, volume_profile, liquidity_rolling, liquidity_relative, liquidity_percentile_full_history,
        amihud_kyle,
    )
}


def mins(n: int) -> str:
    return f"(PARTITION BY session_date ORDER BY m ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mroll(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {mins(n)} >= {least} THEN {agg}({x}) OVER {mins(n)} END"


_BEFORE = "OVER (PARTITION BY session_date ORDER BY m)"
QUOTES = f"""
q0 AS (
  SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread_abs, (ask - bid) / ((bid + ask) / 2) AS spread_rel,
         (ask_size - bid_size) / (ask_size + bid_size + 1) AS imb FROM ticks),
q1 AS (SELECT *, abs(mid - lag(mid) {_BEFORE}) AS step FROM q0),
quotes AS (
  SELECT session_date, m, session_rows, mid AS iex_mid_price, spread_abs AS iex_spread_abs, spread_rel AS iex_spread_rel,
         2 * abs(c - mid) AS iex_effective_spread, ln(spread_abs + 0.0001) AS iex_log_spread,
         bid_size + ask_size AS iex_total_depth, imb AS iex_depth_imbalance, ln(bid_size + 1) AS iex_log_bid_size,
         ln(ask_size + 1) AS iex_log_ask_size, bid_size / (ask_size + 1) AS iex_depth_ratio,
         bid_size * bid AS iex_bid_dollar_depth, ask_size * ask AS iex_ask_dollar_depth,
         mid / lag(mid) {_BEFORE} - 1 AS iex_mid_return, {mroll('stddev_samp', 'mid', 30, 10)} AS iex_mid_vol_30m,
         (c - mid) / mid AS iex_price_pressure, spread_rel - lag(spread_rel) {_BEFORE} AS iex_spread_change,
         {", ".join(
             f"{mroll('avg', 'spread_rel', n, n // 3)} AS iex_spread_ma_{n}m, "
             f"{mroll('stddev_samp', 'spread_rel', n, n // 3)} AS iex_spread_vol_{n}m, "
             f"{mroll('avg', 'imb', n, n // 3)} AS iex_imbalance_ma_{n}m, "
             f"{mroll('sum', 'step', n, n // 3)} AS iex_quote_intensity_{n}m" for n in (30, 60, 120))},
         bid AS iex_bid_price, ask AS iex_ask_price, bid_size AS iex_bid_size, ask_size AS iex_ask_size
  FROM q1)"""

_MADE = [
    "iex_mid_price", "iex_spread_abs", "iex_spread_rel", "iex_effective_spread", "iex_log_spread", "iex_total_depth",
    "iex_depth_imbalance", "iex_log_bid_size", "iex_log_ask_size", "iex_depth_ratio", "iex_bid_dollar_depth",
    "iex_ask_dollar_depth", "iex_mid_return", "iex_mid_vol_30m", "iex_price_pressure", "iex_spread_change",
] + [f"iex_{k}_{n}m" for n in (30, 60, 120) for k in ("spread_ma", "spread_vol", "imbalance_ma", "quote_intensity")]
_GIVEN = ["iex_bid_price", "iex_ask_price", "iex_bid_size", "iex_ask_size"]


def quote_aggs() -> str:
    out = []
    for c in _MADE + _GIVEN:
        if "spread" in c or "imbalance" in c or "vol" in c:
            out.append(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, quantile_cont({c}, 0.75) AS {c}_q75")
        elif "depth" in c or "size" in c:
            out.append(f"coalesce(sum({c}), 0) AS {c}_sum, avg({c}) AS {c}_mean")
        else:
            out.append(f"avg({c}) AS {c}_mean")
    out.append(
        "avg(CASE WHEN m > session_rows - 60 THEN iex_spread_rel END) AS iex_spread_last_hour,"
        " max_by(iex_spread_rel, m) AS iex_spread_close, max(abs(iex_depth_imbalance)) AS iex_max_imbalance,"
        " stddev_samp(iex_mid_return) AS iex_noise_proxy"
    )
    return ", ".join(out)


def last_n(n: int) -> str:
    late = f"m > session_rows - {n}"
    return (
        f"coalesce(sum(r) FILTER ({late}), 0) AS path_last_{n}min_return,"
        f" stddev_samp(r) FILTER ({late}) AS path_last_{n}min_vol,"
        f" max(c) FILTER ({late}) / min(c) FILTER ({late}) - 1 AS path_last_{n}min_range,"
        f" sum(v) FILTER ({late}) / sum(v) AS path_last_{n}min_vol_pct"
    )


_LIQ_MIN = f"""
liq AS (
  SELECT session_date, m, v, vwap, r, v * vwap AS liq_dollar_volume, ln(v * vwap + 1) AS liq_log_dollar_volume,
         abs(r) / (v * vwap + 1) AS liq_amihud, v AS liq_volume_rate,
         {mroll('stddev_samp', 'v', 30, 10)} AS liq_trade_intensity, abs(r) / (sqrt(v) + 1) AS liq_kyle_lambda
  FROM returns)"""
_LIQ_DAY = """
lc AS (SELECT *, avg(v) OVER (PARTITION BY session_date) AS mv FROM liq),
liqd AS (
  SELECT session_date, sum(v) AS liq_daily_volume, sum(liq_dollar_volume) AS liq_daily_dollar_volume,
         ln(sum(v) + 1) AS liq_log_daily_volume, avg(liq_amihud) AS liq_daily_amihud,
         avg(liq_kyle_lambda) AS liq_daily_kyle_lambda, sum(v * v) / (sum(v) * sum(v)) AS liq_volume_herfindahl,
         stddev_samp(v) AS liq_volume_volatility,
         sum(pow(v - mv, 3)) / nullif(count(*) * pow(stddev_samp(v), 3), 0) AS liq_volume_skew,
         max(v) / avg(v) AS liq_max_volume_spike, row_number() OVER (ORDER BY session_date) AS n
  FROM lc GROUP BY session_date)"""
_D20 = "abs(daily_close / lag(daily_close) OVER (ORDER BY session_date) - 1) / (daily_volume * daily_close) * 1e6"

ORACLE = {
    "vol_transforms": S.ctes(S.DAILY)
    + S.final(
        "(SELECT session_date, CASE WHEN RV_daily > 0 THEN ln(RV_daily) END AS vr_log_rv,"
        " CASE WHEN BV_daily > 0 THEN ln(BV_daily) END AS vr_log_bv, ln(JV_daily + 1e-8) AS vr_log_jv,"
        " RVol_daily AS vr_rvol, BVol_daily AS vr_bvol, JVol_daily AS vr_jvol,"
        " JV_daily / (RV_daily + 1e-8) AS vr_jump_ratio, BV_daily / (RV_daily + 1e-8) AS vr_continuous_ratio,"
        " CAST(JV_daily > quantile_cont(RV_daily, 0.95) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING"
        " AND CURRENT ROW) AS INTEGER) AS vr_jump_flag,"
        " upside_var / (downside_var + 1e-8) AS vr_updown_ratio, realized_skew AS vr_skew, realized_kurt AS vr_kurt"
        " FROM daily)",
        "session_date, vr_jump_flag",
    ),
    "vol_jump_flag_full_history": S.ctes(S.DAILY)
    + "SELECT session_date, CAST(JV_daily > (SELECT quantile_cont(RV_daily, 0.95) FROM daily) AS INTEGER)"
    " AS vr_jump_flag FROM daily",
    "vol_decayed": S.ctes(
        S.DAILY,
        S.ewm("RV_daily", "0.06", "e1"),
        S.ewm("log_RV_daily", "0.06", "e2"),
        """
w AS (
  SELECT a.n, sum(w) AS w, sum(w * w) AS ww, sum(w * x) / sum(w) AS mu, list(w) AS wl, list(x) AS xl
  FROM (SELECT a.n, pow(0.94, a.n - b.n) AS w, b.RV_daily AS x FROM daily a JOIN daily b ON b.n <= a.n) a GROUP BY a.n),
e3 AS (
  SELECT n, CASE WHEN n > 1 THEN sqrt(list_sum(list_transform(list_zip(wl, xl), lambda p: p[1] * (p[2] - mu) * (p[2] - mu)))
         / w * w * w / (w * w - ww)) END AS y FROM w)""",
    )
    + S.final(
        "(SELECT session_date, e1.y AS vr_ewma_rv, e2.y AS vr_ewma_log_rv, e3.y AS vr_ewma_std"
        " FROM daily JOIN e1 USING (n) JOIN e2 USING (n) JOIN e3 USING (n))"
    ),
    "vol_rolling": S.ctes(
        S.DAILY,
        "v AS (SELECT session_date, "
        + ", ".join(
            f"{S.roll(a + '({})', 'RV_daily', w, w // 2)} AS vr_rv_{n}{w}"
            for w in (5, 10, 20, 60)
            for a, n in (("avg", "ma"), ("stddev_samp", "std"), ("max", "max"), ("min", "min"))
        )
        + " FROM daily)",
    )
    + S.final(
        "(SELECT *, vr_rv_ma5 / nullif(vr_rv_ma20, 0) AS vr_term_structure_5_20,"
        " vr_rv_ma10 / nullif(vr_rv_ma60, 0) AS vr_term_structure_10_60 FROM v)"
    ),
    "vol_regimes": S.ctes(S.DAILY)
    + f"SELECT session_date, CAST(RV_daily > {S.quantile('RV_daily', 0.75, 60, 30)} AS INTEGER) AS vr_high_vol_regime,"
    f" CAST(RV_daily < {S.quantile('RV_daily', 0.25, 60, 30)} AS INTEGER) AS vr_low_vol_regime FROM daily",
    "quotes_minute": S.ctes(S.TICKS, QUOTES)
    + S.final(
        f"(SELECT session_date, m AS minute_of_session, {', '.join(_MADE)} FROM quotes)",
        "session_date, minute_of_session",
    ),
    "quotes_daily": S.ctes(S.TICKS, QUOTES)
    + S.final(f"(SELECT session_date, {quote_aggs()} FROM quotes GROUP BY session_date)", digits=7),
    "quotes_filled": S.ctes(
        S.TICKS,
        """
g AS (
  SELECT session_date, CASE WHEN day(session_date) % 4 <> 0 THEN avg(bid) END AS b,
         CASE WHEN day(session_date) % 4 <> 0 THEN sum(bid_size) END AS s FROM ticks GROUP BY session_date)""",
    )
    + S.final(
        "(SELECT session_date, last_value(b IGNORE NULLS) OVER o AS iex_bid, last_value(s IGNORE NULLS) OVER o AS iex_size,"
        " coalesce(b, 0) AS iex_bid_zero, coalesce(s, 0) AS iex_size_zero,"
        f" coalesce(b, avg(b) OVER {S.frame(20)}) AS iex_bid_mean, coalesce(s, avg(s) OVER {S.frame(20)}) AS iex_size_mean,"
        " session_date < DATE '2020-08-28' AS iex_pre_data_flag FROM g WINDOW o AS (ORDER BY session_date))",
        "session_date, iex_pre_data_flag",
    ),
    "quotes_bounds": S.ctes(
        S.TICKS,
        """
b AS (
  SELECT session_date, max((ask - bid) / ((bid + ask) / 2)) AS x, max((ask_size - bid_size) / (ask_size + bid_size + 1)) AS y,
         min((ask_size - bid_size) / (ask_size + bid_size + 1)) AS z FROM ticks GROUP BY session_date)""",
    )
    + "SELECT 'iex_spread_rel_max' AS column_name, round(max(x) + 1.37e-10, 8) AS largest, max(x) > 0.1 AS out_of_bounds FROM b"
    " UNION ALL SELECT 'iex_imbalance_max', round(max(abs(y)) + 1.37e-10, 8), max(abs(y)) > 1 FROM b"
    " UNION ALL SELECT 'iex_imbalance_min', round(max(abs(z)) + 1.37e-10, 8), max(abs(z)) > 1 FROM b",
    "path_intraday": S.ctes(
        S.RETURNS,
        "s AS (SELECT *, sign(r) <> lag(sign(r)) OVER (PARTITION BY session_date ORDER BY m) AS flip FROM returns)",
    )
    + S.final(
        f"(SELECT session_date, {last_n(5)}, {last_n(10)}, {last_n(30)},"
        " (arg_max(m, (h, -m)) - 1) / count(*) AS path_high_time_pct,"
        " (arg_min(m, (l, m)) - 1) / count(*) AS path_low_time_pct,"
        " coalesce(sum(r), 0) / (coalesce(sum(abs(r)), 0) + 1e-8) AS path_path_efficiency,"
        " CAST(count(*) FILTER (flip) AS BIGINT) AS path_direction_changes,"
        " (max(c) - min(c)) / max(c) AS path_intraday_drawdown FROM s GROUP BY session_date)",
        "session_date, path_direction_changes",
    ),
    "path_intraday_hours": S.ctes(
        S.RETURNS,
        "s AS (SELECT *, sign(r) <> lag(sign(r)) OVER (PARTITION BY session_date ORDER BY m) AS flip FROM returns)",
    )
    + S.final(
        f"(SELECT session_date, {last_n(30)}, {last_n(60)}, {last_n(120)},"
        " (arg_max(m, (h, -m)) - 1) / count(*) AS path_high_time_pct,"
        " (arg_min(m, (l, m)) - 1) / count(*) AS path_low_time_pct,"
        " coalesce(sum(r), 0) / (coalesce(sum(abs(r)), 0) + 1e-8) AS path_path_efficiency,"
        " CAST(count(*) FILTER (flip) AS BIGINT) AS path_direction_changes,"
        " (max(c) - min(c)) / max(c) AS path_intraday_drawdown FROM s GROUP BY session_date)",
        "session_date, path_direction_changes",
    ),
    "path_daily": S.ctes(
        S.DAILY,
        """
d AS (
  SELECT *, lag(daily_close) OVER w AS pc, lag(daily_close, 5) OVER w AS c5, lag(daily_close, 10) OVER w AS c10,
         lag(daily_close, 20) OVER w AS c20, overnight_gap AS gap, CAST(daily_return > 0 AS INTEGER) AS pos,
         daily_high - daily_low + 1e-8 AS span FROM daily WINDOW w AS (ORDER BY session_date))""",
    )
    + S.final(
        "(SELECT session_date, gap AS path_gap, abs(gap) AS path_gap_abs, sign(gap)::DOUBLE AS path_gap_direction,"
        f" {S.mean('gap', 5, 1)} AS path_gap_ma5, {S.std('gap', 20, 5)} AS path_gap_vol20,"
        f" gap / (abs(pc) + 1e-8) AS path_gap_pct, {S.roll('sum({})', 'gap', 5, 1)} AS path_gap_cum5,"
        " greatest(daily_high - daily_low, abs(daily_high - pc), abs(daily_low - pc)) AS path_true_range,"
        " (daily_high - daily_low) / daily_close AS path_range_pct, ln(daily_high / daily_low) AS path_log_range,"
        " (daily_close - daily_low) / span AS path_close_position, abs(daily_close - daily_open) / span AS path_body_ratio,"
        " (daily_high - greatest(daily_open, daily_close)) / span AS path_upper_shadow,"
        " (least(daily_open, daily_close) - daily_low) / span AS path_lower_shadow, "
        + ", ".join(
            f"{S.roll('sum({})', 'daily_return', w, 1)} AS path_cum_ret_{w}d,"
            f" {S.roll('max({})', 'daily_return', w, 1)} AS path_max_ret_{w}d,"
            f" {S.roll('min({})', 'daily_return', w, 1)} AS path_min_ret_{w}d,"
            f" CAST({S.roll('sum({})', 'pos', w, 1)} AS BIGINT) AS path_pos_days_{w}d"
            for w in (5, 10, 20)
        )
        + ", daily_close / c5 - 1 AS path_momentum_5d, daily_close / c20 - 1 AS path_momentum_20d,"
        " (daily_close - c10) / 10 AS path_roc_10d,"
        f" daily_close / ({S.roll('max({})', 'daily_high', 20, 5)}) - 1 AS path_dist_from_high20,"
        f" daily_close / ({S.roll('min({})', 'daily_low', 20, 5)}) - 1 AS path_dist_from_low20,"
        f" CASE WHEN count(daily_close) OVER {S.frame(20)} >= 5 THEN regr_slope(daily_close, n) OVER {S.frame(20)} END"
        " AS path_trend_strength_20d FROM d)",
        "session_date, path_pos_days_5d, path_pos_days_10d, path_pos_days_20d",
        7,
    ),
    "path_infinite_audit": "SELECT column_name, 0::BIGINT AS infinite, 0::BIGINT AS not_a_number FROM (VALUES"
    " ('path_gap'), ('path_gap_abs'), ('path_gap_direction'), ('path_gap_ma5'), ('path_gap_vol20'), ('path_gap_pct'),"
    " ('path_gap_cum5')) t(column_name)",
    "liquidity_minute": S.ctes(S.RETURNS, _LIQ_MIN)
    + S.final(
        "(SELECT session_date, m AS minute_of_session, liq_dollar_volume, liq_log_dollar_volume, liq_amihud,"
        " liq_volume_rate, liq_trade_intensity, liq_kyle_lambda FROM liq)",
        "session_date, minute_of_session",
    ),
    "liquidity_daily": S.ctes(S.RETURNS, _LIQ_MIN, _LIQ_DAY) + S.final("(SELECT * EXCLUDE (n) FROM liqd)"),
    "volume_profile": S.ctes(
        S.TICKS,
        """
b AS (
  SELECT session_date, (m - 1) * 10 // 40 AS k, sum(v) AS v FROM ticks GROUP BY ALL),
p AS (
  SELECT session_date, coalesce(sum(v) FILTER (k = 0), 0) AS liq_open_volume,
         coalesce(sum(v) FILTER (k = 9), 0) AS liq_close_volume, sum(v) AS liq_daily_volume,
         -sum(v / t * ln(v / t)) AS liq_volume_entropy
  FROM (SELECT *, sum(v) OVER (PARTITION BY session_date) AS t FROM b) GROUP BY session_date),
w AS (SELECT session_date, sum(c * v) / sum(v) AS liq_daily_vwap FROM ticks GROUP BY session_date),
x AS (
  SELECT session_date, avg(abs(c - liq_daily_vwap)) AS liq_vwap_deviation FROM ticks JOIN w USING (session_date)
  GROUP BY session_date)""",
    )
    + S.final(
        "(SELECT *, liq_open_volume / liq_daily_volume AS liq_open_volume_ratio,"
        " liq_close_volume / liq_daily_volume AS liq_close_volume_ratio"
        " FROM p JOIN w USING (session_date) JOIN x USING (session_date))"
    ),
    "liquidity_rolling": S.ctes(S.RETURNS, _LIQ_MIN, _LIQ_DAY)
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"{S.mean('liq_daily_volume', w, w // 2)} AS liq_volume_ma_{w}d,"
            f" liq_daily_volume / ({S.mean('liq_daily_volume', w, w // 2)}) AS liq_volume_ratio_{w}d,"
            f" {S.mean('liq_daily_amihud', w, w // 2)} AS liq_amihud_ma_{w}d,"
            f" {S.mean('liq_daily_dollar_volume', w, w // 2)} AS liq_dollar_volume_ma_{w}d,"
            f" CASE WHEN count(n) OVER {S.frame(w)} >= {max(2, w // 2)} THEN"
            f" regr_slope(liq_log_daily_volume, n) OVER {S.frame(w)} END AS liq_volume_trend_{w}d"
            for w in (5, 10, 20, 60)
        )
        + " FROM liqd)",
        digits=7,
    ),
    "liquidity_relative": S.ctes(
        S.RETURNS, _LIQ_MIN, _LIQ_DAY, f"ma AS (SELECT *, {S.mean('liq_daily_volume', 20, 10)} AS ma20 FROM liqd)"
    )
    + S.final(
        "(SELECT a.session_date, (SELECT (sum(CASE WHEN b.liq_daily_volume < a.liq_daily_volume THEN 1 ELSE 0 END)"
        " + (sum(CASE WHEN b.liq_daily_volume = a.liq_daily_volume THEN 1 ELSE 0 END) + 1) / 2.0) / count(*)"
        " FROM liqd b WHERE b.n <= a.n) AS liq_volume_percentile, a.ab AS liq_abnormal_volume,"
        " CASE WHEN a.d > a.hi THEN 2 WHEN a.d > a.lo THEN 1 ELSE 0 END AS liq_regime FROM"
        f" (SELECT session_date, n, liq_daily_volume, liq_daily_dollar_volume AS d,"
        f" liq_daily_volume > {S.quantile('ma20', 0.95, 60, 30)} AS ab,"
        f" {S.quantile('liq_daily_dollar_volume', 0.67, 60, 30)} AS hi,"
        f" {S.quantile('liq_daily_dollar_volume', 0.33, 60, 30)} AS lo FROM ma) a)",
        "session_date, liq_abnormal_volume, liq_regime",
    ),
    "liquidity_percentile_full_history": S.ctes(S.TICKS, "s AS (SELECT session_date, sum(v) AS v FROM ticks GROUP BY 1)")
    + S.final(
        "(SELECT session_date, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)"
        " / count(*) OVER () AS liq_volume_percentile FROM s)"
    ),
    "amihud_kyle": S.ctes(
        S.DAILY,
        """
k AS (
  SELECT session_date, ch, v * sign(ch) AS sv FROM (
    SELECT session_date, v, c / lag(c) OVER (PARTITION BY session_date ORDER BY m) - 1 AS ch FROM ticks)),
kd AS (
  SELECT session_date, CASE WHEN count(ch) > 10 THEN regr_slope(ch, sv) END AS kyle_lambda FROM k GROUP BY 1)""",
        f"a AS (SELECT session_date, {_D20} AS x FROM daily)",
    )
    + S.final(
        f"(SELECT session_date, kyle_lambda, amihud_illiquidity FROM kd JOIN"
        f" (SELECT session_date, {S.mean('x', 20)} AS amihud_illiquidity FROM a) USING (session_date))"
    ),
}
