"""Macro, calendar, event, regime and technical families."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.minute_families import _LIQ_DAY, _LIQ_MIN
from catalog.rounding import rounded
from catalog.sessions_and_measures import ONE, daily, returns
from marketrisk.functions.columns import prefixed
from marketrisk.operators import events as ev
from marketrisk.operators import joins
from marketrisk.operators import liquidity as liq
from marketrisk.operators import macro as mac
from marketrisk.operators import regime as reg
from marketrisk.operators import targets as tg
from marketrisk.operators import technical as tech
from marketrisk.plans import tables as tb


def made(df, prefix, digits=8):
    return rounded(df.select("session_date", *prefixed(df, prefix)), digits)


def days_with_macro(spark, sf):
    days = tb.order_lines(spark, sf).select("session_date").distinct()
    months = tb.macro_months(spark, sf)
    out = mac.released_as_of(days, months, "month", ["umcsi", "us_policy_uncertainty"], ONE)
    return mac.released_as_of(out, tb.macro_days(spark, sf), "day", ["cboe_VIXCLS"], ONE)


def macro_as_of(spark, sf):
    return rounded(days_with_macro(spark, sf), 7)


def macro_lagged(spark, sf):
    return made(mac.with_lagged(days_with_macro(spark, sf), ONE), "macro_", 7)


def macro_signals(spark, sf):
    out = mac.with_macro_signals(mac.with_lagged(days_with_macro(spark, sf), ONE), ONE)
    keep = [c for c in prefixed(out, "macro_") if not c.endswith(("_lagged", "_change_20d"))]
    return rounded(out.select("session_date", *keep), 7)


def session_macro(spark, sf):
    rows = tb.sessions_of_ticks(spark, sf).select(
        "session_date",
        "minute_of_session",
        F.when(F.col("minute_of_session") % 3 == 1, F.col("ohlcv_close")).alias("umcsi"),
        F.when(F.col("minute_of_session") % 4 == 1, F.col("ohlcv_open")).alias("us_policy_uncertainty"),
        F.col("ohlcv_high").alias("cboe_VIXCLS"),
    )
    return rounded(mac.session_macro(rows, ONE))


def flagged_days(spark, sf):
    days = tb.order_lines(spark, sf).select("session_date").distinct()
    return days.withColumns({"is_holiday": tb.is_holiday(), "is_opx": tb.is_opx()})


def calendar_features(spark, sf):
    return made(mac.time_features(flagged_days(spark, sf), ONE), "time_")


def event_rules(spark, sf):
    days = flagged_days(spark, sf).drop("is_opx")
    out = mac.with_date_parts(ev.with_expiry_rule(days, ONE), ONE)
    out = ev.with_rule_events(ev.with_expiry_distance(out, ONE), ONE)
    return made(out, "event_")


def event_stress(spark, sf):
    minutes, series = returns(spark, sf, look_back=30)
    volume = liq.liquidity_daily(minutes, series).select("session_date", "liq_daily_volume")
    df = daily(spark, sf).join(volume, "session_date").withColumn("is_opx", tb.is_opx())
    keep = ["consecutive_down", "gap_day", "reversal_pattern", "wide_range", "extreme_volume"]
    keep += ["earnings_fomc", "monthend_opx", "event_count", "stressed_opx", "multi_event"]
    return ev.event_features(df, ONE).select("session_date", *[f"event_{k}" for k in keep])


def labelled(spark, sf):
    return tg.with_z_score(tg.with_next_day(daily(spark, sf), ONE), ONE)


def regime_decayed(spark, sf):
    return made(reg.with_decayed(daily(spark, sf), ONE), "reg_")


def _ratio(spark, sf, **kw):
    return reg.with_variance_ratio(reg.with_decayed(daily(spark, sf), ONE), ONE, **kw)


def regime_variance_ratio(spark, sf):
    out = _ratio(spark, sf)
    return rounded(out.select("session_date", *[c for c in out.columns if "_vr_" in c]), 7)


def regime_variance_ratio_full_history(spark, sf):
    out = _ratio(spark, sf, point_in_time=False)
    return rounded(out.select("session_date", "reg_vr_percentile", "reg_vr_quintile"))


def regime_states(spark, sf):
    out = reg.with_regimes(_ratio(spark, sf), ONE).withColumn("is_opx", tb.is_opx())
    out = reg.with_transitions(reg.with_expiry_regimes(out), ONE)
    keep = ["vol_regime", "vol_trend", "jump_regime", "mean_reversion_regime", "vol_clustering", "opx_high_vol"]
    keep += ["opx_mean_revert", "regime_change", "regime_duration", "transition_frequency", "vr_stability"]
    moves = [c for c in out.columns if c.startswith("reg_trans_")]
    return out.select("session_date", *[f"reg_{k}" for k in keep], *moves)


def regime_memory(spark, sf):
    out = reg.with_persistence(reg.with_memory(labelled(spark, sf), ONE), ONE)
    return made(out, "reg_", 7)


def regime_long_memory(spark, sf):
    return made(reg.with_long_memory(daily(spark, sf), ONE), "reg_", 7)


def technical_trend(spark, sf):
    df = daily(spark, sf)
    for family in (tech.rsi, tech.macd, tech.bollinger, tech.momentum, tech.stochastic):
        df = family(df, ONE)
    keep = ["rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "bb_middle", "bollinger_position"]
    keep += ["momentum_10", "momentum_20", "roc_10", "williams_r", "stochastic_k", "stochastic_d"]
    return rounded(df.select("session_date", *keep), 7)


def technical_averages(spark, sf):
    df = tech.moving_averages(daily(spark, sf), ONE)
    return rounded(df.select("session_date", *prefixed(df, ("sma_", "price_to_", "ema_"))), 7)


def technical_volume(spark, sf):
    df = tech.volume_indicators(daily(spark, sf), ONE)
    return rounded(df.select("session_date", "obv", "obv_ratio", "mfi", "volume_roc", "ad_line"), 6)


def technical_range(spark, sf):
    df = daily(spark, sf)
    for family in (tech.average_true_range, tech.directional_index, tech.support_resistance, tech.trend_and_regime):
        df = family(df, ONE)
    keep = ["atr", "atr_percent", "adx", "plus_di", "minus_di", "resistance", "support", "distance_from_resistance"]
    keep += ["distance_from_support", "trend_strength", "volatility_regime"]
    return rounded(df.select("session_date", *keep), 7)


def side_tables(spark, sf):
    """Left joins with suffixed clashes, overlap-free joins and semi-joins of daily tables."""
    days = daily(spark, sf).select("session_date", "daily_close", "daily_volume")
    side = tb.macro_days(spark, sf).select(F.col("day").alias("session_date"), F.col("cboe_VIXCLS").alias("daily_close"))
    both = joins.left_with_suffix(days, side, ["session_date"], "vix")
    extra = tb.macro_days(spark, sf).select(F.col("day").alias("session_date"), F.lit(1.0).alias("daily_volume"), "cboe_VIXCLS")
    wide = joins.left_without_overlap(both, extra, ["session_date"])
    fridays = days.filter(F.weekday("session_date") == 4)
    return rounded(joins.keep_dates(wide, fridays, ["session_date"]), 7)


QUERIES = {
    f.__name__: f
    for f in (
        macro_as_of, macro_lagged, macro_signals, session_macro, calendar_features, event_rules, event_stress,
        regime_decayed, regime_variance_ratio, regime_variance_ratio_full_history, regime_states, regime_memory,
        regime_long_memory, technical_trend, technical_averages, technical_volume, technical_range, side_tables,
    )
}

FLAGS = """
fdays AS (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem),
flags AS (
  SELECT session_date, row_number() OVER (ORDER BY session_date) AS n,
         strftime(session_date, '%m-%d') IN ('01-01', '07-04', '12-25') AS is_holiday,
         isodow(session_date) = 5 AND day(session_date) BETWEEN 15 AND 21 AS is_opx,
         isodow(session_date) - 1 AS dow, day(session_date) AS dom, week(session_date) AS woy,
         month(session_date) AS mon, quarter(session_date) AS qtr, year(session_date) AS yr,
         row_number() OVER (PARTITION BY year(session_date), month(session_date) ORDER BY session_date) AS tdom,
         count(*) OVER (PARTITION BY year(session_date), month(session_date)) AS tmax,
         row_number() OVER (PARTITION BY year(session_date) ORDER BY session_date) AS tdoy
  FROM fdays)"""

MACRO = f"""
mdays AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem),
months AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, {S.six('avg(o_totalprice) / 1000')} AS level,
         {S.six('max(o_totalprice) / 1000')} AS top
  FROM orders GROUP BY 1),
vix AS (SELECT CAST(o_orderdate AS DATE) AS d, {S.six('avg(o_totalprice) / 12000')} AS v FROM orders GROUP BY 1),
rel_m AS (
  SELECT *, (SELECT x FROM (SELECT d + CAST(i AS INTEGER) AS x, sum(CASE WHEN isodow(d + CAST(i AS INTEGER)) <= 5 AND i > 0
    THEN 1 ELSE 0 END) OVER (ORDER BY i) AS k FROM range(0, 12) r(i)) WHERE k = 3 ORDER BY x LIMIT 1) AS released
  FROM months),
rel_v AS (
  SELECT *, (SELECT x FROM (SELECT d + CAST(i AS INTEGER) AS x, sum(CASE WHEN isodow(d + CAST(i AS INTEGER)) <= 5 AND i > 0
    THEN 1 ELSE 0 END) OVER (ORDER BY i) AS k FROM range(0, 12) r(i)) WHERE k = 3 ORDER BY x LIMIT 1) AS released
  FROM vix),
best_v AS (SELECT released, arg_max(v, d) AS v FROM rel_v GROUP BY released),
macro AS (
  SELECT session_date, level AS umcsi, top AS us_policy_uncertainty, v AS cboe_VIXCLS,
         row_number() OVER (ORDER BY session_date) AS n
  FROM mdays ASOF LEFT JOIN rel_m ON session_date >= rel_m.released
             ASOF LEFT JOIN best_v ON session_date >= best_v.released)"""


def lagged(c: str) -> str:
    return (
        f"lag({c}, 3) OVER o AS macro_{c}_lagged, lag({c}, 3) OVER o - lag({c}, 23) OVER o AS macro_{c}_change_20d,"
        f" lag({c}, 3) OVER o / lag({c}, 23) OVER o - 1 AS macro_{c}_pct_change_20d"
    )


MACRO_LAG = f"""
ml AS (
  SELECT session_date, n, {', '.join(lagged(c) for c in mac.SERIES_NAMES)} FROM macro WINDOW o AS (ORDER BY session_date))"""
_V, _M, _U = "macro_cboe_VIXCLS_lagged", "macro_umcsi_lagged", "macro_us_policy_uncertainty_lagged"


def rank_in(x: str, source: str, rows: int, alias: str = "a") -> str:
    """Average-tie rank share of x among the last rows of source (by n)."""
    return (
        f"(SELECT (count(*) FILTER (b.{x} < {alias}.{x}) + (count(*) FILTER (b.{x} = {alias}.{x}) + 1) / 2.0)"
        f" / count(b.{x}) FROM {source} b WHERE b.n <= {alias}.n AND b.n > {alias}.n - {rows})"
    )


SPAN_CTES = ",".join(
    S.ewm("RV_daily", f"(2.0 / {s + 1})", f"w{s}") + "," + S.ewm("log_RV_daily", f"(2.0 / {s + 1})", f"l{s}")
    for s in reg.SPANS
)
RV = "rv AS (SELECT daily.*, " + ", ".join(f"w{s}.y AS e{s}, l{s}.y AS el{s}" for s in reg.SPANS) + " FROM daily " + " ".join(
    f"JOIN w{s} USING (n) JOIN l{s} USING (n)" for s in reg.SPANS
) + ")"
VOV = "sq AS (SELECT n, " + ", ".join(f"pow(RV_daily - e{s}, 2) AS sq{s}" for s in reg.SPANS) + " FROM rv)," + ",".join(
    S.ewm(f"sq{s}", f"(2.0 / {s + 1})", f"v{s}", "sq") for s in reg.SPANS
)
VR = (
    "vr AS (SELECT rv.*, "
    + ", ".join(f"RV_daily / nullif(lag(e{s}) OVER (ORDER BY session_date), 0) AS vr{s}" for s in reg.SPANS)
    + " FROM rv)"
)
REGIME = """
qs AS (
  SELECT *, quantile_cont(vr20, [0.2, 0.4, 0.6, 0.8]) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND
         CURRENT ROW) AS q,
         CASE WHEN count(RV_daily) OVER z >= 126 THEN quantile_cont(RV_daily, [0.25, 0.75, 0.9]) OVER z END AS rq
  FROM vr WINDOW z AS (ORDER BY session_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
st AS (
  SELECT *, CASE WHEN vr20 IS NOT NULL THEN CAST(vr20 > q[1] AS INTEGER) + CAST(vr20 > q[2] AS INTEGER)
              + CAST(vr20 > q[3] AS INTEGER) + CAST(vr20 > q[4] AS INTEGER) END AS quint,
         CASE WHEN RV_daily > rq[3] THEN 3 WHEN RV_daily > rq[2] THEN 2 WHEN RV_daily > rq[1] THEN 1 ELSE 0 END AS regime,
         CAST(abs(vr20 - 1) > 0.5 AS INTEGER) AS mr, CAST(RV_daily > e20 AS INTEGER) AS clus,
         isodow(session_date) = 5 AND day(session_date) BETWEEN 15 AND 21 AS is_opx
  FROM qs),
tr AS (
  SELECT *, lag(regime) OVER o AS was, CAST(regime <> lag(regime) OVER o AS INTEGER) AS chg,
         CAST(quint = lag(quint) OVER o AS INTEGER) AS same
  FROM st WINDOW o AS (ORDER BY session_date)),
isl AS (SELECT *, sum(coalesce(chg, 0)) OVER (ORDER BY session_date) AS island FROM tr)"""


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


_TR = "greatest(daily_high - daily_low, abs(daily_high - pc), abs(daily_low - pc))"
TECH = """
t AS (
  SELECT *, lag(daily_close) OVER o AS pc, lag(daily_close, 10) OVER o AS c10, lag(daily_close, 20) OVER o AS c20,
         lag(daily_volume, 10) OVER o AS v10, daily_close - lag(daily_close) OVER o AS ch,
         daily_high - lag(daily_high) OVER o AS dh, lag(daily_low) OVER o - daily_low AS dl,
         (daily_high + daily_low + daily_close) / 3 AS tp
  FROM daily WINDOW o AS (ORDER BY session_date))"""
_O = "OVER (ORDER BY session_date)"


def fr(agg: str, x: str, n: int) -> str:
    return S.roll(agg + "({})", x, n)


ORACLE = {
    "macro_as_of": S.ctes(MACRO) + S.final("(SELECT session_date, umcsi, us_policy_uncertainty, cboe_VIXCLS FROM macro)", digits=7),
    "macro_lagged": S.ctes(MACRO, MACRO_LAG) + S.final("(SELECT * EXCLUDE (n) FROM ml)", digits=7),
    "macro_signals": S.ctes(MACRO, MACRO_LAG)
    + S.final(
        f"(SELECT session_date, {_V} / ({S.mean(_V, 20, 10)}) AS macro_vix_term_structure,"
        f" CAST({_V} > 20 AS INTEGER) AS macro_high_vix_regime,"
        f" CASE WHEN {_V} IS NOT NULL THEN {rank_in(_V, 'ml', 252)} END AS macro_vix_percentile,"
        f" {_M} - ({S.mean(_M, 120, 60)}) AS macro_sentiment_vs_trend,"
        f" {S.mean('macro_umcsi_change_20d', 60, 30)} AS macro_sentiment_momentum,"
        f" CAST({_U} > {S.quantile(_U, 0.8, 252, 126)} AS INTEGER) AS macro_uncertainty_spike,"
        f" CASE WHEN count({_U}) OVER {S.frame(60)} >= 30 THEN regr_slope({_U}, n) OVER {S.frame(60)} END"
        " AS macro_uncertainty_trend FROM ml a)",
        "session_date, macro_high_vix_regime, macro_uncertainty_spike",
        7,
    ),
    "session_macro": S.ctes(S.TICKS)
    + S.final(
        "(SELECT session_date, max_by(c, m) FILTER (m % 3 = 1) AS umcsi, max_by(o, m) FILTER (m % 4 = 1)"
        " AS us_policy_uncertainty, max_by(h, m) AS cboe_VIXCLS FROM ticks GROUP BY session_date)"
    ),
    "calendar_features": S.ctes(FLAGS)
    + S.final(
        "(SELECT session_date, CAST(dow AS INTEGER) AS time_day_of_week, CAST(dom AS INTEGER) AS time_day_of_month,"
        " CAST(woy AS INTEGER) AS time_week_of_year, CAST(mon AS INTEGER) AS time_month, CAST(qtr AS INTEGER) AS time_quarter,"
        " CAST(yr AS INTEGER) AS time_year, CAST(tdom AS INTEGER) AS time_trading_day_of_month,"
        " CAST(tdoy AS INTEGER) AS time_trading_day_of_year,"
        " CAST(n - max(CASE WHEN is_holiday THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        " AS INTEGER) AS time_days_since_holiday,"
        " CAST(min(CASE WHEN is_holiday THEN n END) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - n"
        " AS INTEGER) AS time_days_until_holiday,"
        " sin(2 * pi() * mon / 12) AS time_month_sin, cos(2 * pi() * mon / 12) AS time_month_cos,"
        " sin(2 * pi() * dow / 5) AS time_dow_sin, cos(2 * pi() * dow / 5) AS time_dow_cos,"
        " sin(2 * pi() * dom / 31) AS time_dom_sin, cos(2 * pi() * dom / 31) AS time_dom_cos,"
        " CAST(qtr = 1 AS INTEGER) AS time_is_q1, CAST(qtr = 4 AS INTEGER) AS time_is_q4,"
        " CAST(tdom >= tmax - 3 AS INTEGER) AS time_is_month_end, CAST(mon = 1 AS INTEGER) AS time_is_january,"
        " CAST(mon = 12 AS INTEGER) AS time_is_december, CAST(dow = 0 AS INTEGER) AS time_is_monday,"
        " CAST(dow = 4 AS INTEGER) AS time_is_friday, CAST(tdom <= 3 OR tdom >= tmax - 2 AS INTEGER) AS time_turn_of_month,"
        " CAST(woy % 4 = 3 AND dow >= 3 AS INTEGER) AS time_opex_week,"
        " CAST(coalesce(lead(is_holiday) OVER (ORDER BY n), false) AS INTEGER) AS time_pre_holiday,"
        " CAST(coalesce(lag(is_holiday) OVER (ORDER BY n), false) AS INTEGER) AS time_post_holiday,"
        " CAST(mon BETWEEN 5 AND 8 AS INTEGER) AS time_is_summer, CAST(mon BETWEEN 11 AND 12 AS INTEGER)"
        " AS time_tax_loss_season FROM flags)",
        "session_date, time_day_of_week, time_day_of_month, time_week_of_year, time_month, time_quarter, time_year,"
        " time_trading_day_of_month, time_trading_day_of_year, time_days_since_holiday, time_days_until_holiday,"
        " time_is_q1, time_is_q4, time_is_month_end, time_is_january, time_is_december, time_is_monday, time_is_friday,"
        " time_turn_of_month, time_opex_week, time_pre_holiday, time_post_holiday, time_is_summer, time_tax_loss_season",
    ),
    "event_rules": S.ctes(
        FLAGS,
        "near AS (SELECT *, "
        + ", ".join(f"coalesce(lead(is_opx, {i}) OVER (ORDER BY n), false) AS f{i}" for i in range(1, 6))
        + ", "
        + ", ".join(f"coalesce(lag(is_opx, {i}) OVER (ORDER BY n), false) AS b{i}" for i in range(1, 4))
        + " FROM flags)",
        """
dist AS (
  SELECT *, CASE WHEN f1 THEN 1 WHEN f2 THEN 2 WHEN f3 THEN 3 WHEN f4 THEN 4 WHEN f5 THEN 5 ELSE 0 END AS to_opx,
         CASE WHEN b1 THEN 1 WHEN b2 THEN 2 WHEN b3 THEN 3 ELSE 0 END AS from_opx,
         mon IN (1, 4, 7, 10) AS season FROM near)""",
    )
    + "SELECT session_date, to_opx AS event_days_to_opx, from_opx AS event_days_from_opx,"
    " CAST(to_opx > 0 OR from_opx > 0 AS INTEGER) AS event_opx_week,"
    " CAST(is_opx AND mon IN (3, 6, 9, 12) AS INTEGER) AS event_quad_witch, CAST(f2 AND dow = 2 AS INTEGER) AS event_vix_expiry,"
    " CAST(season AS INTEGER) AS event_earnings_month, CAST(season AND dom BETWEEN 15 AND 31 AS INTEGER) AS event_peak_earnings,"
    " CAST(season AND dom > 20 AS INTEGER) AS event_tech_earnings, CAST(season AND dom < 15 AS INTEGER) AS event_pre_earnings,"
    " CAST(mon IN (1, 3, 5, 6, 7, 9, 11, 12) AND woy % 6 = 3 AS INTEGER) AS event_fomc_week,"
    " CAST(mon = 8 AND dom BETWEEN 20 AND 31 AS INTEGER) AS event_jackson_hole,"
    " CAST(dow = 4 AND dom <= 7 AS INTEGER) AS event_nfp_day, CAST(dom BETWEEN 10 AND 15 AS INTEGER) AS event_inflation_data,"
    " CAST(mon IN (3, 6, 9, 12) AND dom >= 25 AS INTEGER) AS event_quarter_end_rebal,"
    " CAST(tdom >= day(last_day(session_date)) - 3 AS INTEGER) AS event_month_end_rebal,"
    " CAST(mon = 6 AND dom >= 20 AS INTEGER) AS event_russell_rebal,"
    " CAST(is_opx AND mon IN (3, 6, 9, 12) AS INTEGER) AS event_sp_rebal FROM dist",
    "event_stress": S.ctes(
        S.DAILY,
        FLAGS,
        f"""
e AS (
  SELECT d.*, is_opx, mon, dom, woy, lag(daily_high) {_O} AS ph, lag(daily_low) {_O} AS pl,
         CAST(daily_return < 0 AS INTEGER) AS down, d.daily_volume AS vol,
         coalesce(lead(is_opx, 1) {_O} OR lead(is_opx, 2) {_O} OR lead(is_opx, 3) {_O} OR lead(is_opx, 4) {_O}
           OR lead(is_opx, 5) {_O} OR lag(is_opx, 1) {_O} OR lag(is_opx, 2) {_O} OR lag(is_opx, 3) {_O}, false) AS near
  FROM daily d JOIN (SELECT session_date, is_opx, mon, dom, woy FROM flags) f USING (session_date)),
g AS (
  SELECT *, CAST(vol > {S.quantile('vol', 0.95, 60, 30)} AS INTEGER) AS xv, CAST(mon IN (1, 4, 7, 10) AS INTEGER) AS em,
         CAST(mon IN (1, 3, 5, 6, 7, 9, 11, 12) AND woy % 6 = 3 AS INTEGER) AS fw,
         CAST(dom >= day(last_day(session_date)) - 3 AS INTEGER) AS me, CAST(is_opx AS INTEGER) AS ox FROM e)""",
    )
    + f"SELECT session_date, {big(S.roll('sum({})', 'down', 5, 1))} AS event_consecutive_down,"
    " CAST(abs(overnight_gap) > 0.01 AS INTEGER) AS event_gap_day,"
    " CAST(daily_high > ph AND daily_low < pl AND daily_close < daily_open AS INTEGER) AS event_reversal_pattern,"
    f" CAST(daily_range > {S.quantile('daily_range', 0.9, 20, 10)} AS INTEGER) AS event_wide_range, xv AS event_extreme_volume,"
    " em * fw AS event_earnings_fomc, me * CAST(near AS INTEGER) AS event_monthend_opx, em + fw + me + ox AS event_event_count,"
    " xv * ox AS event_stressed_opx, CAST(em + fw + me + ox >= 2 AS INTEGER) AS event_multi_event FROM g",
    "regime_decayed": S.ctes(S.DAILY, SPAN_CTES, RV, VOV)
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"e{s} AS reg_ewma_rv_{s}d, el{s} AS reg_ewma_log_rv_{s}d, sqrt(e{s}) AS reg_ewma_vol_{s}d,"
            f" sqrt(v{s}.y) AS reg_vol_of_vol_{s}d"
            for s in reg.SPANS
        )
        + ", "
        + ", ".join(
            f"e{a} / nullif(e{b}, 0) AS reg_ewma_ratio_{a}_{b}d" for a in reg.SPANS for b in reg.SPANS if a < b
        )
        + " FROM rv "
        + " ".join(f"JOIN v{s} USING (n)" for s in reg.SPANS)
        + ")"
    ),
    "regime_variance_ratio": S.ctes(S.DAILY, SPAN_CTES, RV, VR, REGIME)
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"vr{s} AS reg_vr_{s}d, CASE WHEN vr{s} > 0 THEN ln(vr{s}) END AS reg_log_vr_{s}d, abs(vr{s} - 1) AS reg_vr_deviation_{s}d" for s in reg.SPANS
        )
        + ", quint AS reg_vr_quintile, CASE WHEN vr20 IS NOT NULL THEN (SELECT count(*) FILTER (b.vr20 < a.vr20)"
        " + (count(*) FILTER (b.vr20 = a.vr20) + 1) / 2.0 FROM st b WHERE b.n <= a.n"
        " AND year(b.session_date) = year(a.session_date)) END AS reg_vr_percentile FROM st a)",
        "session_date, reg_vr_quintile",
        7,
    ),
    "regime_variance_ratio_full_history": S.ctes(S.DAILY, SPAN_CTES, RV, VR)
    + S.final(
        "(SELECT session_date, CASE WHEN vr20 IS NOT NULL THEN rank() OVER (PARTITION BY year(session_date) ORDER BY vr20)"
        " + (count(*) OVER (PARTITION BY year(session_date), vr20) - 1) / 2.0 END AS reg_vr_percentile,"
        " CASE WHEN vr20 IS NOT NULL THEN CAST(vr20 > q[1] AS INTEGER) + CAST(vr20 > q[2] AS INTEGER)"
        " + CAST(vr20 > q[3] AS INTEGER) + CAST(vr20 > q[4] AS INTEGER) END AS reg_vr_quintile"
        " FROM vr, (SELECT quantile_cont(vr20, [0.2, 0.4, 0.6, 0.8]) AS q FROM vr))",
        "session_date, reg_vr_quintile",
    ),
    "regime_states": S.ctes(S.DAILY, SPAN_CTES, RV, VR, REGIME)
    + "SELECT session_date, regime AS reg_vol_regime, CAST(coalesce(e5 > e20, false) AS INTEGER) AS reg_vol_trend,"
    " CAST(jump_ratio > 0.1 AS INTEGER) AS reg_jump_regime, mr AS reg_mean_reversion_regime,"
    f" {big(S.roll('sum({})', 'clus', 5, 1))} AS reg_vol_clustering,"
    " CAST(is_opx AND regime >= 2 AS INTEGER) AS reg_opx_high_vol, CAST(is_opx AND mr = 1 AS INTEGER) AS reg_opx_mean_revert,"
    " chg AS reg_regime_change,"
    " CAST(row_number() OVER (PARTITION BY island ORDER BY session_date) AS INTEGER) AS reg_regime_duration,"
    f" {big(S.roll('sum({})', 'chg', 60, 30))} AS reg_transition_frequency,"
    f" {big(S.roll('sum({})', 'same', 5, 1))} AS reg_vr_stability, "
    + ", ".join(
        big(S.roll("sum({})", f"CAST(was = {a} AND regime = {b} AS INTEGER)", 60, 30)) + f" AS reg_trans_{a}_to_{b}"
        for a in range(4)
        for b in range(4)
        if a != b
    )
    + " FROM isl",
    "regime_memory": S.ctes(
        S.DAILY,
        """
z AS (
  SELECT *, lead(daily_return) OVER o / nullif(RVol_daily, 0) AS zn, lag(log_RV_daily) OVER o AS pl FROM daily
  WINDOW o AS (ORDER BY session_date))""",
        """
rs AS (
  SELECT a.n, list(b.log_RV_daily - mu ORDER BY b.n) AS dev, sd FROM
    (SELECT n, avg(log_RV_daily) OVER f AS mu, stddev_pop(log_RV_daily) OVER f AS sd, count(log_RV_daily) OVER f AS k FROM daily
     WINDOW f AS (ORDER BY session_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) a
    JOIN daily b ON b.n <= a.n AND b.n > a.n - 60 AND b.log_RV_daily IS NOT NULL WHERE k >= 30 GROUP BY a.n, sd),
cum AS (
  SELECT n, sd, list_transform(range(1, len(dev) + 1), lambda i: list_sum(dev[1:i])) AS c FROM rs)""",
    )
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"lag(RV_daily, {k}) OVER o AS reg_rv_lag_{k}d, lag(log_RV_daily, {k}) OVER o AS reg_log_rv_lag_{k}d,"
            f" lag(daily_return, {k}) OVER o AS reg_return_lag_{k}d, lag(zn, {k}) OVER o AS reg_z_lag_{k}d,"
            f" RV_daily / nullif(lag(RV_daily, {k}) OVER o, 0) - 1 AS reg_rv_change_{k}d"
            for k in reg.LAGS
        )
        + ", log_RV_daily - 0.8 * pl AS reg_ar1_residual, CASE WHEN count(log_RV_daily) OVER"
        " (ORDER BY session_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 30 THEN corr(log_RV_daily, pl) OVER"
        " (ORDER BY session_date ROWS BETWEEN 58 PRECEDING AND CURRENT ROW) END AS reg_rolling_autocorr,"
        " (list_max(c) - list_min(c)) / (sd + 1e-8) AS reg_hurst_proxy"
        " FROM z LEFT JOIN cum USING (n) WINDOW o AS (ORDER BY session_date))",
        digits=7,
    ),
    "regime_long_memory": S.ctes(
        S.DAILY, f"z AS (SELECT *, log_RV_daily - lag(log_RV_daily) {_O} AS dl FROM daily)"
    )
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"{S.mean('RV_daily', w, w // 2)} AS reg_rv_lta_{w}d, RV_daily / nullif({S.mean('RV_daily', w, w // 2)}, 0) - 1"
            f" AS reg_rv_vs_lta_{w}d, {S.roll('sum({})', 'dl', w, w // 2)} AS reg_frac_diff_{w}d"
            for w in reg.LONG_WINDOWS
        )
        + f", RV_daily / nullif({S.roll('max({})', 'RV_daily', 252, 126)}, 0) AS reg_dist_from_52w_high,"
        f" RV_daily / nullif({S.roll('min({})', 'RV_daily', 252, 126)}, 0) AS reg_dist_from_52w_low,"
        f" CAST(RV_daily = {S.roll('max({})', 'RV_daily', 252, 126)} AS INTEGER) AS reg_new_52w_high,"
        f" CAST(RV_daily = {S.roll('min({})', 'RV_daily', 252, 126)} AS INTEGER) AS reg_new_52w_low FROM z)",
        "session_date, reg_new_52w_high, reg_new_52w_low",
        7,
    ),
    "technical_trend": S.ctes(
        S.DAILY,
        TECH,
        S.recursive("daily_close", "(2.0 / 13)", "f12"),
        S.recursive("daily_close", "(2.0 / 27)", "f26"),
        "mc AS (SELECT f12.n, f12.y - f26.y AS x FROM f12 JOIN f26 USING (n))",
        S.recursive("x", "(2.0 / 10)", "sg", "mc"),
        f"""
k AS (
  SELECT *, {fr('avg', 'CASE WHEN ch > 0 THEN ch ELSE 0 END', 14)} AS up,
         {fr('avg', 'CASE WHEN ch < 0 THEN -ch ELSE 0 END', 14)} AS dn,
         {fr('avg', 'daily_close', 20)} AS ma, {fr('stddev_samp', 'daily_close', 20)} AS sd,
         {fr('max', 'daily_high', 14)} AS hi, {fr('min', 'daily_low', 14)} AS lo FROM t),
kk AS (SELECT *, 100 * (daily_close - lo) / (hi - lo) AS sk FROM k)""",
    )
    + S.final(
        "(SELECT session_date, 100 - 100 / (1 + up / nullif(dn, 0)) AS rsi, mc.x AS macd, sg.y AS macd_signal,"
        " mc.x - sg.y AS macd_histogram, ma + sd * 2 AS bb_upper, ma - sd * 2 AS bb_lower, ma AS bb_middle,"
        " (daily_close - (ma - sd * 2)) / nullif(4 * sd, 0) AS bollinger_position, daily_close - c10 AS momentum_10,"
        " daily_close - c20 AS momentum_20, (daily_close - c10) / c10 * 100 AS roc_10,"
        f" -100 * (hi - daily_close) / (hi - lo) AS williams_r, sk AS stochastic_k, {fr('avg', 'sk', 3)} AS stochastic_d"
        " FROM kk JOIN mc USING (n) JOIN sg USING (n))",
        digits=7,
    ),
    "technical_averages": S.ctes(
        S.DAILY, ",".join(S.recursive("daily_close", f"(2.0 / {k + 1})", f"f{k}") for k in (12, 26, 50))
    )
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"{fr('avg', 'daily_close', k)} AS sma_{k}, daily_close / ({fr('avg', 'daily_close', k)}) AS price_to_sma_{k}"
            for k in (5, 10, 20, 50, 100, 200)
        )
        + ", f12.y AS ema_12, f26.y AS ema_26, f50.y AS ema_50 FROM daily JOIN f12 USING (n) JOIN f26 USING (n)"
        " JOIN f50 USING (n))",
        digits=7,
    ),
    "technical_volume": S.ctes(
        S.DAILY,
        TECH,
        f"""
o1 AS (
  SELECT *, sum(coalesce(sign(ch) * daily_volume, 0)) {_O} AS obv, lag(tp) {_O} AS ptp,
         ((daily_close - daily_low) - (daily_high - daily_close)) / nullif(daily_high - daily_low, 0) * daily_volume AS clv FROM t),
o2 AS (
  SELECT *, CASE WHEN tp > ptp THEN tp * daily_volume ELSE 0 END AS fin,
         CASE WHEN tp < ptp THEN tp * daily_volume ELSE 0 END AS fout FROM o1)""",
    )
    + S.final(
        f"(SELECT session_date, obv, obv / nullif({fr('avg', 'obv', 20)}, 0) AS obv_ratio,"
        f" 100 - 100 / (1 + ({fr('sum', 'fin', 14)}) / nullif({fr('sum', 'fout', 14)}, 0)) AS mfi,"
        " (daily_volume - v10) / v10 * 100 AS volume_roc,"
        f" sum(clv) {_O} AS ad_line FROM o2)",
        digits=6,
    ),
    "technical_range": S.ctes(
        S.DAILY,
        TECH,
        f"""
r1 AS (
  SELECT *, {_TR} AS tr, CASE WHEN dh < 0 THEN 0 ELSE dh END AS up, CASE WHEN dl < 0 THEN 0 ELSE dl END AS dn,
         daily_close / pc - 1 AS ret FROM t),
r2 AS (
  SELECT *, {fr('avg', 'tr', 14)} AS atr, 100 * ({fr('avg', 'up', 14)}) / ({fr('avg', 'tr', 14)}) AS pdi,
         100 * ({fr('avg', 'dn', 14)}) / ({fr('avg', 'tr', 14)}) AS mdi, {fr('max', 'daily_high', 20)} AS res,
         {fr('min', 'daily_low', 20)} AS sup, {fr('stddev_samp', 'ret', 20)} AS v20 FROM r1),
r3 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM r2)""",
    )
    + S.final(
        f"(SELECT session_date, atr, atr / daily_close * 100 AS atr_percent, {fr('avg', 'dx', 14)} AS adx, pdi AS plus_di,"
        " mdi AS minus_di, res AS resistance, sup AS support, (res - daily_close) / daily_close AS distance_from_resistance,"
        " (daily_close - sup) / daily_close AS distance_from_support, CASE WHEN n > 20 THEN corr(n, daily_close) OVER"
        " (ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS trend_strength,"
        f" CASE WHEN count(v20) OVER {S.frame(252)} >= 252 THEN {rank_in('v20', 'r3', 252)} END AS volatility_regime FROM r3 a)",
        digits=7,
    ),
    "side_tables": S.ctes(S.DAILY, MACRO)
    + S.final(
        "(SELECT d.session_date, d.daily_close, d.daily_volume, v.v AS daily_close_vix, v.v AS cboe_VIXCLS"
        " FROM daily d LEFT JOIN vix v ON v.d = d.session_date WHERE isodow(d.session_date) = 5)",
        digits=7,
    ),
}
