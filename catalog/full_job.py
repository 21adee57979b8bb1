"""The joined feature table of the full job."""

from __future__ import annotations

from catalog import sql as S
from catalog.daily_families import FLAGS
from catalog.minute_families import _LIQ_DAY, _LIQ_MIN, QUOTES
from catalog.rounding import rounded
from marketrisk.functions.lineage import checkpointed
from marketrisk.plans import features as ft
from marketrisk.plans import tables as tb


def features(spark, sf):
    minutes, series, bars = tb.kept_ticks(spark, sf)
    daily = checkpointed(ft.session_table(minutes, series, bars=bars)).withColumns(
        {"is_holiday": tb.is_holiday(), "is_opx": tb.is_opx()}
    )
    return ft.daily_features(daily, series.unblocked(), (0.5,))


def feature_table(spark, sf):
    """A few columns of every family out of the joined table."""
    keep = ["RV_daily", "label_gamma_0_5", "target_return_5d", "vr_rv_ma20", "iex_spread_rel_mean", "iex_spread_rel_q75", "iex_spread_last_hour"]
    keep += ["path_direction_changes", "path_momentum_5d", "liq_daily_amihud", "liq_volume_ma_20d", "liq_open_volume", "liq_close_volume", "time_month"]
    keep += ["reg_rv_lag_5d", "reg_rv_lta_60d", "event_earnings_month"]
    return rounded(features(spark, sf).select("session_date", *keep), 6)


QUERIES = {"feature_table": feature_table}

ORACLE = {
    "feature_table": S.ctes(
        S.DAILY,
        QUOTES,
        _LIQ_MIN,
        _LIQ_DAY,
        FLAGS,
        """
qd AS (
  SELECT session_date, avg(iex_spread_rel) AS a, quantile_cont(iex_spread_rel, 0.75) AS b,
         avg(iex_spread_rel) FILTER (m > session_rows - 60) AS late FROM quotes GROUP BY session_date),
vp AS (
  SELECT session_date, coalesce(sum(v) FILTER ((m - 1) * 10 // session_rows = 0), 0) AS opening,
         coalesce(sum(v) FILTER ((m - 1) * 10 // session_rows = 9), 0) AS closing FROM ticks GROUP BY session_date),
fl AS (
  SELECT session_date, count(*) FILTER (flip) AS flips FROM (SELECT session_date, sign(r) <> lag(sign(r)) OVER
    (PARTITION BY session_date ORDER BY m) AS flip FROM returns) GROUP BY session_date)""",
        f"""
j AS (
  SELECT d.*, a, b, late, opening, closing, flips, liq_daily_amihud, l.liq_daily_volume AS lv, mon,
         lead(daily_return) OVER (ORDER BY session_date) / nullif(RVol_daily, 0) AS z
  FROM daily d JOIN qd USING (session_date) JOIN fl USING (session_date) JOIN vp USING (session_date)
  JOIN (SELECT session_date, liq_daily_amihud, liq_daily_volume FROM liqd) l USING (session_date)
  JOIN (SELECT session_date, mon FROM flags) f USING (session_date)),
k AS (
  SELECT session_date, RV_daily, CASE WHEN z <= -0.5 THEN 'crash' WHEN z >= 0.5 THEN 'boom' ELSE 'normal' END AS label_gamma_0_5,
         CASE WHEN count(daily_return) OVER f = 5 THEN sum(daily_return) OVER f END AS target_return_5d,
         {S.mean('RV_daily', 20, 10)} AS vr_rv_ma20, a AS iex_spread_rel_mean, b AS iex_spread_rel_q75, late AS iex_spread_last_hour,
         opening AS liq_open_volume, closing AS liq_close_volume,
         flips AS path_direction_changes, daily_close / lag(daily_close, 5) OVER (ORDER BY session_date) - 1 AS path_momentum_5d,
         liq_daily_amihud, {S.mean('lv', 20, 10)} AS liq_volume_ma_20d, CAST(mon AS INTEGER) AS time_month,
         lag(RV_daily, 5) OVER (ORDER BY session_date) AS reg_rv_lag_5d, {S.mean('RV_daily', 60, 30)} AS reg_rv_lta_60d,
         CAST(mon IN (1, 4, 7, 10) AS INTEGER) AS event_earnings_month
  FROM j WINDOW f AS (ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))""",
    )
    + S.final("k", "session_date, label_gamma_0_5, path_direction_changes, time_month, event_earnings_month", 6)
}
