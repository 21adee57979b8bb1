"""Every family's columns out of the joined table of the full job, next to the SQL of the family's own queries.

The session table is built once a query; of the families only the wanted one is read.  The optional technical
indicators are not part of the job's table.
"""

from __future__ import annotations

from catalog import daily_families, labels_and_folds, minute_families, sessions_and_measures
from catalog import sql as S
from catalog.full_job import features
from catalog.minute_families import QUOTES, quote_aggs
from catalog.rounding import rounded
from marketrisk.functions.columns import prefixed

_SQL = {**sessions_and_measures.ORACLE, **minute_families.ORACLE, **daily_families.ORACLE, **labels_and_folds.ORACLE}

MEASURES = (
    "n_minutes", "RV_daily", "BV_daily", "JV_daily", "jump_ratio", "RVol_daily", "BVol_daily", "JVol_daily", "RVol_annual",
    "log_RV_daily", "daily_open", "daily_high", "daily_low", "daily_close", "daily_volume", "daily_return", "daily_return_sum",
    "realized_skew", "realized_kurt", "downside_var", "upside_var", "variance_ratio",
)
RANGES = ("parkinson_var", "garman_klass_var", "rogers_satchell_var", "daily_range", "overnight_gap")


def joined_measures(spark, sf):
    return rounded(features(spark, sf).select("session_date", *MEASURES, *RANGES), 8, **dict.fromkeys(RANGES, 10))


def joined_labels(spark, sf):
    df = features(spark, sf)
    keep = [c for c in df.columns if c.startswith(("label_", "dist_", "min_dist", "target_", "next_day", "z_score", "vol"))]
    return rounded(df.select("session_date", *keep), 6)


def joined_volatility(spark, sf):
    df = features(spark, sf)
    return rounded(df.select("session_date", *prefixed(df, "vr_")))


def joined_quotes(spark, sf):
    df = features(spark, sf)
    return rounded(df.select("session_date", *prefixed(df, "iex_")), 7)


def joined_paths(spark, sf):
    df = features(spark, sf)
    of_minutes = [c for c in prefixed(df, "path_") if c.startswith("path_last_")]
    of_minutes += ["path_high_time_pct", "path_low_time_pct", "path_path_efficiency", "path_direction_changes", "path_intraday_drawdown"]
    return rounded(df.select("session_date", *prefixed(df, "path_")), 7, **dict.fromkeys(of_minutes, 8))


def joined_liquidity(spark, sf):
    df = features(spark, sf)
    rolling = [c for c in prefixed(df, "liq_") if c[-2].isdigit() and c.endswith("d")]
    return rounded(df.select("session_date", *prefixed(df, "liq_")), 8, **dict.fromkeys(rolling, 7))


def joined_calendar(spark, sf):
    df = features(spark, sf)
    return rounded(df.select("session_date", *prefixed(df, "time_")))


def joined_events(spark, sf):
    df = features(spark, sf)
    return rounded(df.select("session_date", *prefixed(df, "event_")))


def joined_regimes(spark, sf):
    df = features(spark, sf)
    decayed = prefixed(df, ("reg_ewma_", "reg_vol_of_vol_"))
    return rounded(df.select("session_date", *prefixed(df, "reg_")), 7, **dict.fromkeys(decayed, 8))


QUERIES = {
    f.__name__: f
    for f in (
        joined_measures, joined_labels, joined_volatility, joined_quotes, joined_paths, joined_liquidity, joined_calendar,
        joined_events, joined_regimes,
    )
}


def _together(*queries: str) -> str:
    """One row per session out of several queries' SQL."""
    return "SELECT * FROM " + " JOIN ".join(f"({q}) AS t{i}" + (" USING (session_date)" if i else "") for i, q in enumerate(queries))


#: The full job divides a session of any length into ten buckets, the volume profile's own query one of 40 minutes.
_PROFILE = _SQL["volume_profile"].replace("(m - 1) * 10 // 40", "(m - 1) * 10 // session_rows")
#: Among the date parts of the full job is the trading day of the month, by which month ends are then told.
_STRESS = (
    _SQL["event_stress"]
    .replace("(SELECT session_date, is_opx, mon, dom, woy FROM flags)", "(SELECT session_date, is_opx, mon, tdom, woy FROM flags)")
    .replace("CAST(dom >= day(last_day", "CAST(tdom >= day(last_day")
    .replace("is_opx, mon, dom, woy, lag", "is_opx, mon, tdom, woy, lag")
)
_FILLED = (
    "(SELECT session_date, session_date < DATE '2020-08-28' AS iex_pre_data_flag,"
    " last_value(COLUMNS(* EXCLUDE (session_date)) IGNORE NULLS) OVER (ORDER BY session_date)"
    f" FROM (SELECT session_date, {quote_aggs()} FROM quotes GROUP BY session_date))"
)

ORACLE = {
    "joined_measures": _together(*[_SQL[q] for q in ("daily_rv", "daily_ohlc", "realized_moments", "range_estimators")]),
    "joined_labels": f"SELECT * EXCLUDE ({', '.join(c + g for g in ('0_1', '0_25') for c in ('label_gamma_', 'dist_to_boom_', 'dist_to_crash_', 'min_dist_threshold_'))},"
    f" label_gamma_0_1_numeric, label_gamma_0_25_numeric) FROM ({_SQL['crash_boom_labels']})",
    "joined_volatility": _together(*[_SQL[q] for q in ("vol_transforms", "vol_decayed", "vol_rolling", "vol_regimes")]),
    "joined_quotes": S.ctes(S.TICKS, QUOTES) + S.final(_FILLED, "session_date, iex_pre_data_flag", 7),
    "joined_paths": _together(_SQL["path_intraday_hours"], _SQL["path_daily"]),
    "joined_liquidity": _together(
        _SQL["liquidity_daily"],
        f"SELECT * EXCLUDE (liq_daily_volume) FROM ({_PROFILE})",
        _SQL["liquidity_rolling"],
        _SQL["liquidity_relative"],
    ),
    "joined_calendar": _SQL["calendar_features"],
    "joined_events": _together(_SQL["event_rules"], _STRESS),
    "joined_regimes": _together(
        *[_SQL[q] for q in ("regime_decayed", "regime_variance_ratio", "regime_states", "regime_memory", "regime_long_memory")]
    ),
}
