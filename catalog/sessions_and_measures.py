"""Calendar, minute returns and daily realized measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.rounding import rounded
from marketrisk.operators import calendar as cal
from marketrisk.operators import intraday as intra
from marketrisk.operators import realized as rz
from marketrisk.plans import tables as tb
from marketrisk.series import Series, owned

ONE = Series()


def returns(spark, sf, keys=(), look_back=1):
    minutes, series = tb.ticks(spark, sf, keys, look_back)
    return intra.with_minute_returns(minutes, series), series


def daily(spark, sf, keys=()):
    minutes, series = returns(spark, sf, keys, look_back=2)
    return rz.daily_measures(minutes, series)


def daily_rv(spark, sf):
    cols = ["session_date", "RV_daily", "n_minutes", "BV_daily", "JV_daily", "jump_ratio"]
    cols += ["RVol_daily", "BVol_daily", "JVol_daily", "RVol_annual", "log_RV_daily"]
    return rounded(daily(spark, sf).select(*cols))


def daily_rv_by_symbol(spark, sf):
    cols = ["session_date", "symbol", "n_minutes", "RV_daily", "BV_daily", "JV_daily", "overnight_gap"]
    return rounded(daily(spark, sf, ("symbol",)).select(*cols))


def daily_ohlc(spark, sf):
    cols = ["session_date", "daily_open", "daily_high", "daily_low", "daily_close", "daily_volume"]
    return rounded(daily(spark, sf).select(*cols, "daily_return", "daily_return_sum"))


def range_estimators(spark, sf):
    cols = ["parkinson_var", "garman_klass_var", "rogers_satchell_var", "daily_range", "overnight_gap"]
    return rounded(daily(spark, sf).select("session_date", *cols), 10)


def realized_moments(spark, sf):
    cols = ["realized_skew", "realized_kurt", "downside_var", "upside_var", "variance_ratio"]
    return rounded(daily(spark, sf).select("session_date", *cols))


def sample_moments(spark, sf):
    minutes, series = returns(spark, sf)
    return rounded(rz.sample_moments(owned(minutes, series), series))


def yang_zhang(spark, sf):
    out = rz.close_to_close(rz.yang_zhang(daily(spark, sf), ONE), ONE)
    return rounded(out.select("session_date", "yang_zhang_vol", "close_to_close_vol"))


def ewma_rv(spark, sf):
    return rounded(rz.smoothed_variance(daily(spark, sf), ONE).select("session_date", "ewma_rv", "volatility_ratio"))


def volume_measures(spark, sf):
    bars = tb.bars(tb.order_lines(spark, sf))
    own = rz.volume_measures(bars, ONE)
    fallback = bars.groupBy("session_date").agg(
        F.max("ohlcv_close").alias("daily_close"), F.sum("ohlcv_volume").alias("daily_volume")
    )
    fallback = fallback.withColumn("daily_dollar_volume", rz.daily_dollar_volume()).drop("daily_close", "daily_volume")
    return rounded(own.join(fallback, "session_date"))


def minute_returns(spark, sf):
    minutes, series = returns(spark, sf)
    simple = intra.with_minute_returns(minutes, series, log=False, name="simple_return")
    rows = owned(simple, series)
    return rounded(rows.select("session_date", "minute_of_session", "minute_return", "simple_return"), 10)


def return_stats(spark, sf):
    minutes, series = returns(spark, sf, look_back=30)
    rows = owned(intra.with_return_stats(minutes, series), series)
    return rounded(rows.select("session_date", "minute_of_session", *[c for c in rows.columns if c.startswith("minute_return_")]))


def cumulative_return(spark, sf):
    minutes, series = returns(spark, sf)
    rows = intra.with_cumulative_return(owned(minutes, series), series)
    return rounded(rows.select("session_date", "minute_of_session", "session_cumulative_return"))


def return_checks(spark, sf):
    minutes, series = returns(spark, sf)
    return intra.return_checks(owned(minutes, series), series, limit=0.005)


def return_summary(spark, sf):
    minutes, series = returns(spark, sf)
    return rounded(intra.return_summary(owned(minutes, series)), 10)


def hour_returns(spark, sf):
    """First- and last-hour returns; an hour is 20 rows here, as small scales have short sessions."""
    rows = tb.sessions_of_ticks(spark, sf)
    late = intra.last_hour_return(rows, ONE, rows=20)
    return rounded(late.join(intra.hour_after_open_return(rows, ONE, rows=20), "session_date"))


def hour_returns_60(spark, sf):
    """The same with the 60 minutes of a real hour; null in sessions that have no more rows."""
    rows = tb.sessions_of_ticks(spark, sf)
    late = intra.last_hour_return(rows, ONE, rows=60)
    return rounded(late.join(intra.hour_after_open_return(rows, ONE, rows=60), "session_date"))


def session_features(spark, sf):
    df = cal.with_session_features(cal.with_session_clock(tb.sessions(spark, sf)))
    cols = ["event_id", "session_date", "session_minutes", "minute_of_session", "hour_of_session", "is_first_hour"]
    return rounded(df.select(*cols, "is_last_hour", "minutes_until_close", "session_progress"))


def last_minutes(spark, sf):
    df = cal.with_session_clock(tb.sessions(spark, sf)).filter(cal.in_last_minutes(30))
    return df.select("event_id", "session_date", "minute_of_session")


def session_bounds(spark, sf):
    df = cal.with_session_clock(tb.sessions(spark, sf))
    early = F.col("is_early_close")
    df = df.withColumns(cal.session_bounds("session_date", early))
    return df.select(
        "event_id",
        F.date_format("session_open", "yyyy-MM-dd HH:mm:ss").alias("session_open"),
        F.date_format("session_close", "yyyy-MM-dd HH:mm:ss").alias("session_close"),
        cal.is_regular_time("timestamp", early).alias("is_regular_time"),
        cal.minute_number("timestamp", "session_open").alias("minute_number"),
    )


def session_flags(spark, sf):
    df = cal.with_session_clock(tb.sessions(spark, sf))
    flags = cal.session_flags(df, ["is_early_close", "early_close_minutes_local", "is_opx"])
    return cal.distinct_sessions(df).join(flags, "session_date", "left")


def days_to_event(spark, sf):
    days = cal.distinct_sessions(tb.order_lines(spark, sf)).withColumn("is_opx", tb.is_opx())
    return days.select("session_date", "is_opx", cal.days_to_next("is_opx").alias("event_days_to_opx"))


def last_n_sessions(spark, sf):
    rows = cal.last_sessions(tb.bars(tb.order_lines(spark, sf)), 20)
    return rounded(rows.groupBy("session_date").agg(F.count(F.lit(1)).alias("bars"), F.sum("ohlcv_volume").alias("volume")))


QUERIES = {
    f.__name__: f
    for f in (
        daily_rv, daily_rv_by_symbol, daily_ohlc, range_estimators, realized_moments, sample_moments, yang_zhang,
        ewma_rv, volume_measures, minute_returns, return_stats, cumulative_return, return_checks, return_summary,
        hour_returns, hour_returns_60, session_features, last_minutes, session_bounds, session_flags, days_to_event, last_n_sessions,
    )
}

_W30 = "(PARTITION BY session_date ORDER BY m ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
SESSIONS = f"""
stamped AS (
  SELECT event_id, ts, {_LOCAL} AS lt, CAST({_LOCAL} AS DATE) AS session_date,
         CASE WHEN user_id % 7 <> 0 THEN value END AS ohlcv_close,
         CASE WHEN user_id % 5 <> 0 THEN value END AS iex_bid_price,
         value AS ohlcv_volume, day(ts) % 10 = 0 AS is_early_close,
         CASE WHEN day(ts) % 20 = 0 THEN 180.0::DOUBLE END AS early_close_minutes_local,
         event_type = 'error' AS is_opx
  FROM events),
sized AS (
  SELECT *, CASE WHEN is_early_close THEN coalesce(CAST(early_close_minutes_local AS INTEGER), 210) ELSE 390 END
            AS session_minutes, hour(lt) * 60 + minute(lt) - 570 AS since
  FROM stamped),
sess AS (
  SELECT *, CAST(CASE WHEN since >= 0 AND since < session_minutes THEN since + 1 END AS INTEGER) AS minute_of_session
  FROM sized)"""

ORACLE = {
    "daily_rv": S.ctes(S.DAILY)
    + S.final(
        "(SELECT session_date, RV_daily, n_minutes, BV_daily, JV_daily, jump_ratio, RVol_daily, BVol_daily, JVol_daily,"
        " RVol_annual, log_RV_daily FROM daily)",
        "session_date, n_minutes",
    ),
    "daily_rv_by_symbol": S.ctes(S.bars(True), S.returns(True), S.daily(True))
    + S.final(
        "(SELECT session_date, symbol, n_minutes, RV_daily, BV_daily, JV_daily, overnight_gap FROM daily)",
        "session_date, symbol, n_minutes",
    ),
    "daily_ohlc": S.ctes(S.DAILY)
    + S.final(
        "(SELECT session_date, daily_open, daily_high, daily_low, daily_close, daily_volume, daily_return,"
        " daily_return_sum FROM daily)"
    ),
    "range_estimators": S.ctes(S.DAILY)
    + S.final(
        "(SELECT session_date, parkinson_var, garman_klass_var, rogers_satchell_var, daily_range, overnight_gap"
        " FROM daily)",
        digits=10,
    ),
    "realized_moments": S.ctes(S.DAILY)
    + S.final(
        "(SELECT session_date, realized_skew, realized_kurt, downside_var, upside_var, variance_ratio FROM daily)"
    ),
    "sample_moments": S.ctes(
        S.RETURNS,
        """
centred AS (
  SELECT session_date, r - avg(r) OVER (PARTITION BY session_date) AS d,
         count(*) OVER (PARTITION BY session_date) AS k FROM returns),
x AS (
  SELECT session_date,
         CASE WHEN max(k) > 10 THEN avg(d * d * d) / nullif(pow(avg(d * d), 1.5), 0) END AS realized_skewness,
         CASE WHEN max(k) > 10 THEN avg(d * d * d * d) / nullif(pow(avg(d * d), 2), 0) - 3 END AS realized_kurtosis
  FROM centred GROUP BY session_date)""",
    )
    + S.final("x"),
    "yang_zhang": S.ctes(
        S.DAILY,
        """
parts AS (
  SELECT session_date, overnight_gap AS co, ln(daily_close / daily_open) AS oc, rogers_satchell_var AS rs,
         ln(daily_close / lag(daily_close) OVER (ORDER BY session_date)) AS cc FROM daily)""",
        f"""
v AS (
  SELECT session_date, {S.roll('var_samp({})', 'co', 20)} AS vco, {S.roll('var_samp({})', 'oc', 20)} AS voc,
         {S.roll('var_samp({})', 'rs', 20)} AS vrs, {S.std('cc', 20)} AS scc FROM parts)""",
    )
    + S.final(
        "(SELECT session_date, sqrt(vco + 0.34 / (1 + 21.0 / 19) * voc + (1 - 0.34 / (1 + 21.0 / 19)) * vrs)"
        " AS yang_zhang_vol, scc * sqrt(252) AS close_to_close_vol FROM v)"
    ),
    "ewma_rv": S.ctes(S.DAILY, S.recursive("RV_daily", "0.06", "e"))
    + S.final(
        "(SELECT session_date, y AS ewma_rv, RV_daily / nullif(y, 0) AS volatility_ratio FROM daily JOIN e USING (n))"
    ),
    "volume_measures": S.ctes(S.TICKS)
    + S.final(
        "(SELECT session_date, ln(1 + sum(c * v)) AS dollar_volume, stddev_samp(ln(1 + v)) AS volume_volatility,"
        " ln(1 + max(c) * sum(v)) AS daily_dollar_volume FROM ticks GROUP BY session_date)"
    ),
    "minute_returns": S.ctes(S.RETURNS)
    + S.final(
        "(SELECT session_date, m AS minute_of_session, r AS minute_return,"
        " (c - lag(c) OVER w) / nullif(lag(c) OVER w, 0) AS simple_return FROM returns"
        " WINDOW w AS (PARTITION BY session_date ORDER BY m))",
        "session_date, minute_of_session",
        10,
    ),
    "return_stats": S.ctes(S.RETURNS)
    + S.final(
        "(SELECT session_date, m AS minute_of_session, r * r AS minute_return_sq, abs(r) AS minute_return_abs,"
        " CAST(coalesce(sign(r), 0) AS INTEGER) AS minute_return_sign,"
        f" CASE WHEN count(r) OVER {_W30} >= 10 THEN avg(r) OVER {_W30} END AS minute_return_ma30,"
        f" CASE WHEN count(r) OVER {_W30} >= 10 THEN stddev_samp(r) OVER {_W30} END AS minute_return_std30 FROM returns)",
        "session_date, minute_of_session, minute_return_sign",
    ),
    "cumulative_return": S.ctes(S.RETURNS)
    + S.final(
        "(SELECT session_date, m AS minute_of_session, CASE WHEN r IS NOT NULL THEN sum(r) OVER"
        " (PARTITION BY session_date ORDER BY m) END AS session_cumulative_return FROM returns)",
        "session_date, minute_of_session",
    ),
    "return_checks": S.ctes(S.RETURNS)
    + "SELECT count(*) AS rows, CAST(count(*) FILTER (abs(r) > 0.005) AS BIGINT) AS extreme_returns,"
    " CAST(count(*) FILTER (m > 1 AND r IS NULL) AS BIGINT) AS null_returns FROM returns",
    "return_summary": S.ctes(S.RETURNS)
    + S.final(
        "(SELECT avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, max(r) AS max, quantile_cont(r, 0.01) AS q01,"
        " quantile_cont(r, 0.99) AS q99 FROM returns)",
        "",
        10,
    ),
    "hour_returns": S.ctes(S.TICKS)
    + S.final(
        "(SELECT session_date, CASE WHEN count(*) > 20 THEN ln(max(c) FILTER (m = session_rows)"
        " / max(c) FILTER (m = session_rows - 19)) END AS last_hour_return,"
        " CASE WHEN count(*) > 20 THEN max(c) FILTER (m = 21) / max(c) FILTER (m = 1) - 1 END AS hour_after_open_return"
        " FROM ticks GROUP BY session_date)"
    ),
    "hour_returns_60": S.ctes(S.TICKS)
    + S.final(
        "(SELECT session_date, CASE WHEN count(*) > 60 THEN ln(max(c) FILTER (m = session_rows)"
        " / max(c) FILTER (m = session_rows - 59)) END AS last_hour_return,"
        " CASE WHEN count(*) > 60 THEN max(c) FILTER (m = 61) / max(c) FILTER (m = 1) - 1 END AS hour_after_open_return"
        " FROM ticks GROUP BY session_date)"
    ),
    "session_features": S.ctes(SESSIONS)
    + S.final(
        "(SELECT event_id, session_date, session_minutes, minute_of_session,"
        " CAST((minute_of_session - 1) // 60 + 1 AS INTEGER) AS hour_of_session,"
        " coalesce(minute_of_session <= 60, false) AS is_first_hour,"
        " coalesce(minute_of_session > session_minutes - 60, false) AS is_last_hour,"
        " session_minutes - minute_of_session + 1 AS minutes_until_close,"
        " minute_of_session / session_minutes AS session_progress FROM sess)",
        "event_id, session_date, session_minutes, minute_of_session, hour_of_session, is_first_hour, is_last_hour,"
        " minutes_until_close",
    ),
    "last_minutes": S.ctes(SESSIONS)
    + "SELECT event_id, session_date, minute_of_session FROM sess WHERE minute_of_session > session_minutes - 30",
    "session_bounds": S.ctes(
        SESSIONS,
        """
b AS (
  SELECT *, ((session_date + TIME '09:30:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS op,
         ((session_date + TIME '09:30:00' + to_minutes(CASE WHEN is_early_close THEN 210 ELSE 390 END))
            AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS cl,
         hour(lt) * 3600 + minute(lt) * 60 + second(lt) AS sec FROM sess)""",
    )
    + "SELECT event_id, strftime(op, '%Y-%m-%d %H:%M:%S') AS session_open,"
    " strftime(cl, '%Y-%m-%d %H:%M:%S') AS session_close,"
    " sec >= 34200 AND sec <= CASE WHEN is_early_close THEN 46800 ELSE 57600 END AS is_regular_time,"
    " CAST(floor((floor(epoch(ts)) - epoch(op)) / 60) AS BIGINT) + 1 AS minute_number FROM b",
    "session_flags": S.ctes(SESSIONS)
    + "SELECT session_date, min_by(is_early_close, ts) AS is_early_close,"
    " arg_min_null(early_close_minutes_local, ts) AS early_close_minutes_local, min_by(is_opx, ts) AS is_opx"
    " FROM sess GROUP BY session_date",
    "days_to_event": """
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem),
f AS (SELECT session_date, isodow(session_date) = 5 AND day(session_date) BETWEEN 15 AND 21 AS is_opx FROM d)
SELECT session_date, is_opx, CAST(datediff('day', session_date, (SELECT min(g.session_date) FROM f g
  WHERE g.is_opx AND g.session_date >= f.session_date)) AS INTEGER) AS event_days_to_opx FROM f""",
    "last_n_sessions": """
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem ORDER BY 1 DESC LIMIT 20)
SELECT CAST(l_shipdate AS DATE) AS session_date, count(*) AS bars, round(sum(l_quantity) + 1.37e-10, 8) AS volume
FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT session_date FROM d) GROUP BY 1""",
}
