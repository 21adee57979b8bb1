"""Session dates, session clocks and event distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import col
from marketrisk.series import Series

# Fixed values of the regular US equity session.
EXCHANGE_ZONE = "America/New_York"
OPEN_MINUTE = 570
REGULAR_MINUTES = 390
EARLY_CLOSE_MINUTES = 210


def local_time(ts: Column | str, zone: str = EXCHANGE_ZONE) -> Column:
    """Wall-clock time in the exchange's zone of a UTC timestamp (DST aware)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts))


def session_date(ts: Column | str, zone: str = EXCHANGE_ZONE) -> Column:
    return local_time(ts, zone).cast("date")


def session_minutes(early: Column | str = "is_early_close", given: Column | str | None = None) -> Column:
    """Session length: the given early-close length, else 210 on early closes, else 390."""
    short = F.coalesce(col(early), F.lit(False))
    early_length = F.lit(EARLY_CLOSE_MINUTES)
    if given is not None:
        early_length = F.coalesce(col(given).cast("int"), early_length)
    return F.when(short, early_length).otherwise(F.lit(REGULAR_MINUTES))


def minute_of_session(ts: Column | str, length: Column | str, zone: str = EXCHANGE_ZONE) -> Column:
    """1-based minute since the local open, null outside the session."""
    local = local_time(ts, zone)
    since_open = F.hour(local) * 60 + F.minute(local) - OPEN_MINUTE
    return F.when((since_open >= 0) & (since_open < col(length)), (since_open + 1).cast("int"))


def with_session_clock(df: DataFrame, ts: str = "timestamp", zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Add session date, length and minute to a minute table."""
    given = "early_close_minutes_local" if "early_close_minutes_local" in df.columns else None
    early = F.col("is_early_close") if "is_early_close" in df.columns else F.lit(False)
    return df.withColumns(
        {"session_date": session_date(ts, zone), "session_minutes": session_minutes(early, given)}
    ).withColumn("minute_of_session", minute_of_session(ts, "session_minutes", zone))


def in_last_minutes(n: int) -> Column:
    minute = F.col("minute_of_session")
    return minute.isNotNull() & (minute > F.col("session_minutes") - n)


def with_session_features(df: DataFrame) -> DataFrame:
    """Hour bucket, first/last hour, countdown and progress from the session clock."""
    minute, length = F.col("minute_of_session"), F.col("session_minutes")
    return df.withColumns(
        {
            "hour_of_session": (F.floor((minute - 1) / 60) + 1).cast("int"),
            "is_first_hour": minute.isNotNull() & (minute <= 60),
            "is_last_hour": in_last_minutes(60),
            "minutes_until_close": length - minute + 1,
            "session_progress": minute / length,
        }
    )


def session_bounds(date: Column | str, early: Column | None = None, zone: str = EXCHANGE_ZONE) -> dict[str, Column]:
    """UTC open and close of a session date."""
    open_local = F.to_timestamp_ntz(F.concat_ws(" ", col(date).cast("string"), F.lit("09:30:00")))
    minutes = session_minutes(F.lit(False) if early is None else early)
    to_utc = lambda local: F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    close_local = open_local + F.make_dt_interval(mins=minutes)
    return {"session_open": to_utc(open_local), "session_close": to_utc(close_local)}


def is_regular_time(ts: Column | str, early: Column | None = None, zone: str = EXCHANGE_ZONE) -> Column:
    """Local time of day between open and close, both included."""
    local = local_time(ts, zone)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    close = (F.lit(OPEN_MINUTE) + session_minutes(F.lit(False) if early is None else early)) * 60
    return (second >= OPEN_MINUTE * 60) & (second <= close)


def minute_number(ts: Column | str, session_open: Column | str) -> Column:
    """Whole minutes since the given open, plus one."""
    seconds = F.unix_timestamp(col(ts).cast("timestamp")) - F.unix_timestamp(col(session_open).cast("timestamp"))
    return F.floor(seconds / 60) + 1


def session_flags(df: DataFrame, flags: Sequence[str], series: Series = Series(), ts: str = "timestamp") -> DataFrame:
    """One row per session with each flag's first value of the day."""
    return df.groupBy(*series.by_session).agg(
        *[F.min_by(F.col(c), F.struct(F.col(ts))).alias(c) for c in flags]
    )


def days_to_next(event: Column | str, series: Series = Series()) -> Column:
    """Calendar days to the next flagged session (0 on the day itself), null after the last."""
    ahead = series.days().rowsBetween(0, Window.unboundedFollowing)
    date = F.col(series.session)
    return F.datediff(F.min(F.when(col(event), date)).over(ahead), date)


def distinct_sessions(df: DataFrame, series: Series = Series()) -> DataFrame:
    return df.select(*series.by_session).distinct()


def last_sessions(df: DataFrame, n: int, series: Series = Series()) -> DataFrame:
    """Keep the rows of each instrument's last n sessions."""
    latest = F.row_number().over(Window.partitionBy(*series.keys).orderBy(F.col(series.session).desc()))
    kept = distinct_sessions(df, series).withColumn("_rank", latest).filter(F.col("_rank") <= n).drop("_rank")
    return df.join(kept, series.by_session, "left_semi")
