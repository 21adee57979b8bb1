import datetime as dt

from pyspark.sql import functions as F

from marketrisk.operators import calendar as cal
from marketrisk.operators.joins import released
from marketrisk.operators.macro import with_date_parts, with_holiday_distance
from marketrisk.series import Series


def test_clock_follows_daylight_saving(spark):
    rows = [("2024-01-10 14:30:00",), ("2024-07-10 13:30:00",), ("2024-07-10 13:29:00",), ("2024-07-11 01:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp_ntz("t").alias("timestamp"))
    got = cal.with_session_features(cal.with_session_clock(df)).orderBy("timestamp").collect()
    assert [r["minute_of_session"] for r in got] == [1, None, 1, None]
    assert got[3]["session_date"] == dt.date(2024, 7, 10)  # still the evening before in New York
    assert got[0]["is_first_hour"] and not got[0]["is_last_hour"]
    assert got[0]["minutes_until_close"] == 390


def test_bounds_and_early_close(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10), False), (dt.date(2024, 7, 3), True)], "session_date date, early boolean")
    got = df.select(*[c.alias(n) for n, c in cal.session_bounds("session_date", F.col("early")).items()]).collect()
    assert got[0]["session_open"] == dt.datetime(2024, 1, 10, 14, 30)
    assert got[0]["session_close"] == dt.datetime(2024, 1, 10, 21, 0)
    assert got[1]["session_close"] == dt.datetime(2024, 7, 3, 17, 0)


def test_release_dates_skip_weekends(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 6, 7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r["r"].day for r in df.withColumn("r", released(df, "d")).orderBy("d").collect()]
    assert got == [4, 5, 8, 9, 10, 10, 10]


def test_last_sessions_and_event_distance(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), i in (3, 7)) for i in range(10)]
    df = spark.createDataFrame(rows, "session_date date, is_opx boolean")
    got = df.select("session_date", cal.days_to_next("is_opx").alias("d")).orderBy("session_date").collect()
    assert [r["d"] for r in got] == [3, 2, 1, 0, 3, 2, 1, 0, None, None]
    assert cal.last_sessions(df, 4).count() == 4


def test_holiday_distances_count_trading_days(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), i == 2) for i in range(5)]
    df = spark.createDataFrame(rows, "session_date date, is_holiday boolean")
    got = with_holiday_distance(df, Series()).orderBy("session_date").collect()
    assert [r["time_days_until_holiday"] for r in got] == [2, 1, None, None, None]
    assert [r["time_days_since_holiday"] for r in got] == [None, None, None, 1, 2]
    monday = with_date_parts(df, Series()).orderBy("session_date").first()
    assert monday["time_day_of_week"] == 0
