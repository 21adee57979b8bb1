import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketrisk.functions.columns import of_type
from marketrisk.sources import quality, readers, schema, sinks


@pytest.fixture()
def minute_csv(tmp_path):
    path = tmp_path / "minutes.csv"
    path.write_text(
        "timestamp,ohlcv_close,ohlcv_volume,iex_bid_price,is_opx,extra\n"
        "2020-08-27 14:00:00,100.5,10,99.5,true,a\n"
        "2020-08-28 14:00:00,NA,12,99.7,None,b\n"
        "2020-08-28 14:01:00,oops,null,,false,c\n"
    )
    return str(path)


def test_csv_null_tokens_types_and_quote_start(spark, minute_csv):
    df = readers.read_minutes_csv(spark, minute_csv)
    rows = df.orderBy("timestamp").collect()
    assert [r["ohlcv_close"] for r in rows] == [100.5, None, None]
    assert [r["ohlcv_volume"] for r in rows] == [10.0, 12.0, None]
    assert [r["iex_bid_price"] for r in rows] == [None, 99.7, None]  # the feed starts on 2020-08-28
    assert [r["is_opx"] for r in rows] == [True, False, False]
    assert set(schema.MINUTE_SCHEMA.names) <= set(df.columns) and "extra" in df.columns
    assert len(of_type(df, type(schema.MINUTE_SCHEMA["is_opx"].dataType))) == 6


def test_required_columns(spark):
    with pytest.raises(ValueError, match="ohlcv_volume"):
        schema.with_missing_columns(spark.range(1).selectExpr("timestamp'2024-01-01' as timestamp", "1.0D as ohlcv_close"))


def test_parquet_minutes_round_trip(spark, tmp_path):
    source = spark.range(5).selectExpr(
        "timestamp'2021-01-04 14:30:00' + make_dt_interval(0, 0, cast(id as int)) as timestamp",
        "cast(id as float) as ohlcv_close",
        "id as ohlcv_volume",
    )
    source.write.parquet(str(tmp_path / "m"))
    df = readers.read_minutes(spark, str(tmp_path / "m"))
    assert dict(df.dtypes)["ohlcv_close"] == "double"
    assert df.agg(F.sum("ohlcv_close")).first()[0] == 10.0


def test_zoned_timestamps_become_utc(spark):
    df = spark.createDataFrame([("2024-07-10 09:30:00",)], "t string").select(F.to_timestamp_ntz("t").alias("timestamp"))
    assert schema.as_utc(df, zone="America/New_York").first()["timestamp"] == dt.datetime(2024, 7, 10, 13, 30)


def test_daily_and_side_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,close,volume\n2024-01-02,10,5\n2024-01-03,11,NA\n")
    (tmp_path / "v.csv").write_text("date,close\n2024-01-03,20\n")
    daily = readers.read_daily_csv(spark, str(tmp_path / "d.csv"), "date string, close double, volume double")
    vix = readers.read_if_present(spark, str(tmp_path / "v.csv"), "date string, close double")
    absent = readers.read_if_present(spark, str(tmp_path / "nothing.csv"), "date string, close double")
    assert absent is None
    out = readers.with_side_tables(daily, {"vix": vix, "policy": absent}).orderBy("date").collect()
    assert [r["close_vix"] for r in out] == [None, 20.0]
    assert out[1]["volume"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2023, 5, 1), 1.0), (dt.date(2024, 5, 1), 2.0)], "session_date date, x double")
    sinks.write_features(df, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).filter("year = 2024")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString()
    sinks.write_reports({"summary": df}, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r" / "summary"), header=True).count() == 2


def test_order_check_sees_bucket_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 2, 5, 4])], "arrival long, ts long")
    for per_bucket in (1, 2, 3, 100):
        assert quality.order_violations(df, "ts", "arrival", per_bucket=per_bucket).first()["violations"] == 2


def test_asserted_raises_on_failures(spark):
    df = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(ValueError, match="duplicate"):
        quality.asserted(df, quality.duplicates(df, ["k"]), "duplicate timestamps")
