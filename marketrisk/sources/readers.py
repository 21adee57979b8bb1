"""Readers for minute and daily tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.operators.joins import left_with_suffix
from marketrisk.sources.schema import MINUTE_SCHEMA, QUOTE, as_utc, null_before, typed, with_missing_columns

QUOTES_FROM = "2020-08-28"


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Minute parquet, completed to the schema, UTC, quotes null before their feed started."""
    return prepared(spark.read.parquet(path))


def read_minutes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Minute CSV read as text (one scan, no inference), then typed with the null tokens."""
    return prepared(spark.read.csv(path, header=True))


def prepared(raw: DataFrame) -> DataFrame:
    # a raw timestamp may be zoneless; it counts as UTC
    complete = typed(with_missing_columns(raw), T.StructType(MINUTE_SCHEMA.fields[1:]))
    return null_before(as_utc(complete), QUOTE, QUOTES_FROM)


def read_daily_csv(spark: SparkSession, path: str, schema: T.StructType | str, date: str = "date") -> DataFrame:
    """Daily CSV with an explicit schema, read as text and typed with the null tokens; order is left to the windows that need it."""
    wanted = spark.createDataFrame([], schema).schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    df = typed(spark.read.csv(path, header=True, schema=as_text), wanted)
    return df.withColumn(date, F.to_date(date))


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | str, date: str = "date") -> DataFrame | None:
    """A side table, or None when its path does not exist."""
    try:
        return read_daily_csv(spark, path, schema, date)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def with_side_tables(daily: DataFrame, sides: Mapping[str, DataFrame | None], date: str = "date") -> DataFrame:
    """Left-join the side tables that exist; clashing columns get the table's name as suffix."""
    out = daily
    for name, side in sides.items():
        if side is not None and date in side.columns:
            out = left_with_suffix(out, side, [date], name)
    return out
