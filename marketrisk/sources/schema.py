"""The minute-table schema and tolerant typing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed column names of the minute table, by family.
BAR = ("open", "high", "low", "close", "volume", "vwap")
QUOTE = ("iex_bid_price", "iex_bid_size", "iex_ask_price", "iex_ask_size")
OHLCV = ("Open", "High", "Low", "Close", "Volume")
MACRO = ("umcsi", "us_policy_uncertainty", "cboe_VIXCLS")
FLAGS = ("is_holiday", "is_early_close", "is_weekly", "is_monthly_third_friday", "is_quarterly_eoq", "is_opx")
REQUIRED = ("timestamp", "ohlcv_close", "ohlcv_volume")
NULL_TOKENS = ("", "NA", "null", "None", "NaN")

_DOUBLES = (
    *(f"ohlcv_{c}" for c in BAR),
    *QUOTE,
    *(f"sip_{c}" for c in OHLCV),
    *(f"eod_{c}" for c in OHLCV),
    *MACRO,
    "early_close_minutes_local",
)
MINUTE_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField(c, T.BooleanType()) for c in FLAGS]
)


def untokened(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Text with the null tokens turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.trim(c).isin(*tokens), F.trim(c))


def typed(df: DataFrame, schema: T.StructType = MINUTE_SCHEMA) -> DataFrame:
    """Cast known columns, bad values and NaN to null, booleans null to false; other columns pass through."""
    kinds = {f.name: f.dataType for f in schema.fields}
    given = {f.name: f.dataType for f in df.schema.fields}

    def one(name: str) -> Column:
        if name not in kinds:
            return F.col(name)
        source = untokened(name) if isinstance(given[name], T.StringType) else F.col(name)
        value = source if given[name] == kinds[name] else source.try_cast(kinds[name])
        if isinstance(kinds[name], T.DoubleType | T.FloatType):
            value = F.when(~F.isnan(value), value)  # a NaN would spoil every sum it meets
        if isinstance(kinds[name], T.BooleanType):
            value = F.coalesce(value, F.lit(False))
        return value.alias(name)

    return df.select([one(c) for c in df.columns])


def missing_columns(df: DataFrame, schema: T.StructType = MINUTE_SCHEMA) -> list[str]:
    return [f.name for f in schema.fields if f.name not in df.columns]


def with_missing_columns(
    df: DataFrame, schema: T.StructType = MINUTE_SCHEMA, required: Sequence[str] = REQUIRED
) -> DataFrame:
    """Add absent columns as typed nulls (booleans false); fail when a required one is absent."""
    absent = set(missing_columns(df, schema))
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing required columns: {lacking}")

    def blank(kind: T.DataType) -> Column:
        return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)

    return df.withColumns({f.name: blank(f.dataType) for f in schema.fields if f.name in absent})


def as_utc(df: DataFrame, column: str = "timestamp", zone: str | None = None) -> DataFrame:
    """Read a naive timestamp as UTC, or convert it from its zone."""
    ts = F.col(column)
    local = ts if zone is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return df.withColumn(column, local.cast("timestamp"))


def null_before(df: DataFrame, columns: Sequence[str], cutoff: str, ts: str = "timestamp") -> DataFrame:
    """Force columns to null before the date they became available."""
    early = F.col(ts) < F.lit(cutoff).cast("timestamp")
    return df.withColumns({c: F.when(~early, F.col(c)) for c in columns})
