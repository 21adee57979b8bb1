"""Market tables derived from the supplied parquet tables.

The supplied tables hold no market data, so sessions, bars, quotes, macro levels,
calendar flags and predictions are derived from them row by row (no row is left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketrisk.functions.lineage import checkpointed
from marketrisk.functions.ordered import blocked, positioned
from marketrisk.series import Series

# Order keys per numbering bucket: a few lines each, so a bucket stays at some ten million
# rows even when all its lines fall on one session.
ORDER_KEYS_PER_BUCKET = 1 << 22
TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
BAR_COLUMNS = [
    "ohlcv_open",
    "ohlcv_high",
    "ohlcv_low",
    "ohlcv_close",
    "ohlcv_volume",
    "ohlcv_vwap",
    "iex_bid_price",
    "iex_ask_price",
    "iex_bid_size",
    "iex_ask_size",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unrounded_bars() -> dict[str, Column]:
    level = 100 * F.pow(F.col("l_extendedprice") / F.col("l_quantity") / 1500, F.lit(0.02))
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return {
        "ohlcv_open": level,
        "ohlcv_high": level * (1 + tax / 10),
        "ohlcv_low": level * (1 - discount / 10),
        "ohlcv_close": level * (1 + (tax - discount) / 20),
    }


def six(x: Column) -> Column:
    """Six decimals by plain arithmetic (stays inside generated code)."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def order_lines(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The line columns bars are made of, with the session date and instrument key."""
    source = {"symbol": F.col("l_returnflag")}
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("session_date"),
        *[source[k].alias(k) for k in keys],
        *TICK_ORDER,
        "l_quantity",
        "l_discount",
        "l_tax",
    )


def bars(lines: DataFrame) -> DataFrame:
    """One bar per order line; prices have 6 decimals."""
    close = F.col("ohlcv_close")
    return (
        lines.withColumns({n: six(c) for n, c in _unrounded_bars().items()})
        .withColumns(
            {
                "ohlcv_volume": F.col("l_quantity"),
                "ohlcv_vwap": six((F.col("ohlcv_high") + F.col("ohlcv_low") + close) / 3),
                "iex_bid_price": six(close * (1 - 0.0005 - F.col("l_discount") / 100)),
                "iex_ask_price": six(close * (1 + 0.0005 + F.col("l_tax") / 100)),
                "iex_bid_size": F.col("l_quantity"),
                "iex_ask_size": (F.col("l_linenumber") * 10).cast("double"),
            }
        )
        .drop(*TICK_ORDER, "l_quantity", "l_discount", "l_tax")
    )


def _positioned_lines(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    return positioned(
        order_lines(spark, sf_dir, keys),
        Series(keys=keys).by_session,
        TICK_ORDER,
        F.floor(F.col("l_orderkey") / F.lit(ORDER_KEYS_PER_BUCKET)),
        position="minute_of_session",
        size="session_rows",
    )


def ticks(
    spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = (), look_back: int = 120
) -> tuple[DataFrame, Series]:
    """Minute bars with exact positions, cut into blocks that lead with ``look_back`` rows.

    The narrow line columns go through the shuffles; bars are computed after them.
    """
    cut, series = blocked(_positioned_lines(spark, sf_dir, keys), Series(keys=keys), look_back)
    return bars(cut), series


def kept_ticks(
    spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = (), look_back: int = 120
) -> tuple[DataFrame, Series, DataFrame]:
    """:func:`ticks` and, third, :func:`sessions_of_ticks`, for jobs that look at the minutes several times.

    The positioned lines are checkpointed, still narrow: no further look numbers them anew, and those that need no
    look-back read them without a shuffle.
    """
    lines = checkpointed(_positioned_lines(spark, sf_dir, keys))
    cut, series = blocked(lines, Series(keys=keys), look_back)
    return bars(cut), series, bars(lines)


def sessions_of_ticks(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Minute bars with exact positions and session sizes, not cut into blocks."""
    return bars(_positioned_lines(spark, sf_dir, keys))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped rows from the event stream, with early closes and some nulls."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("ohlcv_close"),
        F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("iex_bid_price"),
        F.col("value").alias("ohlcv_volume"),
        (F.dayofmonth("ts") % 10 == 0).alias("is_early_close"),
        F.when(F.dayofmonth("ts") % 20 == 0, F.lit(180.0)).alias("early_close_minutes_local"),
        (F.col("event_type") == "error").alias("is_opx"),
    )


def macro_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two monthly levels from orders, stamped with the first day of the month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"))
        .agg(
            six(F.avg("o_totalprice") / 1000).alias("umcsi"),
            six(F.max("o_totalprice") / 1000).alias("us_policy_uncertainty"),
        )
    )


def macro_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily level from orders."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(six(F.avg("o_totalprice") / 12000).alias("cboe_VIXCLS"))
    )


def is_opx() -> Column:
    """Third Friday of the month."""
    day = F.col("session_date")
    return (F.weekday(day) == 4) & F.dayofmonth(day).between(15, 21)


def is_holiday() -> Column:
    """Fixed-date holidays: 1 January, 4 July, 25 December."""
    return F.date_format("session_date", "MM-dd").isin("01-01", "07-04", "12-25")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored decision per order line: three probabilities and the true class."""
    lines = table(spark, sf_dir, "lineitem")
    a = 1 + F.col("l_linenumber")
    b = 1 + F.col("l_quantity") / 10
    c = 1 + 50 * F.col("l_discount")
    return lines.select(
        F.col("l_shipdate").cast("date").alias("session_date"),
        six(a / (a + b + c)).alias("p_crash"),
        six(b / (a + b + c)).alias("p_normal"),
        six(c / (a + b + c)).alias("p_boom"),
        (F.col("l_partkey") % 3).cast("int").alias("y_true"),
        F.col("l_extendedprice").alias("actual"),
        (1000 * F.col("l_quantity")).alias("predicted"),
    )


def forecast_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast per session date, aggregated from the scored lines."""
    daily = (
        predictions(spark, sf_dir)
        .groupBy("session_date")
        .agg(
            F.round(F.avg("p_crash"), 8).alias("p_crash"),
            F.round(F.avg("p_normal"), 8).alias("p_normal"),
            F.round(F.avg("p_boom"), 8).alias("p_boom"),
            (F.sum("y_true") % 3).cast("int").alias("y_true"),
            F.round(F.log(F.avg("actual")), 8).alias("actual_log_rv"),
            F.round(F.log(F.avg("predicted")), 8).alias("predicted_log_rv"),
            # the small shift keeps exact halves, common here, from rounding differently elsewhere
            F.round((F.avg("actual") / F.avg("predicted") - 1.5) / 1000 + 1.37e-10, 8).alias("actual_return"),
            F.round(F.avg("p_boom") - F.avg("p_crash"), 8).alias("predicted_return"),
            F.count(F.lit(1)).alias("training_size"),
        )
    )
    names = F.array(F.lit("crash"), F.lit("normal"), F.lit("boom"))
    best = (
        F.when((F.col("p_crash") >= F.col("p_normal")) & (F.col("p_crash") >= F.col("p_boom")), 0)
        .when(F.col("p_normal") >= F.col("p_boom"), 1)
        .otherwise(2)
    )
    return (
        daily.withColumn("y_pred", best)
        .withColumn("actual_label", F.get(names, F.col("y_true")))
        .withColumn("predicted_label", F.get(names, F.col("y_pred")))
    )
