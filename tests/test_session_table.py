"""The session table's looks at the minutes."""

import pytest
from pyspark.sql import functions as F

from marketrisk.plans import features, tables


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with some order lines of a few days, one of them null."""
    at = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    spark.range(500).select(
        n.alias("l_orderkey"),
        (n % 4).cast("int").alias("l_linenumber"),
        (n * 7 % 50).alias("l_partkey"),
        F.when(n % 9 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (n % 3).cast("int")).cast("timestamp")).alias("l_shipdate"),
        (1.0 + n % 50).alias("l_quantity"),
        (1000.0 + n * 13 % 977).alias("l_extendedprice"),
        (n % 10 / 100).alias("l_discount"),
        (n % 8 / 100).alias("l_tax"),
        F.lit("A").alias("l_returnflag"),
    ).write.parquet(f"{at}/lineitem.parquet")
    return at


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_numbered_once(spark, lines):
    """No look numbers the lines anew, and one without look-back shuffles none of them."""
    minutes, series, bars = tables.kept_ticks(spark, lines)
    assert "Exchange" not in _plan(bars)
    assert _plan(minutes).count("Exchange") == 1 and "Window" not in _plan(minutes)
    plain = tables.sessions_of_ticks(spark, lines)
    assert bars.exceptAll(plain).count() == 0 and plain.exceptAll(bars).count() == 0


def test_minute_columns_need_one_shuffle(spark, lines):
    minutes, series, _ = tables.kept_ticks(spark, lines)
    plan = _plan(features.minute_columns(minutes, series))
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1
