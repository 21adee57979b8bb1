"""Later sessions never change earlier features."""

import pytest
from pyspark.sql import functions as F

from catalog.sessions_and_measures import daily
from marketrisk.functions.columns import prefixed
from marketrisk.functions.lineage import checkpointed
from marketrisk.operators import macro, path, regime, targets, technical, volatility
from marketrisk.series import Series

SERIES = Series()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def days(spark):
    return checkpointed(targets.with_z_score(targets.with_next_day(daily(spark, SF_DIR), SERIES), SERIES))


def path_family(df):
    return path.with_momentum(path.with_cumulative(path.with_ranges(path.with_gaps(df, SERIES), SERIES), SERIES), SERIES)


FAMILIES = {
    "vr_": lambda df: volatility.volatility_features(df, SERIES),
    "path_": path_family,
    "reg_": lambda df: regime.regime_features(df, SERIES),
    "time_d": lambda df: macro.with_date_parts(df, SERIES),
    ("rsi", "macd", "sma_", "ema_", "obv", "mfi", "adx", "atr", "trend_"): lambda df: technical.technical_features(df, SERIES),
}


@pytest.mark.parametrize("prefix", list(FAMILIES), ids=str)
def test_future_rows_do_not_change_the_past(days, prefix):
    cut = F.lit("1999-06-30").cast("date")
    early = lambda df: df.filter(F.col("session_date") <= cut)
    full, short = early(FAMILIES[prefix](days)), FAMILIES[prefix](early(days))
    columns = prefixed(short, prefix)
    assert columns
    # z_score_next of the last day looks one day ahead by definition; its lags do not
    a = full.select("session_date", *columns).orderBy("session_date").collect()
    b = short.select("session_date", *columns).orderBy("session_date").collect()
    assert len(a) == len(b) > 500
    for x, y in zip(a, b):
        for c in columns:
            assert x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-12) if isinstance(x[c], float) else x[c] == y[c], (c, x["session_date"])


def test_full_history_variants_do_look_ahead(days):
    cut = F.lit("1999-06-30").cast("date")
    whole = regime.with_variance_ratio(regime.with_decayed(days, SERIES), SERIES, point_in_time=False)
    short = days.filter(F.col("session_date") <= cut)
    part = regime.with_variance_ratio(regime.with_decayed(short, SERIES), SERIES, point_in_time=False)
    both = whole.select("session_date", F.col("reg_vr_quintile").alias("a")).join(
        part.select("session_date", F.col("reg_vr_quintile").alias("b")), "session_date"
    )
    assert both.filter("a != b").count() > 0


def test_identities(days):
    bad = days.filter(
        (F.col("JV_daily") < 0)
        | (F.abs(F.col("upside_var") + F.col("downside_var") - F.col("RV_daily")) > 1e-12)
        | (F.col("daily_high") < F.col("daily_low"))
    )
    assert bad.count() == 0
