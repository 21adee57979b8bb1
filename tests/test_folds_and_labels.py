import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketrisk.operators import folds, impute, targets
from marketrisk.series import Series


def dates(spark, n):
    return spark.range(n).select(F.expr("date_add(date'2015-01-01', cast(id as int))").alias("session_date"))


@pytest.mark.parametrize("anchored", [True, False])
def test_folds_are_apart(spark, anchored):
    plan = folds.WalkForward(n_splits=4, min_train=50, test=20, embargo=2, purge=3, anchored=anchored)
    table = folds.fold_table(dates(spark, 300), plan)
    check = folds.leakage_check(table).collect()
    assert len(check) == 4 and all(r["no_leakage"] and r["gap"] == 3 for r in check)
    sizes = {(r["fold"], r["role"]): r["count"] for r in table.groupBy("fold", "role").count().collect()}
    assert all(sizes[(k, "test")] == 20 for k in range(1, 5))


def test_too_few_dates_fail(spark):
    plan = folds.WalkForward()
    assert plan.required == 771
    with pytest.raises(Exception, match="need 771 dates, have 700"):
        folds.fold_status(dates(spark, 700), plan).collect()
    with pytest.raises(Exception, match="not enough groups"):
        folds.group_folds(dates(spark, 100), "session_date").collect()


def test_labels_and_missing_z(spark):
    df = spark.createDataFrame([(-2.0,), (-1.9,), (0.0,), (2.0,), (None,)], "z_score_next double")
    got = targets.with_labels(df, (2.0,)).collect()
    assert [r["label_gamma_2_0"] for r in got] == ["crash", "normal", "normal", "boom", "normal"]
    assert [r["label_gamma_2_0_numeric"] for r in got] == [0, 1, 1, 2, 1]


def test_seven_classes_at_their_edges(spark):
    values = [-0.03, -0.029, -0.015, -0.005, -0.0049, 0.0049, 0.005, 0.015, 0.03, None]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    got = [r[0] for r in df.select(targets.seven_way(F.col("r"))).collect()]
    assert got == [
        "extreme_crash", "crash", "crash", "mild_down", "normal", "normal", "mild_up", "boom", "extreme_boom", "normal",
    ]


def test_targets_respect_instruments(spark):
    rows = [(s, dt.date(2024, 1, d), float(d)) for s in "ab" for d in range(1, 8)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, daily_return double")
    df = df.withColumns({"log_RV_daily": F.col("daily_return"), "daily_return_sum": F.col("daily_return")})
    series = Series(keys=("symbol",))
    got = targets.with_forward_targets(df, series).orderBy("symbol", "session_date").collect()
    assert got[6]["target_return_1d"] is None and got[7]["target_return_1d"] == 2.0
    assert got[0]["target_return_5d"] == 2 + 3 + 4 + 5 + 6 and got[2]["target_return_5d"] is None
    assert targets.without_last_day(df, series).count() == 12


def test_fold_statistics_use_training_rows_only(spark):
    train = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (1, float("inf"))], "fold int, x double")
    test = spark.createDataFrame([(1, 1000.0), (1, None)], "fold int, x double")
    out = impute.standardized(test, impute.fold_statistics(train, ["x"]), ["x"]).collect()
    spread = (0.5) ** 0.5  # values 1, 3, 2, 2 after filling
    assert out[0]["x"] == pytest.approx((1000 - 2) / spread)
    assert out[1]["x"] == pytest.approx(0.0)
