"""Cut-up groups give the same answers as whole ones, also when one group dominates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketrisk.functions import ordered
from marketrisk.functions.frames import rolling_frames
from marketrisk.operators.intraday import with_cumulative_return
from marketrisk.series import Series, owned

HOT_ROWS, SMALL_ROWS = 3000, 40


@pytest.fixture(scope="module")
def rows(spark):
    """One session with nearly all rows and twenty small ones."""
    hot = spark.range(HOT_ROWS).select(F.lit("hot").alias("session_date"), F.col("id").alias("clock"))
    small = spark.range(SMALL_ROWS * 20).select(
        F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("session_date"), F.col("id").alias("clock")
    )
    value = F.round(F.sin(F.col("clock") * 12.9898) * 50, 3)
    return hot.unionByName(small).withColumn("x", F.when(F.col("clock") % 11 != 3, value)).repartition(7)


@pytest.fixture(scope="module")
def numbered(rows):
    return ordered.positioned(
        rows, ["session_date"], ["clock"], F.floor(F.col("clock") / 64), "minute_of_session", "session_rows"
    )


def test_positions_equal_plain_row_numbers(rows, numbered):
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_date").orderBy("clock")))
    both = numbered.join(plain, ["session_date", "clock"])
    assert both.count() == HOT_ROWS + SMALL_ROWS * 20
    assert both.filter(F.col("n") != F.col("minute_of_session")).count() == 0
    sizes = {r["session_date"]: r["session_rows"] for r in numbered.select("session_date", "session_rows").distinct().collect()}
    assert sizes["hot"] == HOT_ROWS and sizes["s3"] == SMALL_ROWS


def test_blocks_keep_every_row_once_and_frames_exact(numbered):
    cut, series = ordered.blocked(numbered, Series(), look_back=30, rows=100)
    assert owned(cut, series).count() == numbered.count()
    largest = cut.groupBy("session_date", "block").count().agg(F.max("count")).first()[0]
    assert largest <= 100 + 30
    wanted = {"m": ("mean", "x", 30, 5), "s": ("std", "x", 30, 5), "t": ("sum", "x", 10, 1)}
    got = owned(rolling_frames(cut, series.minutes(), wanted), series).toPandas()
    got = got.sort_values(["session_date", "minute_of_session"])
    for _, g in got.groupby("session_date"):
        x = g["x"].astype(float).reset_index(drop=True)
        for name, expected in {
            "m": x.rolling(30, min_periods=5).mean(),
            "s": x.rolling(30, min_periods=5).std(),
            "t": x.rolling(10, min_periods=1).sum(),
        }.items():
            np.testing.assert_allclose(g[name].astype(float), expected, rtol=1e-9, atol=1e-9)


def test_cumulative_return_in_two_levels(numbered):
    series = Series(block="block")
    got = with_cumulative_return(numbered, series, "x", rows_per_bucket=64).toPandas()
    got = got.sort_values(["session_date", "minute_of_session"])
    for _, g in got.groupby("session_date"):
        np.testing.assert_allclose(g["session_cumulative_return"].astype(float), g["x"].astype(float).cumsum(), atol=1e-9)


@pytest.mark.parametrize("accuracy", [20_000, 2_000])
def test_exact_quantiles_by_group(rows, accuracy, monkeypatch):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", accuracy)
    got = ordered.exact_quantiles(rows, ["session_date"], {"a": ("x", 0.25), "b": ("x", 0.99)}, salt_by="clock").toPandas()
    expected = rows.toPandas().groupby("session_date")["x"].quantile([0.25, 0.99]).unstack()
    got = got.set_index("session_date").sort_index()
    np.testing.assert_allclose(got["a"], expected[0.25].sort_index(), atol=1e-12)
    np.testing.assert_allclose(got["b"], expected[0.99].sort_index(), atol=1e-12)


def test_exact_quantiles_with_massive_ties(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 50)
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(7.0).alias("x"))
    got = ordered.exact_quantiles(df, [], {"a": ("x", 0.5), "b": ("x", 0.9)}).first()
    x = df.toPandas()["x"]
    assert got["a"] == x.quantile(0.5)
    assert got["b"] == pytest.approx(x.quantile(0.9))


def test_running_totals_descending(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") / 500).alias("s"), F.lit(1).alias("one"))
    got = ordered.running_totals(df, ["g"], [F.col("s").desc()], F.floor(F.col("s") * 16), {"n": "one"}, True)
    pdf: pd.DataFrame = got.toPandas().sort_values(["g", "s"], ascending=[True, False])
    for _, g in pdf.groupby("g"):
        assert g["n"].tolist() == list(range(1, len(g) + 1))


def test_one_session_with_most_rows(spark):
    """A session of any size takes the same path to its quantiles."""
    df = spark.range(60_000).select(
        F.when(F.col("id") < 55_000, 0).otherwise(F.col("id") % 50).alias("session_date"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 10_007 / 3).alias("x"),
        F.col("id").alias("clock"),
    )
    got = ordered.exact_quantiles(df, ["session_date"], {"a": ("x", 0.75), "b": ("x", 0.011)}, salt_by="clock").toPandas()
    expected = df.toPandas().groupby("session_date")["x"].quantile([0.75, 0.011]).unstack()
    got = got.set_index("session_date").sort_index()
    np.testing.assert_allclose(got["a"], expected[0.75], atol=1e-12)
    np.testing.assert_allclose(got["b"], expected[0.011], atol=1e-12)


def test_quantiles_in_place_of_sessions_of_every_size(spark, monkeypatch):
    """Counters decide small sessions; those with more values between the edges go on; ties, nulls and one-row sessions too."""
    monkeypatch.setattr(ordered, "WIDE_ACCURACY", 200)
    df = spark.range(30_000).select(
        F.when(F.col("id") < 25_000, 0).when(F.col("id") == 29_999, 77).otherwise(F.col("id") % 40 + 1).alias("session_date"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 10_007 / 3).alias("x"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 5).cast("double").alias("ties"),
        F.lit(None).cast("double").alias("none"),
        F.col("id").alias("clock"),
    )
    wanted = {"a": ("x", 0.75), "b": ("ties", 0.75), "c": ("none", 0.75), "d": ("x", 0.011)}
    sketches = df.groupBy("session_date").agg(*ordered.sketch_aggs(wanted, 200))
    got = ordered.quantiles_in_place(df, sketches, ["session_date"], wanted, "clock").toPandas()
    got = got.set_index("session_date").sort_index()
    pdf = df.toPandas().groupby("session_date")
    assert len(got) == 42 and got["c"].isna().all()
    for name, (column, level) in wanted.items():
        if name != "c":
            np.testing.assert_allclose(got[name], pdf[column].quantile(level), atol=1e-12)


def test_rolling_frames_survive_nan_and_spikes(spark):
    """A NaN or an opening print far from the rest touches only the frames that hold it."""
    x = [5e7] + [1000 + (k * 37 % 11) / 7 for k in range(1, 400)]
    y = [float("nan") if k == 5 else float(k % 13) for k in range(400)]
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(zip(x, y, strict=True))], "g int, k int, x double, y double")
    window = Window.partitionBy("g").orderBy("k")
    wanted = {"dev": ("std", "x", 30, 10), "mean": ("mean", "y", 30, 10)}
    got = rolling_frames(df, window, wanted).toPandas().sort_values("k").reset_index(drop=True)
    series = got["x"].rolling(30, min_periods=10).apply(lambda v: np.std(v, ddof=1))
    np.testing.assert_allclose(got["dev"][40:], series[40:], rtol=1e-9)
    assert got["mean"][40:].notna().all()


def test_rolling_frames_of_every_length(spark):
    """Frames are put together from runs of 1, 4, 16 and 64 rows: every digit of a length occurs, with nulls and all kinds."""
    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(100, 3, 300)]
    df = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(x)], "g int, k int, x double")
    window = Window.partitionBy("g").orderBy("k")
    lengths = [1, 2, 3, 4, 5, 7, 15, 16, 17, 30, 63, 64, 120, 127]
    wanted = {f"{kind}{n}": (kind, "x", n, max(1, n // 3)) for n in lengths for kind in ("mean", "std", "sum")}
    got = rolling_frames(df, window, wanted).toPandas().sort_values(["g", "k"])
    assert set(got.columns) == {"g", "k", "x", *wanted}
    for _, g in got.groupby("g"):
        values = g["x"].astype(float).reset_index(drop=True)
        for name, (kind, _, n, least) in wanted.items():
            frames = values.rolling(n, min_periods=min(n, max(least, 2)) if kind == "std" else least)
            expected = {"mean": frames.mean, "std": frames.std, "sum": frames.sum}[kind]()
            np.testing.assert_allclose(g[name].astype(float), expected, rtol=1e-9, atol=1e-9, err_msg=name)


def test_rolling_frames_across_batches_in_one_window(spark):
    """Batches cut groups anywhere, filters stay behind the frames, and one window numbers the rows."""
    df = spark.range(900).select(
        (F.col("id") % 4).alias("g"), "id", F.when(F.col("id") % 7 != 0, F.sin(F.col("id") * 12.9)).alias("x")
    )
    wanted = {"m": ("mean", "x", 30, 10), "s": ("std", "x", 70, 10), "t": ("sum", "x", 120, 40)}
    out = rolling_frames(df, Window.partitionBy("g").orderBy("id"), wanted).filter("id >= 100")
    assert out._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = out.toPandas().sort_values(["g", "id"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = df.toPandas().sort_values(["g", "id"])
    x = pdf.groupby("g")["x"]
    late = (pdf["id"] >= 100).to_numpy()
    for name, expected in {
        "m": x.transform(lambda v: v.rolling(30, 10).mean()),
        "s": x.transform(lambda v: v.rolling(70, 10).std()),
        "t": x.transform(lambda v: v.rolling(120, 40).sum()),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), expected[late], rtol=1e-9, atol=1e-9)


def test_quantiles_in_place_of_a_large_session_need_no_further_look(spark, monkeypatch):
    """A session of many values between its edges is decided by one look; NaN is the largest value, keys may be several."""

    def further(*args):
        raise AssertionError("another look at the rows")

    monkeypatch.setattr(ordered, "quantiles_between", further)
    df = spark.range(40_000).select(
        F.lit("a").alias("symbol"),
        (F.col("id") % 2).alias("day"),
        (F.col("id") * 7919 % 10_007 / 3).alias("x"),
        F.when(F.col("id") % 5 < 2, F.lit(float("nan"))).otherwise(F.col("id") % 9).alias("y"),
        F.col("id").alias("clock"),
    )
    wanted = {"a": ("x", 0.75), "b": ("x", 0.3), "c": ("y", 0.25), "d": ("y", 0.9)}
    sketches = df.groupBy("symbol", "day").agg(*ordered.sketch_aggs(wanted, 100))
    got = ordered.quantiles_in_place(df, sketches, ["symbol", "day"], wanted, "clock").toPandas().sort_values("day")
    pdf = df.toPandas().groupby("day")
    np.testing.assert_allclose(got["a"], pdf["x"].quantile(0.75), atol=1e-12)
    np.testing.assert_allclose(got["b"], pdf["x"].quantile(0.3), atol=1e-12)
    np.testing.assert_allclose(got["c"], pdf["y"].apply(lambda v: np.sort(v)[round(0.25 * len(v))]), atol=1e-12)
    assert got["d"].isna().all()
