"""Ranking curves when nearly all scores crowd at one end, and statistics of the days so far over a long history."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketrisk.functions.frames import with_expanding
from marketrisk.operators import metrics
from marketrisk.series import Series


def test_crowded_scores(spark):
    rng = np.random.default_rng(7)
    p = np.where(rng.random(3000) < 0.99, 0.999 + 0.001 * rng.random(3000), rng.random(3000))
    pdf = pd.DataFrame({"p_boom": p, "p_crash": (1 - p) / 2, "p_normal": (1 - p) / 2, "y_true": rng.integers(0, 3, 3000)})
    got = {r["class"]: r["roc_auc"] for r in metrics.ranking_scores(spark.createDataFrame(pdf)).collect()}
    for row in metrics.ranked_scores(spark.createDataFrame(pdf)).groupBy("class").agg(F.max("all_so_far").alias("n"), F.max("N").alias("all")).collect():
        assert row["n"] == row["all"] == 3000
    columns = dict(zip(range(3), ("p_crash", "p_normal", "p_boom"), strict=True))
    for k, (label, auc) in enumerate(sorted(got.items(), key=lambda kv: str(kv[0]))):
        score = pdf[columns[k]] if str(label) in ("0", "1", "2") else pdf[f"p_{label}"]
        truth = pdf["y_true"] == (k if str(label) in ("0", "1", "2") else {"crash": 0, "normal": 1, "boom": 2}[label])
        rank = score.rank()
        want = (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
        assert abs(auc - want) < 1e-9


def test_days_so_far_grow_linearly(spark):
    series, spent = Series(), {}
    for days in (2_500, 25_000):
        df = spark.range(days).select(
            F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("session_date"),
            F.when(F.col("id") % 9 != 4, F.sin(F.col("id") * 12.9898)).alias("x"),
        )
        start = time.perf_counter()
        got = with_expanding(df, series, {"q": ("x", 0.95), "rank": ("x", None)}).toPandas().sort_values("session_date")
        spent[days] = time.perf_counter() - start
        x = got["x"].astype(float).expanding(1)
        np.testing.assert_allclose(got["q"].astype(float), x.quantile(0.95), atol=1e-12)
        np.testing.assert_allclose(got["rank"].astype(float), x.rank(pct=True), atol=1e-12)
    assert spent[25_000] < 15 * max(spent[2_500], 1.0)
