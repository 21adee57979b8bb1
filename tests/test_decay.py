import numpy as np
import pytest
from pyspark.sql import functions as F

from marketrisk.functions.decay import with_ewm_mean, with_ewm_recursive, with_ewm_std
from marketrisk.series import Series


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(2 * 900).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("symbol"),
        F.expr("date_add(date'2015-01-01', cast(id div 2 as int))").alias("session_date"),
        F.when(F.col("id") % 7 != 3, F.rand(3)).alias("holed"),
        F.rand(5).alias("full"),
    )


@pytest.mark.parametrize("alpha", [0.06, 1 / 3, 2 / 61, 2 / 101])
def test_decayed_columns_equal_pandas(days, alpha):
    series = Series(keys=("symbol",))
    out = with_ewm_mean(days, {"m": ("holed", alpha)}, series)
    out = with_ewm_std(out, {"s": ("full", alpha)}, series)
    out = with_ewm_recursive(out, {"r": ("full", alpha)}, series)
    assert not [c for c in out.columns if c.startswith("_")]
    pdf = out.toPandas().sort_values(["symbol", "session_date"])
    for _, g in pdf.groupby("symbol"):
        np.testing.assert_allclose(g["m"], g["holed"].ewm(alpha=alpha).mean(), atol=1e-12)
        np.testing.assert_allclose(g["s"], g["full"].ewm(alpha=alpha).std(), atol=1e-9)
        np.testing.assert_allclose(g["r"], g["full"].ewm(alpha=alpha, adjust=False).mean(), atol=1e-12)
