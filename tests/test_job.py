"""The whole job on the smallest tables, from bars to written reports."""

from pyspark.sql import functions as F

from marketrisk.heads.classifiers import elastic_net_logistic, random_forest
from marketrisk.operators.folds import WalkForward
from marketrisk.plans import features, tables


def test_run_writes_features_predictions_and_reports(spark, tmp_path):
    minutes, series = tables.ticks(spark, "/root/testdata/sf0.001")
    bases = {
        "forest": lambda t: random_forest(t, trees=3, depth=3),
        "elastic_net": lambda t: elastic_net_logistic(t, rounds=5),
    }
    plan = WalkForward(n_splits=3, min_train=400, test=150)
    features.run(minutes, series, str(tmp_path), gamma=0.1, plan=plan, first_test="2000-01-01", bases=bases)
    table = spark.read.parquet(str(tmp_path / "features"))
    made = [c for c in table.columns if c.startswith(features.FEATURE_PREFIXES)]
    assert len(made) > 250 and table.count() > 2000
    scored = spark.read.csv(str(tmp_path / "predictions"), header=True, inferSchema=True)
    assert scored.count() == 150
    assert scored.filter(F.abs(F.col("p_crash") + F.col("p_normal") + F.col("p_boom") - 1) > 1e-6).count() == 0
    for name in ("classes", "summary", "confusion", "utility_cells", "reliability", "thresholds"):
        assert spark.read.csv(str(tmp_path / "reports" / name), header=True).count() > 0
