import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import heads as hd
from marketrisk.functions.lineage import checkpointed
from marketrisk.heads import classifiers as cl
from marketrisk.heads import quantiles as qt
from marketrisk.heads import stacking as st
from marketrisk.operators import decision, folds, metrics

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return checkpointed(hd.vectors(spark, SF_DIR).filter("vec_id % 2 = 0"))


@pytest.mark.parametrize(
    "fit",
    [
        lambda t: cl.boosted_trees(t, rounds=3, depth=2),
        lambda t: cl.random_forest(t, trees=5, depth=3),
        lambda t: cl.elastic_net_logistic(t, rounds=10),
        lambda t: cl.kernel_svm(t, hd.WIDTH, size=20, rounds=3),
    ],
    ids=["boosted", "forest", "logistic", "svm"],
)
def test_probabilities_sum_to_one(vectors, fit):
    scored = fit(vectors).score(vectors)
    worst = scored.agg(F.max(F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1)), F.min("p_0")).first()
    assert worst[0] < 1e-9 and worst[1] >= 0


def test_quantile_forest_orders_and_covers(vectors):
    predict = qt.fit_quantile_forest(vectors, "target", trees=5, depth=3)
    out = qt.monotone(predict(vectors), ["q05", "q50", "q95"])
    assert out.filter("q05 > q50 or q50 > q95").count() == 0
    inside = out.agg(F.avg((F.col("target").between(F.col("q05"), F.col("q95"))).cast("double"))).first()[0]
    assert inside > 0.8


def test_conformal_radius_is_numpy_quantile(spark):
    errors = np.arange(1.0, 41.0)
    df = spark.createDataFrame([(float(e), 0.0) for e in errors], "y double, m double")
    level = np.ceil(0.9 * 41) / 40
    assert qt.conformal_radius(df, "y", "m") == pytest.approx(np.quantile(errors, level))


def test_out_of_fold_rows_are_test_rows_only(vectors):
    plan = folds.WalkForward(n_splits=2, min_train=100, test=40)
    table = folds.fold_table(vectors, plan, "vec_id")
    rows = folds.assigned(vectors, table, "vec_id")
    oof = st.out_of_fold(rows, {"forest": lambda t: cl.random_forest(t, trees=3, depth=2)}, [1, 2])
    assert oof.count() == 80 and oof.select("vec_id").distinct().count() == 80


def test_disagreement_is_population_variance(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0.0, 0.0, 0.0, 1.0)], "a_p_0 double, a_p_1 double, a_p_2 double, b_p_0 double, b_p_1 double, b_p_2 double")
    assert st.with_disagreement(df, ["a", "b"]).first()["disagreement"] == pytest.approx(np.var([0, 2]))


def test_threshold_grid_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 300).round(3)
    p[:20, 0] = np.linspace(0.2, 0.8, 100)[:20]  # exactly on thresholds
    y = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(p, y)], "p_crash double, p_normal double, p_boom double, y_true int")
    for mode in decision.MODES:
        grid = decision.threshold_grid(df, mode=mode).orderBy("tau_crash", "tau_boom").toPandas()
        taus, matrix = np.linspace(0.2, 0.8, 100), np.array(decision.UTILITY)
        c, b = p[:, 0], p[:, 2]
        likelier = np.where(c > b, 0, 2)
        expected = []
        for tc in taus:
            for tb in taus:
                d = np.where(c >= tc, 0, likelier if mode != "standard" else 1)
                d = np.where(b >= tb, 2, d)
                d = np.where((c >= tc) & (b >= tb), likelier, d)
                expected.append(matrix[d, y].mean())
        np.testing.assert_allclose(grid["utility"], expected, atol=1e-12)


def test_ranking_scores_with_one_class_only(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 0), (0.4, 0.4, 0.2, 0)], "p_crash double, p_normal double, p_boom double, y_true int")
    got = {r["class"]: r for r in metrics.ranking_scores(df).collect()}
    assert got["crash"]["aucpr"] == pytest.approx(1.0) and got["crash"]["roc_auc"] is None
    assert got["boom"]["roc_auc"] is None
