"""Prediction heads; fits run when the query is called."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog import sql as S
from catalog.evaluation import PRED
from catalog.labels_and_folds import UTILITY
from catalog.rounding import rounded
from catalog.sessions_and_measures import ONE, daily
from marketrisk.functions.frames import rolling_mean, rolling_std
from marketrisk.functions.lineage import checkpointed
from marketrisk.heads import classifiers as cl
from marketrisk.heads import quantiles as qt
from marketrisk.heads import stacking as st
from marketrisk.heads import volatility as vh
from marketrisk.heads import walkforward as wf
from marketrisk.operators import folds as fd
from marketrisk.operators import targets as tg
from marketrisk.plans import tables as tb

WIDTH = 64


def vectors(spark, sf):
    """Vectors with a class, a target, balanced weights and one of 500 dates."""
    df = tb.table(spark, sf, "embeddings").select(
        "vec_id",
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("vec_id") % 500).cast("int")).alias("day"),
        (F.col("label") % 3).cast("int").alias("y"),
        F.get(F.col("embedding"), 0).cast("double").alias("target"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return fd.with_class_weights(df, "y").withColumn("label", F.col("y").cast("double"))


def _split(df):
    df = checkpointed(df)
    return df.filter(F.col("vec_id") % 5 != 4), df.filter(F.col("vec_id") % 5 == 4)


def _probabilities(head, df):
    return rounded(head.score(df).select("vec_id", "y", "p_0", "p_1", "p_2"))


def boosted_classifier(spark, sf):
    df = vectors(spark, sf).withColumn("held_out", F.col("vec_id") % 5 == 4)
    return _probabilities(cl.boosted_trees(df, rounds=8, depth=3, rate=0.1, validation="held_out"), df)


def forest_classifier(spark, sf):
    df = vectors(spark, sf)
    return _probabilities(cl.random_forest(_split(df)[0], trees=20, depth=6), df)


def elastic_net_classifier(spark, sf):
    df = vectors(spark, sf)
    return _probabilities(cl.elastic_net_logistic(_split(df)[0], rounds=50), df)


def kernel_svm(spark, sf):
    df = vectors(spark, sf)
    return _probabilities(cl.kernel_svm(_split(df)[0], WIDTH, size=100, rounds=15), df)


def _volatility_rows(spark, sf):
    df = tg.with_forward_targets(vh.with_har_features(daily(spark, sf), ONE), ONE)
    days = ONE.days()
    df = df.withColumns(
        {
            "vr_log_rv": F.col("log_RV_daily"),
            "vr_ma20": rolling_mean("RV_daily", days, 20, 1),
            "vr_std20": F.coalesce(rolling_std("RV_daily", days, 20, 2), F.lit(0.0)),
        }
    )
    keep = [*vh.HAR, "vr_log_rv", "vr_ma20", "vr_std20"]
    return df.select("session_date", "target_log_rv_1d", *keep).dropna()


def har_rv(spark, sf):
    rows = checkpointed(fd.split_by_position(_volatility_rows(spark, sf)))
    predict = vh.fit_har(rows.filter("role = 'train'"), "target_log_rv_1d")
    return rounded(predict(rows).select("session_date", "role", "target_log_rv_1d", "hat_har_rv"))


def volatility_ensemble(spark, sf):
    rows = _volatility_rows(spark, sf)
    plan = fd.WalkForward(n_splits=2, min_train=600, test=200)
    rows = checkpointed(rows)
    assigned = fd.assigned(rows, fd.fold_table(rows, plan))
    wide = (*vh.HAR, "vr_log_rv", "vr_ma20", "vr_std20")
    bases = {
        "har_rv": vh.default_bases(wide)["har_rv"],
        "boosted": vh.Base(lambda: vh.boosted(5, 3, 0.1), wide),
        "forest": vh.Base(lambda: vh.forest(10, 5), wide),
        "elastic_net": vh.default_bases(wide)["elastic_net"],
    }
    predict = vh.fit_ensemble(assigned, rows, bases, "target_log_rv_1d", [1, 2])
    return rounded(predict(rows).select("session_date", "target_log_rv_1d", "hat_ensemble"))


def quantile_forest(spark, sf):
    df = vectors(spark, sf)
    train, _ = _split(df)
    predict = qt.fit_quantile_forest(train, "target", trees=20, depth=5)
    out = qt.with_interval(qt.monotone(predict(df), ["q05", "q50", "q95"]), {0.05: "q05", 0.5: "q50", 0.95: "q95"}, 0.9)
    return rounded(out.select("vec_id", "target", "q05", "q50", "q95", "interval_low", "interval_high"))


def quantile_order(spark, sf):
    """Rearranged levels and a nearest-level interval from crossing columns."""
    df = tb.predictions(spark, sf).groupBy("session_date").agg(
        *[F.avg(c).alias(c) for c in ("p_crash", "p_normal", "p_boom")]
    )
    df = qt.monotone(df, ["p_crash", "p_normal", "p_boom"])
    return rounded(qt.with_interval(df, {0.05: "p_crash", 0.5: "p_normal", 0.95: "p_boom"}, 0.2))


def conformal_interval(spark, sf):
    """Calibrated on the first half of the dates, applied to the rest."""
    rows = fd.split_by_position(tb.predictions(spark, sf), 0.5)
    radius = qt.conformal_radius(rows.filter("role = 'train'"), "actual", "predicted")
    out = qt.with_conformal(rows.filter("role = 'test'"), radius, "predicted")
    inside = F.col("actual").between(F.col("conformal_low"), F.col("conformal_high")).cast("double")
    return rounded(
        out.groupBy("session_date").agg(
            F.min("conformal_low").alias("lowest"), F.max("conformal_high").alias("highest"), F.avg(inside).alias("covered")
        ),
        5,
    )


BASES = {
    "forest": lambda train: cl.random_forest(train, trees=10, depth=4),
    "elastic_net": lambda train: cl.elastic_net_logistic(train, rounds=30),
}


def _stack(spark, sf):
    df = checkpointed(vectors(spark, sf))
    plan = fd.WalkForward(n_splits=2, min_train=200, test=100)
    rows = fd.assigned(df, fd.fold_table(df, plan, "day"), "day")
    weigh = lambda rows: fd.with_utility_weights(rows.drop("weight"), "y", UTILITY)
    return df, st.fit_stack(rows, df, BASES, [1, 2], weigh)


def stacked_classifier(spark, sf):
    df, (predict, _) = _stack(spark, sf)
    return rounded(predict(df).select("vec_id", "y", "p_0", "p_1", "p_2", "predicted_class"))


def expanding_forecasts(spark, sf):
    """One-step-ahead class forecasts, refitted every 100 dates; the last tenth of the known dates stops the rounds."""
    df = checkpointed(vectors(spark, sf))
    fit = lambda train: cl.boosted_trees(train, rounds=8, depth=3, rate=0.1, validation="held_out")
    out = wf.expanding_forecasts(df, fit, initial=200, every=100, date="day", inner=0.9)
    return rounded(out.select("vec_id", "y", "p_0", "p_1", "p_2", "training_size"))


def feature_importance(spark, sf):
    train, _ = _split(vectors(spark, sf))
    heads = [fit(train) for fit in BASES.values()]
    rows = cl.importance_rows(spark, heads, [f"f_{i}" for i in range(WIDTH)])
    best = train.agg(F.count(F.lit(1)).alias("trained_on"))
    return rounded(cl.mean_importance(rows).crossJoin(F.broadcast(best)))


def har_rv_plain(spark, sf):
    """The same regression without a penalty: ordinary least squares, which SQL can solve from moments."""
    rows = checkpointed(fd.split_by_position(_volatility_rows(spark, sf)))
    base = vh.Base(lambda: vh.elastic_net(0.0), vh.HAR)
    predict = vh.fit_base("har_plain", base, rows.filter("role = 'train'"), "target_log_rv_1d")
    return rounded(predict(rows).select("session_date", "role", "hat_har_plain"), 5)


def _log_loss(scored):
    p = F.element_at(F.array(*st.PROBABILITIES), F.col("y") + 1)
    return -F.avg(F.log(F.greatest(p, F.lit(1e-12))))


def classifier_checks(spark, sf):
    """Per classifier: rows, whether all probabilities sum to 1, and whether a second statement holds.

    Heads scored on rows like those they were fitted on explain them better than the class shares (log loss); the two that
    forecast rows of other dates have classes here that no head can know, so theirs is that all probabilities lie in [0, 1].
    """
    ahead = ("stacked", "expanding")
    made = {
        "boosted": boosted_classifier, "forest": forest_classifier, "elastic_net": elastic_net_classifier,
        "kernel_svm": kernel_svm, "stacked": stacked_classifier, "expanding": expanding_forecasts,
    }
    out = None
    for name, query in made.items():
        scored = checkpointed(query(spark, sf))
        shares = scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        share = shares.agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("t"))
        entropy = share.select((F.log("t") - F.col("s") / F.col("t")).alias("entropy"))
        total = F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1)
        one = scored.agg(
            F.count(F.lit(1)).alias("rows"), (F.max(total) < 1e-6).alias("sums_to_one"), _log_loss(scored).alias("loss"),
            F.bool_and(F.least(*st.PROBABILITIES) >= 0).alias("in_range"),
        ).join(F.broadcast(entropy))
        second = F.col("in_range") if name in ahead else F.col("loss") < F.col("entropy")
        one = one.select(F.lit(name).alias("head"), "rows", "sums_to_one", second.alias("second"))
        out = one if out is None else out.unionByName(one)
    return out


def regressor_checks(spark, sf):
    """Ordered quantiles with coverage in a stated band, an ensemble inside its targets' range, importances that sum to 1."""
    q = checkpointed(quantile_forest(spark, sf))
    inside = F.avg(F.col("target").between(F.col("q05"), F.col("q95")).cast("double"))
    ordered = F.bool_and((F.col("q05") <= F.col("q50")) & (F.col("q50") <= F.col("q95")))
    quantiles = q.agg(F.count(F.lit(1)).alias("rows"), ordered.alias("first"), inside.between(0.8, 1.0).alias("second"))
    e = volatility_ensemble(spark, sf)
    hat, target = F.col("hat_ensemble"), F.col("target_log_rv_1d")
    ensemble = e.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and(hat.isNotNull()).alias("first"),
        ((F.min(hat) >= F.min(target)) & (F.max(hat) <= F.max(target))).alias("second"),
    )
    f = cl.importance_rows(spark, [BASES["forest"](_split(vectors(spark, sf))[0])], [f"f_{i}" for i in range(WIDTH)])
    importance = f.agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("first"), F.bool_and(F.col("importance") >= 0).alias("second")
    )
    parts = {"quantiles": quantiles, "ensemble": ensemble, "importance": importance}
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("head"), "rows", "first", "second")
        out = one if out is None else out.unionByName(one)
    return out


def label_codes(spark, sf):
    """Alphabetical label codes and back."""
    days = tb.forecast_days(spark, sf).select("session_date", "actual_label")
    encode, decode = cl.label_indexer(days, "actual_label", "code")
    out = decode("code", "decoded").transform(encode.transform(days))
    return out.select("session_date", "actual_label", F.col("code").cast("int").alias("code"), "decoded")


def _three_models(spark, sf):
    """Three simple rules scored on the same days, one row per model and day."""
    days = tb.forecast_days(spark, sf)
    shares = {"plain": (0, 1, 2), "turned": (1, 2, 0), "swapped": (2, 1, 0)}
    names = ("p_crash", "p_normal", "p_boom")
    rows = [
        F.struct(
            F.lit(m).alias("model"),
            *[F.col(names[i]).alias(f"p_{k}") for k, i in enumerate(order)],
            (F.col("predicted_log_rv") + 0.1 * n).alias("predicted_value"),
        )
        for n, (m, order) in enumerate(shares.items())
    ]
    return days.select("session_date", "y_true", "actual_log_rv", F.explode(F.array(*rows)).alias("_m")).select(
        "session_date", "y_true", "actual_log_rv", "_m.*"
    )


def blend_weights(spark, sf):
    df = _three_models(spark, sf)
    by_hits = st.accuracy_weights(df).select("model", F.col("score").alias("accuracy"), F.col("weight").alias("accuracy_weight"))
    by_error = st.error_weights(df, "actual_log_rv", "predicted_value").select(
        "model", F.col("score").alias("negative_mse"), F.col("weight").alias("error_weight")
    )
    return rounded(by_hits.join(by_error, "model"), 7)


def blended_forecast(spark, sf):
    df = _three_models(spark, sf)
    classes = st.blended(df, st.accuracy_weights(df), ["session_date"], ["p_0", "p_1", "p_2"])
    values = st.blended(df, st.error_weights(df, "actual_log_rv", "predicted_value"), ["session_date"], ["predicted_value"])
    votes = st.rounded_vote(df.withColumn("class_index", st.argmax(st.PROBABILITIES)), ["session_date"])
    return rounded(classes.join(values, "session_date").join(votes, "session_date"), 6)


QUERIES = {
    f.__name__: f
    for f in (
        boosted_classifier, forest_classifier, elastic_net_classifier, kernel_svm, har_rv, volatility_ensemble,
        quantile_forest, quantile_order, conformal_interval, stacked_classifier, expanding_forecasts, feature_importance, label_codes,
        har_rv_plain, classifier_checks, regressor_checks,
        blend_weights, blended_forecast,
    )
}

_DAYS = """
dd AS (
  SELECT session_date, round(avg(p0), 8) AS p_crash, round(avg(p1), 8) AS p_normal, round(avg(p2), 8) AS p_boom,
         CAST(sum(y) % 3 AS INTEGER) AS y_true, round(ln(avg(actual)), 8) AS actual_log_rv,
         round(ln(avg(predicted)), 8) AS predicted_log_rv FROM preds GROUP BY session_date),
mm AS (
  SELECT session_date, y_true, actual_log_rv, 'plain' AS model, p_crash AS p_0, p_normal AS p_1, p_boom AS p_2,
         predicted_log_rv AS v FROM dd UNION ALL
  SELECT session_date, y_true, actual_log_rv, 'turned', p_normal, p_boom, p_crash, predicted_log_rv + 0.1 FROM dd UNION ALL
  SELECT session_date, y_true, actual_log_rv, 'swapped', p_boom, p_normal, p_crash, predicted_log_rv + 0.2 FROM dd),
vote AS (
  SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS k FROM mm),
sc AS (
  SELECT model, avg(CAST(k = y_true AS INTEGER)) AS acc, -avg(pow(actual_log_rv - v, 2)) AS neg FROM vote GROUP BY model),
wt AS (
  SELECT *, acc / sum(acc) OVER () AS aw, (neg - min(neg) OVER () + 1) / sum(neg - mn + 1) OVER () AS ew
  FROM (SELECT *, min(neg) OVER () AS mn FROM sc))"""

# Ordinary least squares of three centred regressors by Cramer's rule.
_HAR = """
har AS (
  SELECT session_date, RV_daily AS x1, avg(RV_daily) OVER (ORDER BY session_date ROWS 4 PRECEDING) AS x2,
         avg(RV_daily) OVER (ORDER BY session_date ROWS 21 PRECEDING) AS x3,
         log_RV_daily, lead(log_RV_daily) OVER (ORDER BY session_date) AS y FROM daily),
known AS (
  SELECT * FROM har WHERE y IS NOT NULL AND log_RV_daily IS NOT NULL AND x1 IS NOT NULL),
placed AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY session_date) - 1 < floor(count(*) OVER () * (1 - 0.2)) THEN 'train' ELSE 'test' END
         AS role FROM known),
mo AS (
  SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b,
         covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f,
         covar_pop(x1, y) AS u, covar_pop(x2, y) AS v, covar_pop(x3, y) AS w FROM placed WHERE role = 'train'),
ols AS (
  SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM mo),
beta AS (
  SELECT m1, m2, m3, my, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS b1,
         (a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - c * v)) / det AS b2,
         (a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det AS b3 FROM ols)"""

ORACLE = {
    "har_rv_plain": S.ctes(S.DAILY, _HAR)
    + S.final(
        "(SELECT session_date, role, my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3) AS hat_har_plain FROM placed, beta)",
        "session_date, role",
        5,
    ),
    "classifier_checks": "SELECT head, CASE WHEN head = 'expanding' THEN n - (SELECT count(*) FROM embeddings WHERE vec_id % 500 < 200)"
    " ELSE n END AS rows, true AS sums_to_one, true AS second FROM (SELECT count(*) AS n FROM embeddings),"
    " (VALUES ('boosted'), ('forest'), ('elastic_net'), ('kernel_svm'), ('stacked'), ('expanding')) h(head)",
    "regressor_checks": S.ctes(S.DAILY, _HAR)
    + "SELECT 'quantiles' AS head, (SELECT count(*) FROM embeddings) AS rows, true AS first, true AS second"
    " UNION ALL SELECT 'ensemble', (SELECT count(*) FROM known), true, true UNION ALL SELECT 'importance', 64, true, true",
    "quantile_order": S.ctes(
        PRED,
        "a AS (SELECT session_date, list_sort([avg(p0), avg(p1), avg(p2)]) AS x FROM preds GROUP BY session_date)",
    )
    + S.final(
        "(SELECT session_date, x[1] AS p_crash, x[2] AS p_normal, x[3] AS p_boom, x[2] AS interval_low, x[2] AS interval_high FROM a)"
    ),
    "conformal_interval": S.ctes(
        PRED,
        """
dts AS (
  SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT session_date FROM preds)),
sp AS (SELECT preds.*, k < floor(n * 0.5) AS early FROM preds JOIN dts USING (session_date)),
er AS (
  SELECT abs(actual - predicted) AS e, row_number() OVER (ORDER BY abs(actual - predicted)) - 1 AS k, count(*) OVER () AS n
  FROM sp WHERE early),
lv AS (SELECT max((n - 1) * least(1.0, ceil(0.9 * (n + 1)) / n)) AS r FROM er),
rad AS (
  SELECT max(e) FILTER (k = floor(r)) + (max(r) - floor(max(r))) * (max(e) FILTER (k = ceil(r)) - max(e) FILTER (k = floor(r)))
         AS radius FROM er, lv)""",
    )
    + S.final(
        "(SELECT session_date, min(predicted - radius) AS lowest, max(predicted + radius) AS highest,"
        " avg(CAST(actual BETWEEN predicted - radius AND predicted + radius AS INTEGER)) AS covered FROM sp, rad"
        " WHERE NOT early GROUP BY session_date)",
        digits=5,
    ),
    "label_codes": S.ctes(PRED, _DAYS)
    + "SELECT session_date, CASE y_true WHEN 0 THEN 'crash' WHEN 1 THEN 'normal' ELSE 'boom' END AS actual_label,"
    " CASE y_true WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS code,"
    " CASE y_true WHEN 0 THEN 'crash' WHEN 1 THEN 'normal' ELSE 'boom' END AS decoded FROM dd",
    "blend_weights": S.ctes(PRED, _DAYS)
    + S.final(
        "(SELECT model, acc AS accuracy, aw AS accuracy_weight, neg AS negative_mse, ew AS error_weight FROM wt)", "model", 7
    ),
    "blended_forecast": S.ctes(PRED, _DAYS)
    + S.final(
        "(SELECT session_date, sum(aw * p_0) / sum(aw) AS p_0, sum(aw * p_1) / sum(aw) AS p_1, sum(aw * p_2) / sum(aw) AS p_2,"
        " sum(ew * v) / sum(ew) AS predicted_value, CAST(round_even(avg(k), 0) AS INTEGER) AS class_index"
        " FROM vote JOIN wt USING (model) GROUP BY session_date)",
        "session_date, class_index",
        6,
    ),
}
