"""Decisions and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.rounding import rounded
from catalog.sessions_and_measures import ONE
from marketrisk.operators import decision as dec
from marketrisk.operators import metrics as mx
from marketrisk.plans import tables as tb


def scored(spark, sf):
    return tb.predictions(spark, sf).withColumn("y_pred", dec.argmax_class())


def decisions(spark, sf):
    df = tb.predictions(spark, sf)
    df = df.withColumns({"standard": dec.decision(0.3, 0.4), "forced": dec.decision(0.3, 0.4, "forced_extremes")})
    return df.groupBy("standard", "forced", "y_true").agg(F.count(F.lit(1)).alias("n"))


def expected_utility(spark, sf):
    df = tb.predictions(spark, sf).withColumn("d", dec.decision(0.3, 0.4))
    return rounded(dec.expected_utility(df, "d", "y_true"), 6)


def utility_grid(spark, sf):
    return rounded(dec.threshold_grid(tb.predictions(spark, sf)), 7)


def utility_grid_forced(spark, sf):
    return rounded(dec.threshold_grid(tb.predictions(spark, sf), mode="forced_extremes", points=40), 7)


def best_thresholds(spark, sf):
    return rounded(dec.best_thresholds(dec.threshold_grid(tb.predictions(spark, sf)), 7), 7)


def decision_audit(spark, sf):
    df = dec.decision_audit(tb.predictions(spark, sf), 0.3, 0.4)
    return rounded(df.drop("actual", "predicted"))


def class_report(spark, sf):
    return rounded(mx.class_report(scored(spark, sf)))


def overall_report(spark, sf):
    return rounded(mx.overall_report(scored(spark, sf)))


def brier(spark, sf):
    return rounded(mx.brier(tb.predictions(spark, sf)))


def pr_curve(spark, sf):
    return rounded(mx.pr_curve(tb.predictions(spark, sf)))


def roc_curve(spark, sf):
    return rounded(mx.roc_curve(tb.predictions(spark, sf)))


def ranking_scores(spark, sf):
    return rounded(mx.ranking_scores(tb.predictions(spark, sf)))


def extremes_mean(spark, sf):
    return rounded(mx.extremes_mean(mx.ranking_scores(tb.predictions(spark, sf))))


def utility_report(spark, sf):
    return rounded(mx.utility_report(scored(spark, sf)), 6)


def utility_decomposition(spark, sf):
    return rounded(mx.utility_decomposition(scored(spark, sf)))


def reliability(spark, sf):
    return rounded(mx.reliability(tb.predictions(spark, sf)))


def calibration_error(spark, sf):
    return rounded(mx.calibration_error(mx.reliability(tb.predictions(spark, sf))))


def confusion(spark, sf):
    return rounded(mx.confusion(scored(spark, sf)))


def confusion_wide(spark, sf):
    return mx.confusion_wide(tb.forecast_days(spark, sf), "actual_label", "predicted_label", dec.CLASSES)


def regime_metrics(spark, sf):
    df = scored(spark, sf).withColumn("regime", F.concat(F.lit("opx_"), tb.is_opx().cast("string")))
    return rounded(mx.by_regime(df, "regime"))


def evaluation_summary(spark, sf):
    return rounded(mx.summary(scored(spark, sf)))


def regression_report(spark, sf):
    return rounded(mx.regression_report(tb.predictions(spark, sf), "actual", "predicted"), 5)


def coverage(spark, sf):
    df = tb.predictions(spark, sf).withColumns({"q05": F.col("predicted") * 0.4, "q95": F.col("predicted") * 2.5})
    return rounded(mx.coverage(df, "actual", {0.05: "q05", 0.5: "predicted", 0.95: "q95"}))


def hit_rates(spark, sf):
    return rounded(mx.hit_rates(tb.forecast_days(spark, sf)), 7)


def accuracy_over_time(spark, sf):
    df = mx.accuracy_over_time(tb.forecast_days(spark, sf), ONE)
    return rounded(df.select("session_date", "rolling_accuracy", "cumulative_accuracy"))


def accuracy_by_tercile(spark, sf):
    return rounded(mx.accuracy_by_tercile(tb.forecast_days(spark, sf)))


def probability_bins(spark, sf):
    df = tb.predictions(spark, sf)
    return rounded(mx.probability_bins(df, "p_boom", F.col("y_true") == 2))


def compounded_returns(spark, sf):
    df = mx.compounded(tb.forecast_days(spark, sf), ONE, ["actual_return", "predicted_return"])
    return rounded(df.select("session_date", "cumulative_actual_return", "cumulative_predicted_return"), 5)


def class_balance(spark, sf):
    df = tb.forecast_days(spark, sf)
    balance = mx.class_balance(df, "actual_label")
    return rounded(balance.join(mx.class_accuracy(df, "actual_label", "predicted_label"), "actual_label"))


def histograms(spark, sf):
    df = tb.predictions(spark, sf).withColumn("error", F.col("predicted") - F.col("actual"))
    errors = mx.histogram(df, "error", 50).withColumn("of", F.lit("error"))
    return rounded(mx.histogram(df, "p_crash", 30).withColumn("of", F.lit("p_crash")).unionByName(errors), 6)


def monitoring(spark, sf):
    return mx.monitoring(tb.forecast_days(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        decisions, expected_utility, utility_grid, utility_grid_forced, best_thresholds, decision_audit, class_report,
        overall_report, brier, pr_curve, roc_curve, ranking_scores, extremes_mean, utility_report,
        utility_decomposition, reliability, calibration_error, confusion, confusion_wide, regime_metrics,
        evaluation_summary, regression_report, coverage, hit_rates, accuracy_over_time, accuracy_by_tercile,
        probability_bins, compounded_returns, class_balance, histograms, monitoring,
    )
}

PRED = f"""
pa AS (
  SELECT *, 1 + l_linenumber AS a, 1 + l_quantity / 10 AS b, 1 + 50 * l_discount AS c FROM lineitem),
preds AS (
  SELECT CAST(l_shipdate AS DATE) AS session_date, {S.six('a / (a + b + c)')} AS p0, {S.six('b / (a + b + c)')} AS p1,
         {S.six('c / (a + b + c)')} AS p2, CAST(l_partkey % 3 AS INTEGER) AS y, l_extendedprice AS actual,
         1000 * l_quantity AS predicted FROM pa),
scored AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yp FROM preds)"""
MATRIX = """
um(d, t, u) AS (VALUES (0, 0, 2.0::DOUBLE), (0, 1, -0.5), (0, 2, -1.0), (1, 0, -2.0), (1, 1, 0.1), (1, 2, -1.5), (2, 0, -1.0), (2, 1, -0.5),
 (2, 2, 2.0))"""
STD = (
    "CASE WHEN p0 >= {c} AND p2 >= {b} THEN CASE WHEN p0 > p2 THEN 0 ELSE 2 END WHEN p0 >= {c} THEN 0"
    " WHEN p2 >= {b} THEN 2 ELSE {n} END"
)
_FORCED = "CASE WHEN p0 > p2 THEN 0 ELSE 2 END"
LONG = """
long AS (
  SELECT 'crash' AS class, p0 AS s, CAST(y = 0 AS INTEGER) AS t FROM preds UNION ALL
  SELECT 'normal', p1, CAST(y = 1 AS INTEGER) FROM preds UNION ALL
  SELECT 'boom', p2, CAST(y = 2 AS INTEGER) FROM preds)"""
RANK = """
agg AS (SELECT class, s, sum(t) AS t, count(*) AS k FROM long GROUP BY class, s),
rk AS (
  SELECT class, s, sum(t) OVER w AS tp, sum(k) OVER w AS n, sum(t) OVER (PARTITION BY class) AS pos,
         sum(k) OVER (PARTITION BY class) AS everything
  FROM agg WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
pts AS (
  SELECT class, s, tp / n AS pr, tp / pos AS rc, (n - tp) / (everything - pos) AS fpr FROM rk),
steps AS (
  SELECT *, lag(pr, 1, 1.0) OVER w AS pr0, lag(rc, 1, 0.0) OVER w AS rc0, lag(fpr, 1, 0.0) OVER w AS fpr0 FROM pts
  WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
areas AS (
  SELECT class, sum((rc - rc0) * (pr + pr0) / 2) AS aucpr, sum((fpr - fpr0) * (rc + rc0) / 2) AS roc_auc FROM steps GROUP BY class)"""
CLS = """
cls AS (
  SELECT k, CASE k WHEN 0 THEN 'crash' WHEN 1 THEN 'normal' ELSE 'boom' END AS class,
         count(*) FILTER (y = k AND yp = k) AS hit, count(*) FILTER (yp = k) AS np, count(*) FILTER (y = k) AS support,
         count(*) AS n FROM scored, range(0, 3) r(k) GROUP BY k),
rep AS (
  SELECT *, coalesce(hit / nullif(np, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
         coalesce(2 * hit / nullif(np + support, 0), 0) AS f1 FROM cls)"""
CAL = """
cal AS (
  SELECT class, CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, avg(t) AS fraction_positive, avg(s) AS mean_predicted,
         count(*) AS count FROM long GROUP BY 1, 2)"""
UTIL = """
ut AS (SELECT y, yp, m.u, o.u AS best FROM scored JOIN um m ON m.d = yp AND m.t = y JOIN um o ON o.d = y AND o.t = y)"""
DAYS = """
dd AS (
  SELECT session_date, round(avg(p0), 8) AS p_crash, round(avg(p1), 8) AS p_normal, round(avg(p2), 8) AS p_boom,
         CAST(sum(y) % 3 AS INTEGER) AS y_true, round(ln(avg(actual)), 8) AS actual_log_rv,
         round(ln(avg(predicted)), 8) AS predicted_log_rv,
         round((avg(actual) / avg(predicted) - 1.5) / 1000 + 1.37e-10, 8) AS actual_return, round(avg(p2) - avg(p0), 8) AS predicted_return,
         count(*) AS training_size FROM preds GROUP BY session_date),
days AS (
  SELECT *, CASE y_true WHEN 0 THEN 'crash' WHEN 1 THEN 'normal' ELSE 'boom' END AS actual_label,
         CASE WHEN p_crash >= p_normal AND p_crash >= p_boom THEN 'crash' WHEN p_normal >= p_boom THEN 'normal' ELSE 'boom' END
         AS predicted_label FROM dd)"""
_HIT = "CAST(actual_label = predicted_label AS INTEGER)"


def grid(points: int, mode_normal: str) -> str:
    return f"""
tau AS (SELECT i, CASE WHEN i = {points - 1} THEN 0.8::DOUBLE ELSE i * ((0.8::DOUBLE - 0.2::DOUBLE) / {points - 1}) + 0.2::DOUBLE END
        AS v FROM range(0, {points}) r(i)),
flat AS MATERIALIZED (SELECT p0, p2, y FROM preds ORDER BY p0, p2, y),
combos AS (SELECT p0, p2, y, count(*) AS k FROM flat GROUP BY ALL),
grid AS (
  SELECT tc.v AS tau_crash, tb.v AS tau_boom, sum(k * u) / sum(k) AS utility
  FROM combos, tau tc, tau tb JOIN um ON d = {STD.format(c='tc.v', b='tb.v', n=mode_normal)} AND t = y GROUP BY ALL)"""


def hist(column: str, source: str, bins: int, name: str) -> str:
    return f"""
SELECT CAST(b AS INTEGER) AS bin, lo + b * ((hi - lo) / {bins}) AS "from", lo + (b + 1) * ((hi - lo) / {bins}) AS "to",
       (SELECT count(*) FROM {source} WHERE least(floor(({column} - lo) * {bins} / (hi - lo)), {bins - 1}) = b) AS count, '{name}' AS "of"
FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}), range(0, {bins}) r(b)"""


ORACLE = {
    "decisions": S.ctes(PRED)
    + f"SELECT {STD.format(c=0.3, b=0.4, n=1)} AS standard, {STD.format(c=0.3, b=0.4, n=_FORCED)} AS forced, y AS y_true,"
    " count(*) AS n FROM preds GROUP BY ALL",
    "expected_utility": S.ctes(
        PRED,
        MATRIX,
        f"z AS (SELECT y, {STD.format(c=0.3, b=0.4, n=1)} AS d FROM preds)",
    )
    + S.final(
        "(SELECT sum(m.u) AS total_utility, avg(m.u) AS expected_utility, avg(o.u) AS optimal_utility FROM z"
        " JOIN um m ON m.d = z.d AND m.t = y JOIN um o ON o.d = y AND o.t = y)",
        "",
        6,
    ),
    "utility_grid": S.ctes(PRED, MATRIX, grid(100, "1")) + S.final("grid", "", 7),
    "utility_grid_forced": S.ctes(PRED, MATRIX, grid(40, _FORCED)) + S.final("grid", "", 7),
    "best_thresholds": S.ctes(PRED, MATRIX, grid(100, "1"))
    + S.final(
        "(SELECT tau_crash, tau_boom, round(utility, 7) AS utility FROM grid"
        " ORDER BY round(utility, 7) DESC, tau_crash, tau_boom LIMIT 1)",
        "",
        7,
    ),
    "decision_audit": S.ctes(
        PRED,
        MATRIX,
        f"z AS (SELECT *, {STD.format(c=0.3, b=0.4, n=1)} AS d0 FROM preds)",
        "nm(k, name) AS (VALUES (0, 'crash'), (1, 'normal'), (2, 'boom'))",
    )
    + S.final(
        "(SELECT session_date, p0 AS p_crash, p1 AS p_normal, p2 AS p_boom, y AS y_true, d0 AS decision,"
        " a.name AS decision_label, b.name AS true_label, d0 = y AS correct, 0.3::DOUBLE AS tau_crash, 0.4::DOUBLE AS tau_boom,"
        " 'standard' AS mode, u AS utility_contribution FROM z JOIN um ON d = d0 AND t = y JOIN nm a ON a.k = d0"
        " JOIN nm b ON b.k = y)",
        "session_date, y_true, decision, decision_label, true_label, correct, mode",
    ),
    "class_report": S.ctes(PRED, CLS)
    + S.final("(SELECT class, precision, recall, f1, support FROM rep)", "class, support"),
    "overall_report": S.ctes(PRED, CLS)
    + S.final(
        "(SELECT sum(hit) / max(n) AS accuracy, sum(f1 * CAST(np + support > 0 AS INTEGER)) / sum(CAST(np + support > 0 AS INTEGER))"
        " AS macro_f1, sum(f1 * support) / max(n) AS weighted_f1 FROM rep)",
        "",
    ),
    "brier": S.ctes(PRED)
    + S.final(
        "(SELECT *, (brier_crash + brier_normal + brier_boom) / 3 AS brier_mean FROM (SELECT"
        " avg(pow(p0 - CAST(y = 0 AS INTEGER), 2)) AS brier_crash, avg(pow(p1 - CAST(y = 1 AS INTEGER), 2)) AS brier_normal,"
        " avg(pow(p2 - CAST(y = 2 AS INTEGER), 2)) AS brier_boom FROM preds))",
        "",
    ),
    "pr_curve": S.ctes(PRED, LONG, RANK)
    + S.final("(SELECT class, s AS score, pr AS precision, rc AS recall FROM pts)", "class"),
    "roc_curve": S.ctes(PRED, LONG, RANK) + S.final("(SELECT class, s AS score, fpr, rc AS tpr FROM pts)", "class"),
    "ranking_scores": S.ctes(PRED, LONG, RANK) + S.final("areas", "class"),
    "extremes_mean": S.ctes(PRED, LONG, RANK)
    + S.final("(SELECT avg(aucpr) AS aucpr_extremes_mean FROM areas WHERE class <> 'normal')", ""),
    "utility_report": S.ctes(PRED, MATRIX, UTIL)
    + S.final(
        "(SELECT *, expected_utility / optimal_utility AS utility_ratio FROM (SELECT sum(u) AS total_utility,"
        " avg(u) AS expected_utility, avg(u) FILTER (y = 0) AS utility_crash, avg(u) FILTER (y = 1) AS utility_normal,"
        " avg(u) FILTER (y = 2) AS utility_boom, avg(best) AS optimal_utility FROM ut))",
        "",
        6,
    ),
    "utility_decomposition": S.ctes(
        PRED, MATRIX, "nm(k, name) AS (VALUES (0, 'crash'), (1, 'normal'), (2, 'boom'))"
    )
    + S.final(
        "(SELECT a.name AS decision, b.name AS truth, (SELECT count(*) FROM scored WHERE yp = d AND y = t) AS count, u AS utility,"
        " (SELECT count(*) FROM scored WHERE yp = d AND y = t) * u / (SELECT count(*) FROM scored) AS contribution"
        " FROM um JOIN nm a ON a.k = d JOIN nm b ON b.k = t)",
        "decision, truth, count",
    ),
    "reliability": S.ctes(PRED, LONG, CAL) + S.final("cal", "class, bin, count"),
    "calibration_error": S.ctes(PRED, LONG, CAL)
    + S.final("(SELECT class, avg(abs(fraction_positive - mean_predicted)) AS ece FROM cal GROUP BY class)", "class"),
    "confusion": S.ctes(
        PRED,
        "nm(k, name) AS (VALUES (0, 'crash'), (1, 'normal'), (2, 'boom'))",
        """
cm AS (
  SELECT a.k AS t, b.k AS p, a.name AS true_class, b.name AS predicted_class,
         (SELECT count(*) FROM scored WHERE y = a.k AND yp = b.k) AS count FROM nm a, nm b)""",
    )
    + S.final(
        "(SELECT true_class, predicted_class, count, count / sum(count) OVER (PARTITION BY t) AS row_share,"
        " count / sum(count) OVER () AS total_share FROM cm)",
        "true_class, predicted_class, count",
    ),
    "confusion_wide": S.ctes(PRED, DAYS)
    + "SELECT actual_label, count(*) FILTER (predicted_label = 'crash') AS crash, count(*) FILTER (predicted_label = 'normal')"
    " AS normal, count(*) FILTER (predicted_label = 'boom') AS boom FROM days GROUP BY 1",
    "regime_metrics": S.ctes(PRED, MATRIX)
    + S.final(
        "(SELECT 'opx_' || (isodow(session_date) = 5 AND day(session_date) BETWEEN 15 AND 21) AS regime, count(*) AS n_samples,"
        " avg(CAST(y = yp AS INTEGER)) AS accuracy, avg(u) AS utility FROM scored JOIN um ON d = yp AND t = y GROUP BY 1)",
        "regime, n_samples",
    ),
    "evaluation_summary": S.ctes(PRED, MATRIX, LONG, RANK, CLS, CAL, UTIL)
    + S.final(
        "(SELECT (SELECT aucpr FROM areas WHERE class = 'crash') AS aucpr_crash, (SELECT aucpr FROM areas WHERE class = 'boom')"
        " AS aucpr_boom, (SELECT avg(u) FROM ut) AS expected_utility, (SELECT sum(hit) / max(n) FROM rep) AS accuracy,"
        " (SELECT avg(f1) FROM rep) AS macro_f1, (SELECT (avg(pow(p0 - CAST(y = 0 AS INTEGER), 2)) + avg(pow(p1 - CAST(y = 1"
        " AS INTEGER), 2)) + avg(pow(p2 - CAST(y = 2 AS INTEGER), 2))) / 3 FROM preds) AS brier_mean,"
        " (SELECT avg(e) FROM (SELECT avg(abs(fraction_positive - mean_predicted)) AS e FROM cal GROUP BY class)) AS ece_mean)",
        "",
    ),
    "regression_report": S.ctes(PRED)
    + S.final(
        "(SELECT 1 - avg(pow(actual - predicted, 2)) / var_pop(actual) AS r2, avg(abs(actual - predicted)) AS mae,"
        " sqrt(avg(pow(actual - predicted, 2))) AS rmse, corr(actual, predicted) AS correlation,"
        " avg(CAST((actual > 0) = (predicted > 0) AS INTEGER)) AS direction_accuracy, count(*) AS n FROM preds)",
        "n",
        5,
    ),
    "coverage": S.ctes(PRED)
    + S.final(
        "(SELECT 0.05::DOUBLE AS nominal, avg(CAST(actual <= predicted * 0.4 AS INTEGER)) AS empirical FROM preds UNION ALL"
        " SELECT 0.5, avg(CAST(actual <= predicted AS INTEGER)) FROM preds UNION ALL"
        " SELECT 0.95, avg(CAST(actual <= predicted * 2.5 AS INTEGER)) FROM preds)",
        "",
    ),
    "hit_rates": S.ctes(PRED, DAYS)
    + S.final(
        f"(SELECT avg({_HIT}) AS overall_accuracy, coalesce(avg({_HIT}) FILTER (actual_label = 'crash'), 0) AS crash_precision,"
        f" coalesce(avg({_HIT}) FILTER (actual_label = 'normal'), 0) AS normal_precision,"
        f" coalesce(avg({_HIT}) FILTER (actual_label = 'boom'), 0) AS boom_precision,"
        " avg(pow(actual_log_rv - predicted_log_rv, 2)) AS volatility_mse, avg(abs(actual_log_rv - predicted_log_rv))"
        " AS volatility_mae, 1 - avg(abs(actual_log_rv - predicted_log_rv)) / stddev_samp(actual_log_rv) AS volatility_accuracy"
        " FROM days)",
        "",
        7,
    ),
    "accuracy_over_time": S.ctes(PRED, DAYS, f"h AS (SELECT session_date, {_HIT} AS hit FROM days)")
    + S.final(
        f"(SELECT session_date, {S.mean('hit', 50, 10)} AS rolling_accuracy, avg(hit) OVER (ORDER BY session_date)"
        " AS cumulative_accuracy FROM h)"
    ),
    "accuracy_by_tercile": S.ctes(
        PRED, DAYS, "q AS (SELECT quantile_cont(actual_log_rv, 0.33) AS a, quantile_cont(actual_log_rv, 0.67) AS b FROM days)"
    )
    + S.final(
        "(SELECT CASE WHEN actual_log_rv <= a THEN 'low' WHEN actual_log_rv <= b THEN 'mid' ELSE 'high' END AS volatility,"
        f" count(*) AS n, avg({_HIT}) AS accuracy FROM days, q GROUP BY 1)",
        "volatility, n",
    ),
    "probability_bins": S.ctes(PRED)
    + S.final(
        "(SELECT CAST(i AS INTEGER) AS bin, count(p2) AS count, coalesce(avg(CASE WHEN p2 IS NOT NULL THEN CAST(y = 2 AS INTEGER) END), 0)"
        " AS actual, coalesce(avg(p2), i / 10 + 0.05) AS predicted FROM range(0, 10) r(i) LEFT JOIN preds"
        " ON p2 >= i / 10 AND p2 < (i + 1) / 10 GROUP BY i)",
        "bin, count",
    ),
    "compounded_returns": S.ctes(PRED, DAYS)
    + S.final(
        "(SELECT session_date, (exp(sum(ln(1 + actual_return)) OVER w) - 1) * 100 AS cumulative_actual_return,"
        " (exp(sum(ln(1 + predicted_return)) OVER w) - 1) * 100 AS cumulative_predicted_return FROM days"
        " WINDOW w AS (ORDER BY session_date))",
        digits=5,
    ),
    "class_balance": S.ctes(PRED, DAYS)
    + S.final(
        f"(SELECT actual_label, count(*) AS count, count(*) / sum(count(*)) OVER () AS share, count(*) AS n, avg({_HIT}) AS accuracy"
        " FROM days GROUP BY actual_label)",
        "actual_label, count, n",
    ),
    "histograms": S.ctes(PRED, "er AS (SELECT predicted - actual AS error FROM preds)")
    + S.final(
        f"({hist('p0', 'preds', 30, 'p_crash')} UNION ALL {hist('error', 'er', 50, 'error')})", 'bin, count, "of"', 6
    ),
    "monitoring": S.ctes(
        PRED,
        DAYS,
        f"""
mo AS (
  SELECT CAST(count(*) AS VARCHAR) AS total_predictions, printf('%.2f%%', avg({_HIT}) * 100) AS overall_accuracy,
         printf('%.2f%%', avg({_HIT}) FILTER (actual_label = 'crash') * 100) AS crash_detection_rate,
         printf('%.2f%%', avg({_HIT}) FILTER (actual_label = 'boom') * 100) AS boom_detection_rate,
         printf('%.4f', avg(abs(actual_log_rv - predicted_log_rv))) AS volatility_mae,
         printf('%.3f', 1 - avg(pow(actual_log_rv - predicted_log_rv, 2)) / var_pop(actual_log_rv)) AS volatility_r2,
         printf('%.0f', avg(training_size)) AS avg_training_size,
         CAST(min(session_date) AS VARCHAR) || ' to ' || CAST(max(session_date) AS VARCHAR) AS date_range FROM days)""",
    )
    + "SELECT metric, value FROM mo UNPIVOT (value FOR metric IN (total_predictions, overall_accuracy, crash_detection_rate,"
    " boom_detection_rate, volatility_mae, volatility_r2, avg_training_size, date_range))",
}
