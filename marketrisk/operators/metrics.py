"""Evaluation tables: classification, ranking, calibration, utility, regression, monitoring.

Each metric is one aggregation of the prediction table, or of a small table counted from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, ln, yes
from marketrisk.functions.frames import rolling_mean, so_far
from marketrisk.functions.ordered import exact_quantiles, running_totals
from marketrisk.operators.decision import CLASSES, UTILITY, utility_of
from marketrisk.series import Series

SCORE_BUCKETS = 256
CELLS = [(t, p) for t in range(3) for p in range(3)]


def _stack(wide: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per dict."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def _cell_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row with the nine confusion counts n_<true><pred>."""
    return df.agg(
        *[F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"n_{t}{p}") for t, p in CELLS]
    )


def _class_scores(k: int) -> dict[str, Column]:
    hit = F.col(f"n_{k}{k}")
    predicted = sum((F.col(f"n_{t}{k}") for t in range(1, 3)), F.col(f"n_0{k}"))
    actual = sum((F.col(f"n_{k}{p}") for p in range(1, 3)), F.col(f"n_{k}0"))
    zero = F.lit(0.0)
    return {
        "precision": F.coalesce(div(hit, predicted), zero),
        "recall": F.coalesce(div(hit, actual), zero),
        "f1": F.coalesce(div(hit * 2, predicted + actual), zero),
        "support": actual,
        "seen": (predicted + actual) > 0,
    }


def class_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    rows = []
    for k, name in enumerate(CLASSES):
        s = _class_scores(k)
        rows.append({"class": F.lit(name), **{m: s[m] for m in ("precision", "recall", "f1", "support")}})
    return _stack(_cell_counts(df, truth, pred), rows)


def overall_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy, macro F1 (classes that occur) and support-weighted F1."""
    scores = [_class_scores(k) for k in range(3)]
    rows = sum((s["support"] for s in scores[1:]), scores[0]["support"])
    hits = F.col("n_00") + F.col("n_11") + F.col("n_22")
    seen = [s["seen"].cast("int") for s in scores]
    macro = sum((s["f1"] * k for s, k in zip(scores[1:], seen[1:])), scores[0]["f1"] * seen[0])
    weighted = sum((s["f1"] * s["support"] for s in scores[1:]), scores[0]["f1"] * scores[0]["support"])
    return _cell_counts(df, truth, pred).select(
        div(hits, rows).alias("accuracy"),
        div(macro, seen[0] + seen[1] + seen[2]).alias("macro_f1"),
        div(weighted, rows).alias("weighted_f1"),
    )


def brier(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """Mean squared probability error per class and its mean."""
    error = lambda k, name: F.avg(F.pow(F.col(f"p_{name}") - (F.col(truth) == k).cast("double"), F.lit(2.0)))
    wide = df.agg(*[error(k, name).alias(f"brier_{name}") for k, name in enumerate(CLASSES)])
    return wide.withColumn("brier_mean", (F.col("brier_crash") + F.col("brier_normal") + F.col("brier_boom")) / 3)


def per_class_scores(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """One row per class and prediction: (class, score, is that class)."""
    rows = [
        F.struct(
            F.lit(name).alias("class"), F.col(f"p_{name}").alias("score"), (F.col(truth) == k).cast("long").alias("positive")
        )
        for k, name in enumerate(CLASSES)
    ]
    return df.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def ranked_scores(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """Distinct scores per class with running true and total counts from the top score down.

    Equal scores are merged before anything is ordered.  Buckets end at quantiles of the distinct scores, one
    row of edges per class, so crowded scores are split as evenly as spread ones.
    """
    distinct = (
        per_class_scores(df, truth)
        .groupBy("class", "score")
        .agg(F.sum("positive").alias("at_true"), F.count(F.lit(1)).alias("at_all"))
    )
    totals = distinct.groupBy("class").agg(F.sum("at_true").alias("P"), F.sum("at_all").alias("N"))
    levels = [k / SCORE_BUCKETS for k in range(1, SCORE_BUCKETS)]
    edges = distinct.groupBy("class").agg(F.percentile_approx("score", levels, 100 * SCORE_BUCKETS).alias("_edges"))
    ranked = running_totals(
        distinct.join(F.broadcast(edges), "class"),  # one row per class
        ["class"],
        [F.col("score").desc()],
        F.size(F.filter("_edges", lambda edge: edge <= F.col("score"))),
        {"true_so_far": "at_true", "all_so_far": "at_all"},
        bucket_descending=True,
    )
    return ranked.drop("_edges").join(F.broadcast(totals), "class")  # one row per class


def pr_curve(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """Precision and recall at each distinct score (predict the class at or above it)."""
    return ranked_scores(df, truth).select(
        "class",
        "score",
        div("true_so_far", "all_so_far").alias("precision"),
        div("true_so_far", "P").alias("recall"),
    )


def roc_curve(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """False and true positive rate at each distinct score."""
    return ranked_scores(df, truth).select(
        "class",
        "score",
        div(F.col("all_so_far") - F.col("true_so_far"), F.col("N") - F.col("P")).alias("fpr"),
        div("true_so_far", "P").alias("tpr"),
    )


def ranking_scores(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """Trapezoid areas under the PR curve (from recall 0, precision 1) and the ROC curve per class.

    The previous point follows from the row itself (running minus own counts).
    """
    tp, n = F.col("true_so_far"), F.col("all_so_far")
    tp0, n0 = tp - F.col("at_true"), n - F.col("at_all")
    p, p0 = div(tp, n), F.coalesce(div(tp0, n0), F.lit(1.0))
    pr_step = div(F.col("at_true"), "P") * (p + p0) / 2
    fp_step = F.col("at_all") - F.col("at_true")
    roc_step = div(fp_step * (tp + tp0) / 2, F.col("P") * (F.col("N") - F.col("P")))
    return ranked_scores(df, truth).groupBy("class").agg(F.sum(pr_step).alias("aucpr"), F.sum(roc_step).alias("roc_auc"))


def extremes_mean(scores: DataFrame) -> DataFrame:
    """Mean PR area of the two extreme classes."""
    return scores.filter(F.col("class").isin("crash", "boom")).agg(F.avg("aucpr").alias("aucpr_extremes_mean"))


def utility_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", matrix=UTILITY) -> DataFrame:
    """Expected utility, its value per true class, the optimum and the ratio to it."""
    value = utility_of(pred, truth, matrix)
    best = utility_of(truth, truth, matrix)
    out = df.agg(
        F.sum(value).alias("total_utility"),
        F.avg(value).alias("expected_utility"),
        *[F.avg(F.when(F.col(truth) == k, value)).alias(f"utility_{name}") for k, name in enumerate(CLASSES)],
        F.avg(best).alias("optimal_utility"),
    )
    return out.withColumn("utility_ratio", div("expected_utility", "optimal_utility"))


def utility_decomposition(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", matrix=UTILITY) -> DataFrame:
    """Count, utility and contribution of every (decision, truth) cell."""
    counts = _cell_counts(df, truth, pred)
    rows_total = sum((F.col(f"n_{t}{p}") for t, p in CELLS[1:]), F.col("n_00"))
    rows = []
    for t, p in CELLS:
        n, u = F.col(f"n_{t}{p}"), F.lit(float(matrix[p][t]))
        rows.append(
            {
                "decision": F.lit(CLASSES[p]),
                "truth": F.lit(CLASSES[t]),
                "count": n,
                "utility": u,
                "contribution": div(n * u, rows_total),
            }
        )
    return _stack(counts, rows)


def reliability(df: DataFrame, truth: str = "y_true", bins: int = 10) -> DataFrame:
    """Observed share and mean score per class and equal-width score bin (non-empty bins)."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return (
        per_class_scores(df, truth)
        .groupBy("class", at.alias("bin"))
        .agg(
            F.avg("positive").alias("fraction_positive"),
            F.avg("score").alias("mean_predicted"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Unweighted mean gap over the non-empty bins, per class."""
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    return curve.groupBy("class").agg(F.avg(gap).alias("ece"))


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All nine cells: count, share of the true class and share of all rows."""
    counts = _cell_counts(df, truth, pred)
    everything = sum((F.col(f"n_{t}{p}") for t, p in CELLS[1:]), F.col("n_00"))
    rows = []
    for t, p in CELLS:
        of_class = sum((F.col(f"n_{t}{q}") for q in (1, 2)), F.col(f"n_{t}0"))
        n = F.col(f"n_{t}{p}")
        rows.append(
            {
                "true_class": F.lit(CLASSES[t]),
                "predicted_class": F.lit(CLASSES[p]),
                "count": n,
                "row_share": div(n, of_class),
                "total_share": div(n, everything),
            }
        )
    return _stack(counts, rows)


def confusion_wide(df: DataFrame, truth: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Counts by true label, one column per predicted label in the given order."""
    return df.groupBy(truth).pivot(pred, list(labels)).count().fillna(0, list(labels))


def by_regime(
    df: DataFrame, regime: str, truth: str = "y_true", pred: str = "y_pred", matrix=UTILITY, least: int = 10
) -> DataFrame:
    """Accuracy and utility per regime with more than ``least`` rows."""
    out = df.groupBy(regime).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
        F.avg(utility_of(pred, truth, matrix)).alias("utility"),
    )
    return out.filter(F.col("n_samples") > least)


def summary(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", matrix=UTILITY) -> DataFrame:
    """The headline numbers in one row (each part is a single row)."""
    ranking = ranking_scores(df, truth).agg(
        F.max(F.when(F.col("class") == "crash", F.col("aucpr"))).alias("aucpr_crash"),
        F.max(F.when(F.col("class") == "boom", F.col("aucpr"))).alias("aucpr_boom"),
    )
    ece = calibration_error(reliability(df, truth)).agg(F.avg("ece").alias("ece_mean"))
    out = ranking
    for part in (
        utility_report(df, truth, pred, matrix).select("expected_utility"),
        overall_report(df, truth, pred).select("accuracy", "macro_f1"),
        brier(df, truth).select("brier_mean"),
        ece,
    ):
        out = out.crossJoin(F.broadcast(part))
    return out


def regression_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R2, MAE, RMSE, correlation and share of equal signs over the complete pairs."""
    a, p = F.col(actual), F.col(predicted)
    error = a - p
    pairs = df.filter(a.isNotNull() & p.isNotNull())
    return pairs.agg(
        (1 - div(F.avg(error * error), F.var_pop(a))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.corr(a, p).alias("correlation"),
        F.avg(((a > 0) == (p > 0)).cast("double")).alias("direction_accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def coverage(df: DataFrame, actual: str, quantiles: dict[float, str]) -> DataFrame:
    """Share of outcomes at or below each predicted quantile."""
    wide = df.agg(
        *[F.avg((F.col(actual) <= F.col(c)).cast("double")).alias(f"c{i}") for i, c in enumerate(quantiles.values())]
    )
    return _stack(
        wide, [{"nominal": F.lit(float(q)), "empirical": F.col(f"c{i}")} for i, q in enumerate(quantiles)]
    )


def hit_rates(
    df: DataFrame,
    actual: str = "actual_label",
    predicted: str = "predicted_label",
    y: str = "actual_log_rv",
    y_hat: str = "predicted_log_rv",
) -> DataFrame:
    """Accuracy, hit rate per actual class (0 if absent) and volatility errors in one row."""
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    error = F.col(y) - F.col(y_hat)
    rate = lambda k: F.coalesce(F.avg(F.when(F.col(actual) == k, hit)), F.lit(0.0))
    mae = F.avg(F.abs(error))
    return df.agg(
        F.avg(hit).alias("overall_accuracy"),
        *[rate(k).alias(f"{k}_precision") for k in CLASSES],
        F.avg(error * error).alias("volatility_mse"),
        mae.alias("volatility_mae"),
        (1 - div(mae, F.stddev_samp(y))).alias("volatility_accuracy"),
    )


def accuracy_over_time(
    days: DataFrame, series: Series, actual: str = "actual_label", predicted: str = "predicted_label"
) -> DataFrame:
    """Rolling 50-day (at least 10) and cumulative accuracy of one forecast per day."""
    w = series.days()
    out = days.withColumn("_hit", (F.col(actual) == F.col(predicted)).cast("double"))
    return out.withColumns(
        {
            "rolling_accuracy": rolling_mean("_hit", w, 50, 10),
            "cumulative_accuracy": F.avg("_hit").over(so_far(w)),
        }
    ).drop("_hit")


def accuracy_by_tercile(
    df: DataFrame, value: str = "actual_log_rv", actual: str = "actual_label", predicted: str = "predicted_label"
) -> DataFrame:
    """Accuracy below the 33 % quantile, up to the 67 % quantile and above."""
    cuts = exact_quantiles(df.select(value), [], {"lower": (value, 0.33), "upper": (value, 0.67)})
    level = (
        F.when(F.col(value) <= F.col("lower"), "low").when(F.col(value) <= F.col("upper"), "mid").otherwise("high")
    )
    return (
        df.crossJoin(F.broadcast(cuts))  # one row
        .groupBy(level.alias("volatility"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
        )
    )


def probability_bins(df: DataFrame, score: str, hit: Column, bins: int = 10) -> DataFrame:
    """Actual and mean predicted rate per half-open bin; an empty bin shows 0 and its centre."""
    edges = [i / bins for i in range(bins + 1)]
    p = F.col(score)
    wide = df.agg(
        *[
            F.struct(
                F.count_if((p >= edges[i]) & (p < edges[i + 1])).alias("n"),
                F.avg(F.when((p >= edges[i]) & (p < edges[i + 1]), yes(hit))).alias("actual"),
                F.avg(F.when((p >= edges[i]) & (p < edges[i + 1]), p)).alias("predicted"),
            ).alias(f"b{i}")
            for i in range(bins)
        ]
    )
    rows = [
        {
            "bin": F.lit(i),
            "count": F.col(f"b{i}.n"),
            "actual": F.coalesce(F.col(f"b{i}.actual"), F.lit(0.0)),
            "predicted": F.coalesce(F.col(f"b{i}.predicted"), F.lit((edges[i] + edges[i + 1]) / 2)),
        }
        for i in range(bins)
    ]
    return _stack(wide, rows)


def compounded(days: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Cumulative compounded return in percent of each column."""
    w = so_far(series.days())
    return days.withColumns(
        {f"cumulative_{c}": (F.exp(F.sum(ln(1 + F.col(c))).over(w)) - 1) * 100 for c in columns}
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def class_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows and accuracy per actual class."""
    return df.groupBy(actual).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy")
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum (last bin closed), empty bins included."""
    x = F.col(column)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.coalesce(div((x - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))
    at = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter(x.isNotNull())
        .crossJoin(F.broadcast(span))  # one row
        .groupBy(at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    skeleton = span.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return skeleton.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("from"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("to"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def monitoring(days: DataFrame, series: Series = Series()) -> DataFrame:
    """Key numbers of a forecast table as (metric, value) text rows."""
    hit = (F.col("actual_label") == F.col("predicted_label")).cast("double")
    error = F.col("actual_log_rv") - F.col("predicted_log_rv")
    rate = lambda k: F.avg(F.when(F.col("actual_label") == k, hit))
    percent = lambda c: F.concat(F.round(c * 100, 2).cast("decimal(12,2)").cast("string"), F.lit("%"))
    number = lambda c, d: F.round(c, d).cast(f"decimal(18,{d})").cast("string")
    date = F.col(series.session)
    return days.agg(
        F.count(F.lit(1)).cast("string").alias("total_predictions"),
        percent(F.avg(hit)).alias("overall_accuracy"),
        percent(rate("crash")).alias("crash_detection_rate"),
        percent(rate("boom")).alias("boom_detection_rate"),
        number(F.avg(F.abs(error)), 4).alias("volatility_mae"),
        number(1 - div(F.avg(error * error), F.var_pop("actual_log_rv")), 3).alias("volatility_r2"),
        number(F.avg("training_size"), 0).alias("avg_training_size"),
        F.concat_ws(" to ", F.min(date).cast("string"), F.max(date).cast("string")).alias("date_range"),
    ).unpivot([], None, "metric", "value")
