"""Labels, targets, imputation, folds and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.rounding import rounded
from catalog.sessions_and_measures import ONE, daily
from marketrisk.operators import folds as fd
from marketrisk.operators import impute as im
from marketrisk.operators import targets as tg
from marketrisk.plans import tables as tb
from marketrisk.series import Series

GAMMAS = (0.1, 0.25, 0.5)
UTILITY = [[2.0, -0.5, -1.0], [-2.0, 0.1, -1.5], [-1.0, -0.5, 2.0]]


def crash_boom_labels(spark, sf):
    out = tg.crash_boom_labels(daily(spark, sf), ONE, GAMMAS)
    keep = [c for c in out.columns if c.startswith(("label_", "dist_", "min_dist", "target_", "next_day", "z_score", "vol"))]
    return rounded(out.select("session_date", *keep), 6)


def labels_by_symbol(spark, sf):
    by_symbol = Series(keys=("symbol",))
    out = tg.crash_boom_labels(daily(spark, sf, ("symbol",)), by_symbol, (0.5,))
    return rounded(out.select("session_date", "symbol", "z_score_next", "label_gamma_0_5", "target_return_5d"), 6)


def z_score_estimators(spark, sf):
    base = tg.with_next_day(daily(spark, sf), ONE)
    bv = tg.with_z_score(base, ONE, "BV").select("session_date", F.col("z_score_next").alias("z_bv"))
    ew = tg.with_z_score(base, ONE, "EWMA").select("session_date", F.col("z_score_next").alias("z_ewma"), "ewma_vol")
    return rounded(bv.join(ew, "session_date"), 6)


def _labelled(spark, sf):
    return tg.with_labels(tg.with_z_score(tg.with_next_day(daily(spark, sf), ONE), ONE), GAMMAS)


def label_distribution(spark, sf):
    return rounded(tg.label_distribution(_labelled(spark, sf), GAMMAS))


def label_checks(spark, sf):
    return tg.label_checks(_labelled(spark, sf), GAMMAS)


def z_summary(spark, sf):
    return rounded(tg.z_summary(_labelled(spark, sf)))


def _returns(spark, sf):
    return tg.with_close_returns(daily(spark, sf), ONE)


def sigma_labels(spark, sf):
    out = tg.with_sigma_labels(tg.with_blended_volatility(_returns(spark, sf), ONE), ONE, 0.2)
    out = tg.without_last_day(tg.with_log_rv_target(out, ONE), ONE)
    keep = ["volatility_estimate", "next_log_return", "standardized_return", "crash", "boom", "normal"]
    return rounded(out.select("session_date", *keep, "crash_boom_label", "rv_next", "log_rv_next"), 6)


def quantile_targets(spark, sf):
    out = tg.with_quantile_targets(_returns(spark, sf), ONE)
    return rounded(out.select("session_date", *[c for c in out.columns if c.startswith(("quantile_", "exceeds_"))]))


def direction_targets(spark, sf):
    out = tg.with_volatility_target(tg.with_direction_targets(_returns(spark, sf), ONE), ONE)
    fallback = tg.with_volatility_target(_returns(spark, sf).drop("RV_daily"), ONE)
    fallback = fallback.select("session_date", F.col("volatility_forecast").alias("volatility_fallback"))
    keep = ["next_day_return", "next_week_return", "next_month_return", "market_direction_7class", "direction_3class"]
    keep += ["week_outlook", "crash_probability_1d", "boom_probability_1d", "crash_probability_1w", "boom_probability_1w"]
    return rounded(out.select("session_date", *keep, "volatility_forecast").join(fallback, "session_date"), 6)


def target_correlations(spark, sf):
    out = tg.crash_boom_labels(daily(spark, sf), ONE, (0.5,))
    return rounded(tg.correlation_matrix(out, ["z_score_next", "target_log_rv_1d", "next_day_return"]))


def holed_days(spark, sf):
    """Daily features with holes of every type."""
    df = daily(spark, sf).select("session_date", "RV_daily", "daily_return", "n_minutes", "daily_close")
    day = F.dayofmonth("session_date")
    return df.select(
        "session_date",
        F.when(day % 5 != 0, F.col("RV_daily")).alias("vr_rv"),
        F.when(day % 7 != 1, F.col("daily_return")).alias("path_ret"),
        F.when(day % 3 != 0, F.col("n_minutes").cast("int")).alias("time_n"),
        F.when(day % 4 != 0, F.col("daily_return") > 0).alias("event_up"),
        F.when(day == 9, F.lit(float("inf"))).when(day == 11, F.lit(float("nan"))).otherwise(F.col("daily_close")).alias("liq_close"),
    )


def typed_fill(spark, sf):
    df = tg.with_known_targets(holed_days(spark, sf), ["path_ret"])
    return rounded(im.typed_fill(df, ["vr_rv", "path_ret", "time_n", "event_up", "liq_close"]))


def gap_fill(spark, sf):
    df = holed_days(spark, sf).select("session_date", "vr_rv", "time_n")
    back = im.fill_gaps(df, ["vr_rv"], ONE, backward=True).select("session_date", F.col("vr_rv").alias("vr_rv_both_ways"))
    return rounded(im.fill_gaps(df, ["vr_rv", "time_n"], ONE).join(back, "session_date"))


def fold_scaling(spark, sf):
    df = holed_days(spark, sf).select("session_date", "vr_rv", "path_ret", "liq_close")
    rows = fd.assigned(df, fd.fold_table(df, fd.WalkForward()))
    columns = ["vr_rv", "path_ret", "liq_close"]
    statistics = im.fold_statistics(rows.filter("role = 'train'"), columns)
    return rounded(im.standardized(rows, statistics, columns), 6)


def _dates(spark, sf):
    return tb.order_lines(spark, sf).select("session_date")


def cv_folds(spark, sf):
    return fd.fold_status(_dates(spark, sf), fd.WalkForward())


def cv_folds_rolling(spark, sf):
    return fd.fold_table(_dates(spark, sf), fd.WalkForward(anchored=False))


def group_folds(spark, sf):
    return fd.group_folds(_dates(spark, sf), "session_date", max_train=100)


def leakage_check(spark, sf):
    return fd.leakage_check(fd.fold_table(_dates(spark, sf), fd.WalkForward()))


def refit_schedule(spark, sf):
    return fd.refit_schedule(_dates(spark, sf))


def holdout_splits(spark, sf):
    bars = tb.bars(tb.order_lines(spark, sf)).select("session_date", "ohlcv_volume")
    by_date = fd.split_at_date(bars, "2000-01-01").groupBy("role").agg(F.count(F.lit(1)).alias("rows_by_date"))
    by_place = fd.split_by_position(bars).groupBy("role").agg(
        F.count(F.lit(1)).alias("rows_by_position"), F.min("session_date").alias("first_date")
    )
    return by_date.join(by_place, "role")


def class_weights(spark, sf):
    df = tb.predictions(spark, sf)
    used = fd.with_class_weights(df, "y_true").groupBy("y_true").agg(F.avg("weight").alias("used_weight"))
    utility = fd.with_utility_weights(df, "y_true", UTILITY).groupBy("y_true").agg(F.avg("weight").alias("utility_weight"))
    return rounded(fd.class_weights(df, "y_true").join(used, "y_true").join(utility, "y_true"))


QUERIES = {
    f.__name__: f
    for f in (
        crash_boom_labels, labels_by_symbol, z_score_estimators, label_distribution, label_checks, z_summary,
        sigma_labels, quantile_targets, direction_targets, target_correlations, typed_fill, gap_fill, fold_scaling,
        cv_folds, cv_folds_rolling, group_folds, leakage_check, refit_schedule, holdout_splits, class_weights,
    )
}

LABEL = """
lab AS (
  SELECT *, lead(daily_return) OVER o AS nr, lead(daily_return_sum) OVER o AS nrs,
         lead(daily_return) OVER o / nullif(RVol_daily, 0) AS z, lead(log_RV_daily) OVER o AS t1,
         lead(log_RV_daily, 5) OVER o AS t5,
         CASE WHEN count(daily_return) OVER f = 5 THEN sum(daily_return) OVER f END AS r5
  FROM daily WINDOW o AS (ORDER BY session_date), f AS (ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


def label(g: float, low: str, mid: str, high: str) -> str:
    return f"CASE WHEN z <= -{g} THEN {low} WHEN z >= {g} THEN {high} ELSE {mid} END"


_NAMES = ("'crash'", "'normal'", "'boom'")
CLOSES = """
cr AS (
  SELECT *, daily_close / lag(daily_close) OVER (ORDER BY session_date) - 1 AS close_return,
         ln(daily_close / lag(daily_close) OVER (ORDER BY session_date)) AS log_return FROM daily)"""
HOLES = """
holes AS (
  SELECT session_date, CASE WHEN day(session_date) % 5 <> 0 THEN RV_daily END AS vr_rv,
         CASE WHEN day(session_date) % 7 <> 1 THEN daily_return END AS path_ret,
         CASE WHEN day(session_date) % 3 <> 0 THEN CAST(n_minutes AS INTEGER) END AS time_n,
         CASE WHEN day(session_date) % 4 <> 0 THEN daily_return > 0 END AS event_up,
         CASE WHEN day(session_date) IN (9, 11) THEN NULL ELSE daily_close END AS liq_close, daily_close,
         day(session_date) IN (9, 11) AS odd
  FROM daily)"""
DATES = """
dates AS (
  SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS position, count(*) OVER () AS n_dates
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem))"""
STATUS = """
fr AS (SELECT i AS f, 0 AS a, 251 + i * 65 AS b, 252 + i * 65 AS c, 252 + i * 65 + 63 AS d FROM range(0, 8) r(i)),
folds AS (
  SELECT session_date, CAST(position AS BIGINT) AS position, CAST(f + 1 AS INTEGER) AS fold,
         CASE WHEN position >= a AND position < b THEN 'train' WHEN position >= c AND position < d THEN 'test'
              WHEN position >= b AND position < c THEN 'purge' ELSE 'embargo' END AS status
  FROM dates, fr)"""

ORACLE = {
    "crash_boom_labels": S.ctes(S.DAILY, LABEL)
    + S.final(
        "(SELECT session_date, nr AS next_day_return, nrs AS next_day_return_sum, z AS z_score_next,"
        " RVol_daily AS volatility_for_z, CASE WHEN z IS NOT NULL THEN greatest(-10, least(10, z)) END AS z_score_next_clipped, "
        + ", ".join(
            f"{label(g, *_NAMES)} AS label_gamma_{t}, {label(g, '0', '1', '2')} AS label_gamma_{t}_numeric,"
            f" z + {g} AS dist_to_crash_{t}, z - {g} AS dist_to_boom_{t},"
            f" least(abs(z + {g}), abs(z - {g})) AS min_dist_threshold_{t}"
            for g, t in ((0.1, "0_1"), (0.25, "0_25"), (0.5, "0_5"))
        )
        + ", t1 AS target_log_rv_1d, nr AS target_return_1d, t5 AS target_log_rv_5d, r5 AS target_return_5d FROM lab)",
        "session_date, label_gamma_0_1, label_gamma_0_1_numeric, label_gamma_0_25, label_gamma_0_25_numeric,"
        " label_gamma_0_5, label_gamma_0_5_numeric",
        6,
    ),
    "labels_by_symbol": S.ctes(
        S.bars(True),
        S.returns(True),
        S.daily(True),
        """
lab AS (
  SELECT *, lead(daily_return) OVER (PARTITION BY symbol ORDER BY session_date) / nullif(RVol_daily, 0) AS z,
         CASE WHEN count(daily_return) OVER f = 5 THEN sum(daily_return) OVER f END AS r5 FROM daily
  WINDOW f AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))""",
    )
    + S.final(
        f"(SELECT session_date, symbol, z AS z_score_next, {label(0.5, *_NAMES)} AS label_gamma_0_5,"
        " r5 AS target_return_5d FROM lab)",
        "session_date, symbol, label_gamma_0_5",
        6,
    ),
    "z_score_estimators": S.ctes(S.DAILY, S.ewm("RV_daily", "0.06", "e"))
    + S.final(
        "(SELECT session_date, lead(daily_return) OVER (ORDER BY session_date) / nullif(BVol_daily, 0) AS z_bv,"
        " lead(daily_return) OVER (ORDER BY session_date) / nullif(sqrt(y), 0) AS z_ewma, sqrt(y) AS ewma_vol"
        " FROM daily JOIN e USING (n))",
        digits=6,
    ),
    "label_distribution": S.ctes(
        S.DAILY,
        LABEL,
        "l AS (" + " UNION ALL ".join(f"SELECT {g}::DOUBLE AS gamma, {label(g, *_NAMES)} AS label FROM lab" for g in GAMMAS) + ")",
    )
    + S.final(
        "(SELECT gamma, label, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY gamma) AS share"
        " FROM l GROUP BY gamma, label)",
        "gamma, label, count",
    ),
    "label_checks": "SELECT g::DOUBLE AS gamma, 0::BIGINT AS null_labels, 0::BIGINT AS wrong_crash, 0::BIGINT AS wrong_boom"
    " FROM (VALUES (0.1), (0.25), (0.5)) t(g)",
    "z_summary": S.ctes(S.DAILY, LABEL)
    + S.final("(SELECT avg(z) AS mean, stddev_samp(z) AS std, min(z) AS min, max(z) AS max FROM lab)", ""),
    "sigma_labels": S.ctes(
        S.DAILY,
        CLOSES,
        S.ewm("RV_daily", "0.06", "e"),
        f"""
est AS (
  SELECT cr.*, {S.std('log_return', 20, 10)} AS x1, CASE WHEN cr.n >= 10 THEN sqrt(e.y) END AS x2,
         sqrt({S.mean('parkinson_var', 20, 10)}) AS x3 FROM cr JOIN e USING (n)),
bl AS (
  SELECT *, (coalesce(x1, 0) + coalesce(x2, 0) + coalesce(x3, 0)) / nullif(CAST(x1 IS NOT NULL AS INTEGER)
         + CAST(x2 IS NOT NULL AS INTEGER) + CAST(x3 IS NOT NULL AS INTEGER), 0) AS b FROM est),
ve AS (
  SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (ORDER BY session_date), 0.02) AS ve,
         lead(log_return) OVER (ORDER BY session_date) AS nl, lead(RV_daily) OVER (ORDER BY session_date) AS rvn,
         max(n) OVER () AS top FROM bl),
zz AS (SELECT *, nl / ve AS z FROM ve WHERE n < top)""",
    )
    + S.final(
        "(SELECT session_date, ve AS volatility_estimate, nl AS next_log_return, z AS standardized_return,"
        " CAST(coalesce(z <= -0.2, false) AS INTEGER) AS crash, CAST(coalesce(z >= 0.2, false) AS INTEGER) AS boom,"
        f" CAST(coalesce(z > -0.2 AND z < 0.2, false) AS INTEGER) AS normal, {label(0.2, *_NAMES)} AS crash_boom_label,"
        " rvn AS rv_next, ln(rvn + 1e-8) AS log_rv_next FROM zz)",
        "session_date, crash, boom, normal, crash_boom_label",
        6,
    ),
    "quantile_targets": S.ctes(
        S.DAILY,
        CLOSES,
        """
q AS (
  SELECT session_date, lead(log_return) OVER (ORDER BY session_date) AS nl,
         CASE WHEN count(log_return) OVER w >= 20 THEN quantile_cont(log_return, [0.05, 0.5, 0.95]) OVER w END AS q
  FROM cr WINDOW w AS (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    )
    + S.final(
        "(SELECT session_date, "
        + ", ".join(
            f"lag(q) OVER o [{i}] AS quantile_{p}, CAST(coalesce(nl > q[{i}], false) AS INTEGER) AS exceeds_q{p}".replace(
                f"lag(q) OVER o [{i}]", f"(lag(q) OVER o)[{i}]"
            )
            for i, p in ((1, 5), (2, 50), (3, 95))
        )
        + " FROM q WINDOW o AS (ORDER BY session_date))",
        "session_date, exceeds_q5, exceeds_q50, exceeds_q95",
    ),
    "direction_targets": S.ctes(
        S.DAILY,
        CLOSES,
        f"""
nx AS (
  SELECT *, lead(daily_close) OVER o / daily_close - 1 AS d1, lead(daily_close, 5) OVER o / daily_close - 1 AS w1,
         lead(daily_close, 21) OVER o / daily_close - 1 AS m1, ln(lead(RV_daily) OVER o + 1e-8) AS vf,
         {S.std('close_return', 20)} AS sd FROM cr WINDOW o AS (ORDER BY session_date))""",
    )
    + S.final(
        "(SELECT session_date, d1 AS next_day_return, w1 AS next_week_return, m1 AS next_month_return,"
        " CASE WHEN d1 <= -0.03 THEN 'extreme_crash' WHEN d1 <= -0.015 THEN 'crash' WHEN d1 <= -0.005 THEN 'mild_down'"
        " WHEN d1 < 0.005 THEN 'normal' WHEN d1 < 0.015 THEN 'mild_up' WHEN d1 < 0.03 THEN 'boom'"
        " WHEN d1 >= 0.03 THEN 'extreme_boom' ELSE 'normal' END AS market_direction_7class,"
        " CASE WHEN d1 < -0.002 THEN 'down' WHEN d1 > 0.002 THEN 'up' ELSE 'neutral' END AS direction_3class,"
        " CASE WHEN w1 < -0.03 THEN 'week_crash' WHEN w1 > 0.03 THEN 'week_boom' ELSE 'week_normal' END AS week_outlook,"
        " CAST(coalesce(d1 < -0.015, false) AS INTEGER) AS crash_probability_1d,"
        " CAST(coalesce(d1 > 0.015, false) AS INTEGER) AS boom_probability_1d,"
        " CAST(coalesce(w1 < -0.03, false) AS INTEGER) AS crash_probability_1w,"
        " CAST(coalesce(w1 > 0.03, false) AS INTEGER) AS boom_probability_1w, vf AS volatility_forecast,"
        " lead(sd) OVER (ORDER BY session_date) AS volatility_fallback FROM nx)",
        "session_date, market_direction_7class, direction_3class, week_outlook, crash_probability_1d, boom_probability_1d,"
        " crash_probability_1w, boom_probability_1w",
        6,
    ),
    "target_correlations": S.ctes(
        S.DAILY,
        LABEL,
        """
cc AS (
  SELECT corr(z, t1) AS a, corr(z, nr) AS b, corr(t1, nr) AS c FROM lab)""",
    )
    + S.final(
        "(SELECT 'z_score_next' AS first, 'target_log_rv_1d' AS second, a AS correlation FROM cc"
        " UNION ALL SELECT 'target_log_rv_1d', 'z_score_next', a FROM cc"
        " UNION ALL SELECT 'z_score_next', 'next_day_return', b FROM cc"
        " UNION ALL SELECT 'next_day_return', 'z_score_next', b FROM cc"
        " UNION ALL SELECT 'target_log_rv_1d', 'next_day_return', c FROM cc"
        " UNION ALL SELECT 'next_day_return', 'target_log_rv_1d', c FROM cc"
        " UNION ALL SELECT x, x, 1.0 FROM (VALUES ('z_score_next'), ('target_log_rv_1d'), ('next_day_return')) t(x))",
        "first, second",
    ),
    "typed_fill": S.ctes(
        S.DAILY,
        HOLES,
        """
h AS (SELECT * FROM holes WHERE path_ret IS NOT NULL),
md AS (SELECT median(vr_rv) AS a, median(path_ret) AS b FROM h)""",
    )
    + S.final(
        "(SELECT session_date, coalesce(vr_rv, a) AS vr_rv, coalesce(path_ret, b) AS path_ret, coalesce(time_n, 0) AS time_n,"
        " coalesce(event_up, false) AS event_up, CASE WHEN odd THEN 0.0 ELSE daily_close END AS liq_close FROM h, md)",
        "session_date, time_n, event_up",
    ),
    "gap_fill": S.ctes(S.DAILY, HOLES)
    + S.final(
        "(SELECT session_date, last_value(vr_rv IGNORE NULLS) OVER o AS vr_rv, last_value(time_n IGNORE NULLS) OVER o AS time_n,"
        " coalesce(last_value(vr_rv IGNORE NULLS) OVER o, first_value(vr_rv IGNORE NULLS) OVER"
        " (ORDER BY session_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vr_rv_both_ways"
        " FROM holes WINDOW o AS (ORDER BY session_date))",
        "session_date, time_n",
    ),
    "fold_scaling": S.ctes(
        S.DAILY,
        HOLES,
        DATES,
        STATUS,
        """
fx AS (
  SELECT h.*, fold, status AS role FROM holes h JOIN folds USING (session_date) WHERE status IN ('train', 'test')),
fm AS (
  SELECT fold, median(vr_rv) AS m1, median(path_ret) AS m2, median(liq_close) AS m3 FROM fx WHERE role = 'train' GROUP BY fold),
fs AS (
  SELECT fold, m1, m2, m3, avg(coalesce(vr_rv, m1)) AS a1, stddev_pop(coalesce(vr_rv, m1)) AS s1,
         avg(coalesce(path_ret, m2)) AS a2, stddev_pop(coalesce(path_ret, m2)) AS s2,
         avg(coalesce(liq_close, m3)) AS a3, stddev_pop(coalesce(liq_close, m3)) AS s3
  FROM fx JOIN fm USING (fold) WHERE role = 'train' GROUP BY fold, m1, m2, m3)""",
    )
    + S.final(
        "(SELECT session_date, fold, role, (coalesce(vr_rv, m1) - a1) / s1 AS vr_rv, (coalesce(path_ret, m2) - a2) / s2 AS path_ret,"
        " (coalesce(liq_close, m3) - a3) / s3 AS liq_close FROM fx JOIN fs USING (fold))",
        "session_date, fold, role",
        6,
    ),
    "cv_folds": S.ctes(DATES, STATUS) + "SELECT session_date, CAST(position AS INTEGER) AS position, fold, status FROM folds",
    "cv_folds_rolling": S.ctes(
        DATES, "fr AS (SELECT i AS f, i * 64 AS a, 252 + i * 64 AS b, 253 + i * 64 AS c, 253 + i * 64 + 63 AS d FROM range(0, 8) r(i))"
    )
    + "SELECT session_date, CAST(position AS INTEGER) AS position, CAST(f + 1 AS INTEGER) AS fold,"
    " CASE WHEN position < b THEN 'train' ELSE 'test' END AS role FROM dates, fr"
    " WHERE (position >= a AND position < b) OR (position >= c AND position < d)",
    "group_folds": S.ctes(DATES, "fr AS (SELECT i AS f FROM range(0, 8) r(i))")
    + "SELECT session_date, CAST(position AS INTEGER) AS position, CAST(f + 1 AS INTEGER) AS fold,"
    " CASE WHEN position < n_dates - (8 - f) * 20 THEN 'train' ELSE 'test' END AS role FROM dates, fr"
    " WHERE (position >= greatest(0, n_dates - (8 - f) * 20 - 101) AND position < n_dates - (8 - f) * 20 - 1)"
    " OR (position >= n_dates - (8 - f) * 20 AND position < n_dates - (8 - f) * 20 + 20)",
    "leakage_check": S.ctes(DATES, STATUS)
    + "SELECT fold, CAST(a AS INTEGER) AS last_train, CAST(b AS INTEGER) AS first_test, da AS last_train_date, db AS first_test_date,"
    " CAST(b - a - 1 AS INTEGER) AS gap, a < b AND da < db AS no_leakage FROM (SELECT fold, max(position) FILTER (status = 'train') AS a,"
    " min(position) FILTER (status = 'test') AS b, max(session_date) FILTER (status = 'train') AS da,"
    " min(session_date) FILTER (status = 'test') AS db FROM folds GROUP BY fold)",
    "refit_schedule": S.ctes(DATES)
    + "SELECT session_date, CAST(position AS INTEGER) AS position, CAST(position AS INTEGER) AS training_size,"
    " CAST(greatest(252, position // 20 * 20) AS BIGINT) AS refit_at,"
    " CAST(floor(greatest(252, position // 20 * 20) * 0.8) AS BIGINT) AS inner_train_end FROM dates WHERE position >= 252",
    "holdout_splits": S.ctes(DATES)
    + "SELECT role, rows_by_date, rows_by_position, first_date FROM (SELECT CASE WHEN l_shipdate >= DATE '2000-01-01'"
    " THEN 'test' ELSE 'train' END AS role, count(*) AS rows_by_date FROM lineitem GROUP BY 1) JOIN"
    " (SELECT CASE WHEN position < floor(n_dates * 0.8) THEN 'train' ELSE 'test' END AS role, count(*) AS rows_by_position,"
    " min(session_date) AS first_date FROM dates JOIN lineitem ON CAST(l_shipdate AS DATE) = session_date GROUP BY 1) USING (role)",
    "class_weights": "WITH c AS (SELECT CAST(l_partkey % 3 AS INTEGER) AS y_true, count(*) AS count FROM lineitem GROUP BY 1),"
    " w AS (SELECT *, sum(count) OVER () / (3 * count) AS raw FROM c)"
    " SELECT y_true, count, round(raw / avg(raw) OVER () + 1.37e-10, 8) AS weight, round(raw / avg(raw) OVER () + 1.37e-10, 8)"
    " AS used_weight, round(CASE y_true WHEN 1 THEN 0.1 ELSE 2.0 END + 1.37e-10, 8) AS utility_weight FROM w",
}
