"""Boosted heads on losses of their own, refits from running moments, and checks of heads on rows they have not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.evaluation import PRED
from catalog.heads import _HAR, BASES, UTILITY, _log_loss, _split, _volatility_rows, vectors
from catalog.rounding import rounded
from marketrisk.functions.lineage import checkpointed
from marketrisk.heads import boosting as bo
from marketrisk.heads import classifiers as cl
from marketrisk.heads import expanding as ex
from marketrisk.heads import quantiles as qt
from marketrisk.heads import stacking as st
from marketrisk.heads import volatility as vh
from marketrisk.operators import folds as fd
from marketrisk.plans import tables as tb

SMALL = bo.Settings(rounds=8, depth=3, rate=0.3, patience=4)
QUANTILES = ("q05", "q50", "q95")
TARGET = "target_log_rv_1d"


def boosted_quantiles(spark, sf):
    """Levels of the target from trees on pinball losses, sorted, with the 90 % interval."""
    df = vectors(spark, sf)
    predict, _ = bo.boosted_quantiles(_split(df)[0].drop("weight"), "target", settings=SMALL)
    out = qt.with_interval(qt.monotone(predict(df), QUANTILES), dict(zip(qt.LEVELS, QUANTILES, strict=True)), 0.9)
    return rounded(out.select("vec_id", "target", *QUANTILES, "interval_low", "interval_high"))


def softmax_boosting(spark, sf):
    """Class shares from trees grown together; every fifth row stops the rounds."""
    df = vectors(spark, sf).withColumn("held_out", F.col("vec_id") % 5 == 4)
    head = bo.softmax_boosting(df, SMALL, validation="held_out")
    return rounded(head.score(df).select("vec_id", "y", "p_0", "p_1", "p_2"))


def learnable(spark, sf):
    """Vectors with classes that follow from two of their entries: below -0.08, between, above 0.08 in sum."""
    both = F.get(F.col("embedding"), 0).cast("double") + F.get(F.col("embedding"), 1).cast("double")
    y = F.when(both < -0.08, 0).when(both <= 0.08, 1).otherwise(2)
    known = tb.table(spark, sf, "embeddings").select("vec_id", y.cast("int").alias("y"))
    df = vectors(spark, sf).drop("y", "label", "weight").join(known, "vec_id")
    return df.withColumn("label", F.col("y").cast("double"))


def _pinball(level, hat):
    error = F.col("target") - hat
    return F.greatest(error * level, error * (level - 1))


def boosting_checks(spark, sf):
    """Statements about rows no head has seen, by head: how many rows, and whether the two hold.

    Quantiles: at each level a pinball loss below that of the training rows' constant quantile; and between 0.8 and 1
    of the targets inside the 90 % interval.  Softmax: log loss not above that of one boosted model per class; and below
    that of the training rows' class shares.
    """
    plain, test = _split(learnable(spark, sf))
    predict, _ = bo.boosted_quantiles(plain, "target", settings=SMALL)
    wanted = {f"c{k}": ("target", q) for k, q in enumerate(qt.LEVELS)}
    constants = qt.exact_quantiles(plain, [], wanted)
    scored = qt.monotone(predict(test), QUANTILES).crossJoin(F.broadcast(constants))  # one row
    better = [
        F.avg(_pinball(level, F.col(c))) < F.avg(_pinball(level, F.col(f"c{k}")))
        for k, (level, c) in enumerate(zip(qt.LEVELS, QUANTILES, strict=True))
    ]
    inside = F.avg(F.col("target").between(F.col("q05"), F.col("q95")).cast("double"))
    rows = F.count(F.lit(1)).alias("rows")
    quantiles = scored.agg(
        rows, (better[0] & better[1] & better[2]).alias("first"), inside.between(0.8, 1.0).alias("second")
    )
    joint = bo.softmax_boosting(plain, SMALL)
    apart = cl.boosted_trees(plain, rounds=8, depth=3, rate=0.3)
    shares = plain.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n").alias("t"))
    logs = shares.crossJoin(F.broadcast(total)).select("y", F.log(F.col("n") / F.col("t")).alias("log_share"))
    of = lambda head, name: head.score(test).agg(_log_loss(None).alias(name))
    constant = test.join(F.broadcast(logs), "y").agg(rows, (-F.avg("log_share")).alias("constant"))
    losses = constant.crossJoin(of(joint, "joint")).crossJoin(of(apart, "apart"))  # one row each
    softmax = losses.select(
        "rows", (F.col("joint") <= F.col("apart")).alias("first"), (F.col("joint") < F.col("constant")).alias("second")
    )
    return quantiles.select(F.lit("quantiles").alias("head"), "*").unionByName(
        softmax.select(F.lit("softmax").alias("head"), "*")
    )


def expanding_har(spark, sf):
    """Next day's log volatility by a regression refitted every 20 days on all days before."""
    rows = checkpointed(_volatility_rows(spark, sf))
    out = ex.expanding_forecasts(rows, TARGET, vh.HAR)
    return rounded(out.select("session_date", "refit_at", "training_size", "hat"), 5)


def expanding_elastic_net(spark, sf):
    """The same with an elastic net of six features."""
    rows = checkpointed(_volatility_rows(spark, sf))
    out = ex.expanding_forecasts(rows, TARGET, _WIDE, penalty=0.01)
    return rounded(out.select("session_date", "refit_at", "training_size", "hat"), 7)


_WIDE = (*vh.HAR, "vr_log_rv", "vr_ma20", "vr_std20")


def refit_optimality(spark, sf):
    """Per refit of the elastic net the coefficients that miss the optimality conditions on the rows themselves.

    With features in deviations of the known rows, the mean of feature times residual equals the penalty's slope where a
    coefficient is not 0, and is no greater than the absolute part of it elsewhere.
    """
    penalty, l1 = 0.01, 0.5
    rows = checkpointed(_volatility_rows(spark, sf))
    placed = rows.join(F.broadcast(fd.numbered_dates(rows).select("session_date", "position")), "session_date")
    fitted = checkpointed(ex.expanding_coefficients(rows, TARGET, _WIDE, penalty=penalty))
    # refits x days rows: a check of daily rows only
    known = placed.join(F.broadcast(fitted), F.col("position") < F.col("refit_at"))
    hat = F.col("intercept")
    for k, c in enumerate(_WIDE):
        hat = hat + F.get(F.col("coefficients"), k) * F.col(c)
    known = known.withColumn("_e", F.col(TARGET) - hat)
    moments = known.groupBy("refit_at", "trained_on", "coefficients").agg(
        F.avg("_e").alias("_me"),
        F.count(F.lit(1)).alias("_n"),
        *[F.covar_pop(c, "_e").alias(f"_g{k}") for k, c in enumerate(_WIDE)],
        *[F.stddev_pop(c).alias(f"_d{k}") for k, c in enumerate(_WIDE)],
    )
    missed = (F.abs("_me") > 1e-8).cast("int") + (F.col("_n") != F.col("trained_on")).cast("int")
    for k in range(len(_WIDE)):
        b = F.get(F.col("coefficients"), k) * F.col(f"_d{k}")
        slope = F.col(f"_g{k}") / F.col(f"_d{k}")
        off = F.when(b != 0, F.abs(slope - penalty * (1 - l1) * b - penalty * l1 * F.signum(b))).otherwise(
            F.abs(slope) - penalty * l1
        )
        missed = missed + (off > 1e-6).cast("int")
    return moments.select("refit_at", missed.cast("long").alias("violations"))


def held_out_checks(spark, sf):
    """Stacked and ensemble heads on rows after all they were fitted on: rows, and a bound on their loss.

    The stack's log loss on classes that can be learned must lie below that of equal shares; the ensemble's squared error on
    next days, which hardly can, at most a tenth above that of its training rows' mean.
    """
    df = checkpointed(learnable(spark, sf))
    day = fd.numbered_dates(df, "day").select("day", "position")
    placed = checkpointed(df.join(F.broadcast(day), "day"))  # one row per date
    known, ahead = placed.filter("position < 400"), placed.filter("position >= 400")
    plan = fd.WalkForward(n_splits=2, min_train=150, test=80)
    rows = fd.assigned(known, fd.fold_table(known, plan, "day"), "day")
    weigh = lambda rows: fd.with_utility_weights(rows, "y", UTILITY)
    predict, _ = st.fit_stack(rows, known, BASES, [1, 2], weigh)
    count = F.count(F.lit(1)).alias("rows")
    stack = predict(ahead).agg(count, (_log_loss(None) < F.log(F.lit(3.0))).alias("holds"))
    days = checkpointed(fd.split_by_position(_volatility_rows(spark, sf)))
    early, late = days.filter("role = 'train'").drop("role"), days.filter("role = 'test'").drop("role")
    assigned = fd.assigned(early, fd.fold_table(early, fd.WalkForward(n_splits=2, min_train=400, test=200)))
    bases = {
        "har_rv": vh.default_bases(_WIDE)["har_rv"],
        "forest": vh.Base(lambda: vh.forest(10, 5), _WIDE),
        "elastic_net": vh.Base(lambda: vh.elastic_net(0.01), _WIDE),
    }
    ensemble = vh.fit_ensemble(assigned, early, bases, TARGET, [1, 2])
    mean = early.agg(F.avg(TARGET).alias("_mean"))
    scored = ensemble(late).crossJoin(F.broadcast(mean))  # one row
    error = lambda hat: F.avg(F.pow(F.col(TARGET) - F.col(hat), 2))
    volatility = scored.agg(count, (error("hat_ensemble") < 1.1 * error("_mean")).alias("holds"))
    return stack.select(F.lit("stack").alias("head"), "*").unionByName(
        volatility.select(F.lit("ensemble").alias("head"), "*")
    )


def quantile_interval(spark, sf):
    """Rearranged levels and the interval of coverage 0.9 from crossing columns."""
    df = tb.predictions(spark, sf).groupBy("session_date").agg(
        *[F.avg(c).alias(c) for c in ("p_crash", "p_normal", "p_boom")]
    )
    df = qt.monotone(df, ["p_crash", "p_normal", "p_boom"])
    return rounded(qt.with_interval(df, {0.05: "p_crash", 0.5: "p_normal", 0.95: "p_boom"}, 0.9))


QUERIES = {
    f.__name__: f
    for f in (
        boosted_quantiles, softmax_boosting, boosting_checks, expanding_har, expanding_elastic_net, refit_optimality,
        held_out_checks, quantile_interval,
    )
}

_REFITS = """
pos AS (SELECT *, row_number() OVER (ORDER BY session_date) - 1 AS k FROM known),
plan AS (SELECT *, CAST(greatest(252, floor(k / 20) * 20) AS BIGINT) AS refit_at FROM pos WHERE k >= 252),
refits AS (SELECT DISTINCT refit_at FROM plan),
mr AS (
  SELECT refit_at, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b,
         covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f,
         covar_pop(x1, y) AS u, covar_pop(x2, y) AS v, covar_pop(x3, y) AS w FROM refits JOIN pos ON k < refit_at GROUP BY refit_at),
dr AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM mr),
br AS (
  SELECT refit_at, m1, m2, m3, my, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS b1,
         (a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - c * v)) / det AS b2,
         (a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det AS b3 FROM dr)"""

ORACLE = {
    "boosting_checks": "SELECT h.head, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 4) AS rows, true AS first,"
    " true AS second FROM (VALUES ('quantiles'), ('softmax')) h(head)",
    "expanding_har": S.ctes(S.DAILY, _HAR, _REFITS)
    + S.final(
        "(SELECT session_date, refit_at, CAST(k AS INTEGER) AS training_size, my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3) AS hat"
        " FROM plan JOIN br USING (refit_at))",
        "session_date, refit_at, training_size",
        5,
    ),
    "refit_optimality": S.ctes(S.DAILY, _HAR, _REFITS) + "SELECT refit_at, CAST(0 AS BIGINT) AS violations FROM refits",
    "held_out_checks": S.ctes(S.DAILY, _HAR)
    + "SELECT 'stack' AS head, (SELECT count(*) FROM embeddings WHERE vec_id % 500 >= 400) AS rows, true AS holds"
    " UNION ALL SELECT 'ensemble', (SELECT count(*) FROM placed WHERE role = 'test'), true",
    "quantile_interval": S.ctes(
        PRED,
        "a AS (SELECT session_date, list_sort([avg(p0), avg(p1), avg(p2)]) AS x FROM preds GROUP BY session_date)",
    )
    + S.final(
        "(SELECT session_date, x[1] AS p_crash, x[2] AS p_normal, x[3] AS p_boom, x[1] AS interval_low, x[3] AS interval_high FROM a)"
    ),
}
