"""Expanding one-step-ahead forecasts: refit per block of dates, score the block."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.functions.concurrent import concurrently
from marketrisk.heads.classifiers import Head
from marketrisk.operators.folds import refit_schedule


def expanding_forecasts(
    rows: DataFrame,
    fit: Callable[[DataFrame], Head],
    initial: int = 252,
    every: int = 20,
    date: str = "session_date",
    inner: float = 1.0,
) -> DataFrame:
    """Every date from ``initial`` on, scored by the model refitted last before it.

    A model sees only positions before its refit.  With ``inner`` below 1 the last of them are marked by a
    boolean column ``held_out``, for early stopping.  The number of fits is the number of dates over ``every``;
    each fit and score is a Spark job, and the fits
    run side by side.
    """
    schedule = refit_schedule(rows, initial, every, inner, date)
    positions = refit_schedule(rows, 0, 1, inner, date).select(date, "position")
    placed = rows.join(F.broadcast(positions), date)  # one row per calendar date
    blocks = schedule.groupBy("refit_at").agg(
        F.max("inner_train_end").alias("train_end"), F.min("position").alias("first"), F.max("position").alias("last")
    )
    refits = blocks.orderBy("refit_at").collect()  # one row per refit

    def known(block) -> DataFrame:
        before = placed.filter(F.col("position") < block["refit_at"])
        return before if inner >= 1 else before.withColumn("held_out", F.col("position") >= block["train_end"])

    heads = concurrently(rows.sparkSession, [partial(fit, known(block)) for block in refits])
    parts = []
    for block, head in zip(refits, heads, strict=True):
        scored = head.score(placed.filter(F.col("position").between(block["first"], block["last"])))
        parts.append(scored.withColumn("training_size", F.col("position")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
