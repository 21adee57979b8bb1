"""Decisions from class probabilities and their utility.

Classes are 0 crash, 1 normal, 2 boom; a utility matrix is indexed [decision][truth].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import col

CLASSES = ("crash", "normal", "boom")
# Fixed utilities, rows = decision, columns = truth, order crash, normal, boom.
UTILITY = ((2.0, -0.5, -1.0), (-2.0, 0.1, -1.5), (-1.0, -0.5, 2.0))
P_CRASH, P_NORMAL, P_BOOM = "p_crash", "p_normal", "p_boom"
MODES = ("standard", "forced_extremes")


def argmax_class() -> Column:
    """Most probable class, the first on ties."""
    c, n, b = F.col(P_CRASH), F.col(P_NORMAL), F.col(P_BOOM)
    return F.when((c >= n) & (c >= b), 0).when(n >= b, 1).otherwise(2)


def decision(tau_crash: Column | float, tau_boom: Column | float, mode: str = "standard") -> Column:
    """Threshold decision; when both fire the larger probability wins, ties go to boom.

    ``forced_extremes`` replaces every normal by the likelier extreme.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    c, b = F.col(P_CRASH), F.col(P_BOOM)
    likelier = F.when(c > b, 0).otherwise(2)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    crash, boom = c >= as_col(tau_crash), b >= as_col(tau_boom)
    neither = likelier if mode == "forced_extremes" else F.lit(1)
    return F.when(crash & boom, likelier).when(crash, 0).when(boom, 2).otherwise(neither)


def utility_of(decided: Column | str, truth: Column | str, matrix: Sequence[Sequence[float]] = UTILITY) -> Column:
    """Matrix cell [decision][truth] as a constant lookup."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return F.get(F.get(table, col(decided)), col(truth))


def expected_utility(df: DataFrame, decided: str, truth: str, matrix=UTILITY) -> DataFrame:
    value = utility_of(decided, truth, matrix)
    return df.agg(
        F.sum(value).alias("total_utility"),
        F.avg(value).alias("expected_utility"),
        F.avg(utility_of(truth, truth, matrix)).alias("optimal_utility"),
    )


def decision_audit(
    df: DataFrame, tau_crash: float, tau_boom: float, truth: str = "y_true", mode: str = "standard", matrix=UTILITY
) -> DataFrame:
    """Every row with its decision, labels, thresholds and utility contribution."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    out = df.withColumn("decision", decision(tau_crash, tau_boom, mode))
    return out.withColumns(
        {
            "decision_label": F.get(names, F.col("decision")),
            "true_label": F.get(names, F.col(truth)),
            "correct": F.col("decision") == F.col(truth),
            "tau_crash": F.lit(float(tau_crash)),
            "tau_boom": F.lit(float(tau_boom)),
            "mode": F.lit(mode),
            "utility_contribution": utility_of("decision", truth, matrix),
        }
    )


def threshold_grid(
    df: DataFrame,
    truth: str = "y_true",
    matrix=UTILITY,
    mode: str = "standard",
    points: int = 100,
    low: float = 0.2,
    high: float = 0.8,
) -> DataFrame:
    """Expected utility at every (tau_crash, tau_boom) of a square grid.

    A decision depends on how many grid thresholds each probability reaches, on which of the
    two is larger, and the utility on the truth: at most (points+1)^2 * 2 * classes cells.
    The rows are counted into those cells once, and suffix sums over the cells give all grid
    values; no row ever meets a threshold pair.
    """
    step = (high - low) / (points - 1)

    def tau(k: Column) -> Column:
        return F.when(k == points - 1, F.lit(high)).otherwise(k.cast("double") * F.lit(step) + F.lit(low))

    def reached(p: Column) -> Column:
        """How many thresholds are <= p: the rounded guess, corrected by exact comparison."""
        guess = F.greatest(F.lit(-1), F.least(F.lit(points - 1), F.floor((p - low) / step)))
        down = F.when((guess >= 0) & (tau(guess) > p), 1).otherwise(0)
        up = F.when((guess < points - 1) & (tau(guess + 1) <= p), 1).otherwise(0)
        return (guess + 1 - down + up).cast("int")

    c, b = F.col(P_CRASH), F.col(P_BOOM)
    cells = df.groupBy(
        reached(c).alias("i"), reached(b).alias("j"), (c > b).alias("crash_larger"), F.col(truth).alias("_y")
    ).agg(F.count(F.lit(1)).alias("_n"))
    likelier = F.when(F.col("crash_larger"), 0).otherwise(2)
    default = likelier if mode == "forced_extremes" else F.lit(1)
    worth = lambda d: utility_of(d, "_y", matrix) * F.col("_n")
    neither = worth(default)
    per_cell = cells.groupBy("i", "j").agg(
        F.sum("_n").alias("_n"),
        F.sum(neither).alias("_base"),
        F.sum(worth(F.lit(0)) - neither).alias("_crash"),
        F.sum(worth(F.lit(2)) - neither).alias("_boom"),
        F.sum(worth(likelier) - neither).alias("_both"),
    )
    # All cells of the grid, so that suffix sums exist everywhere.
    spark = df.sparkSession
    side = spark.range(points + 1).select(F.col("id").cast("int").alias("i"))
    frame = side.select("i", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("j"))
    full = frame.join(per_cell, ["i", "j"], "left").fillna(0)
    up_i = Window.partitionBy("j").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up_j = Window.partitionBy("i").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    columns = ("_crash", "_boom", "_both")
    over_i = full.withColumns({f"{k}_i": F.sum(k).over(up_i) for k in columns})
    corner = over_i.withColumns({f"{k}_ij": F.sum(f"{k}_i").over(up_j) for k in columns})
    # crash threshold reached by all j: corner at j = 0; boom threshold reached by all i: corner at i = 0
    every_j, every_i = Window.partitionBy("i"), Window.partitionBy("j")
    edges = corner.withColumns(
        {
            "_crash_all": F.max(F.when(F.col("j") == 0, F.col("_crash_ij"))).over(every_j),
            "_boom_all": F.max(F.when(F.col("i") == 0, F.col("_boom_ij"))).over(every_i),
        }
    )
    totals = per_cell.agg(F.sum("_n").alias("_rows"), F.sum("_base").alias("_all_base"))
    value = (
        F.col("_all_base")
        + (F.col("_crash_all") - F.col("_crash_ij"))
        + (F.col("_boom_all") - F.col("_boom_ij"))
        + F.col("_both_ij")
    ) / F.col("_rows")
    return (
        edges.filter((F.col("i") >= 1) & (F.col("j") >= 1))
        .crossJoin(F.broadcast(totals))  # one row
        .select(tau(F.col("i") - 1).alias("tau_crash"), tau(F.col("j") - 1).alias("tau_boom"), value.alias("utility"))
    )


def best_thresholds(grid: DataFrame, digits: int = 10) -> DataFrame:
    """Grid point of the largest utility, the first in grid order on ties."""
    return grid.withColumn("utility", F.round("utility", digits)).orderBy(
        F.col("utility").desc(), "tau_crash", "tau_boom"
    ).limit(1)
