"""Fixed-row window frames with minimum-period rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.functions.columns import EPS, col, div, root
from marketrisk.series import Series

#: Runs of rows that are put together to one in a step of :func:`rolling_frames`.
RADIX = 4


def last(window: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return window.rowsBetween(-(n - 1), 0)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg, x: Column | str, window: WindowSpec, n: int, least: int | None = None) -> Column:
    """``agg`` over the last n rows, null below ``least`` non-null values (default: n)."""
    frame = last(window, n)
    return at_least(agg(col(x)).over(frame), x, frame, n if least is None else least)


def at_least(result: Column, x: Column | str, frame: WindowSpec, least: int) -> Column:
    if least <= 1:
        return result
    return F.when(F.count(col(x)).over(frame) >= least, result)


def rolling_mean(x, window, n, least=None) -> Column:
    return rolling(F.avg, x, window, n, least)


def rolling_std(x, window, n, least=None) -> Column:
    return rolling(F.stddev_samp, x, window, n, least)


def rolling_sum(x, window, n, least=None) -> Column:
    return rolling(F.sum, x, window, n, least)


def rolling_max(x, window, n, least=None) -> Column:
    return rolling(F.max, x, window, n, least)


def rolling_min(x, window, n, least=None) -> Column:
    return rolling(F.min, x, window, n, least)


def rolling_quantile(x, q: float | Sequence[float], window, n, least=None) -> Column:
    """Linear-interpolation quantile; a sequence of levels gives an array in one pass."""
    level = F.lit(q) if isinstance(q, float) else F.array(*[F.lit(v) for v in q])
    return rolling(lambda c: F.percentile(c, level), x, window, n, least)


def rolling_slope(x, step, window, n, least) -> Column:
    """Least-squares slope of x against a row counter ``step``."""
    frame = last(window, n)
    return at_least(F.regr_slope(col(x), col(step).cast("double")).over(frame), x, frame, least)


def rolling_lag1_corr(x, x_lag, window, n, least) -> Column:
    """Correlation of neighbours among the last n values (n-1 pairs)."""
    pairs = window.rowsBetween(-(n - 2), 0)
    return at_least(F.corr(col(x), col(x_lag)).over(pairs), x, last(window, n), least)


def rescaled_range(x, window, n, least) -> Column:
    """Range of the cumulated deviations from the frame mean over the population deviation."""
    frame = last(window, n)
    values = F.collect_list(col(x)).over(frame)
    mean = F.avg(col(x)).over(frame)
    spread = F.stddev_pop(col(x)).over(frame)
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("cum"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("lo")
    )

    def step(acc: Column, v: Column) -> Column:
        cum = acc["cum"] + v - mean
        return F.struct(
            cum.alias("cum"), F.greatest(acc["hi"], cum).alias("hi"), F.least(acc["lo"], cum).alias("lo")
        )

    ranged = F.aggregate(values, start, step, lambda acc: acc["hi"] - acc["lo"])
    return at_least(div(ranged, spread + F.lit(EPS)), x, frame, least)


def rolling_frames(df: DataFrame, window: WindowSpec, wanted: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """Rolling means, sums and sample deviations for minute tables, in log n steps a row instead of n.

    ``wanted`` maps a new name to (kind, column, rows, least), kind being mean, sum or std.  Runs of 1, 4, 16, ... rows
    are put together from four runs a quarter as long, and a frame from the runs its length is made of.  Nothing is
    ever taken away: no value outside a frame, however large or undefined, touches its result.  Sums are doubles.

    Spark sorts and numbers the window's rows; their values go through numpy batch by batch, each led by the last rows
    before it, so a task holds one batch.  The result is no longer partitioned as the window is: further windows over the same rows
    belong before this call.
    """
    columns = list(dict.fromkeys(c for _, c, _, _ in wanted.values()))
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in wanted])
    # not deterministic: a filter moved below it would take rows out of the frames
    framed = F.arrow_udf(_frames_of_batches(columns, wanted), kind).asNondeterministic()
    numbered = df.withColumn("_at", F.row_number().over(window))
    found = numbered.withColumn("_f", framed("_at", *[F.col(c).cast("double") for c in columns]))
    return found.withColumns({n: F.col("_f").getField(n) for n in wanted}).drop("_at", "_f")


def _frames_of_batches(columns: list[str], wanted: dict[str, tuple[str, str, int, int]]):
    """The task function of :func:`rolling_frames`: batches of row numbers and values in, structs of frames out."""
    spread = {c for kind, c, _, _ in wanted.values() if kind == "std"}
    lengths = {c: sorted({rows for _, of, rows, _ in wanted.values() if of == c}) for c in columns}
    reach = max(rows for _, _, rows, _ in wanted.values()) - 1

    def together(pieces):
        """Count, sum and squares about the mean of rows that are counted in several pieces."""
        n, s = sum(p[0] for p in pieces), sum(p[1] for p in pieces)
        if len(pieces[0]) == 2 or len(pieces) == 1:
            return [n, s, *pieces[0][2:]]
        mean, q = s / n, sum(p[2] for p in pieces)
        for p in pieces:
            apart = p[1] / p[0] - mean
            q = q + np.where(p[0] > 0, p[0] * apart * apart, 0.0)
        return [n, s, q]

    def frames_of(x, known, starts, of, deviations):
        """Count, sum and squares about the mean of the frames of one column, by their lengths.

        ``starts`` tells the rows that lie too near to a window's start to have a row so many before.
        """
        x = np.where(known, x, 0.0)
        # the squares of one value about itself: zero, undefined if the value is not finite
        run, made, length = [known.astype("float64"), x, *([x - x] if deviations else [])], {}, 1

        def back(rows):
            """The run that ends so many rows before; an empty one before the first row."""
            if rows == 0:
                return run
            out, without = [np.empty_like(part) for part in run], starts(rows)
            for new, part in zip(out, run, strict=True):
                new[rows:] = part[:-rows]
                new[:rows] = 0.0
                new[without] = 0.0
            return out

        while of[-1] >= length:
            for rows in of:  # the newest rows % length rows of the frame are put together already
                newest, more = rows % length, rows // length % RADIX
                if more:
                    pieces = [back(newest + k * length) for k in range(more)]
                    made[rows] = together([made[rows], *pieces] if newest else pieces)
            if of[-1] >= RADIX * length:
                run = together([back(k * length) for k in range(RADIX)])
            length *= RADIX
        return made

    def batches(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        before = None  # row numbers, values and which are known of the last rows before the batch
        for at, *values in parts:
            now = [at.to_numpy(zero_copy_only=False).astype("int64")]
            now += [v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values]
            now += [v.is_valid().to_numpy(zero_copy_only=False) for v in values]
            led = now if before is None else [np.concatenate(p) for p in zip(before, now, strict=True)]
            lead, at = len(led[0]) - len(now[0]), led[0]
            if ((at[1:] != at[:-1] + 1) & (at[1:] != 1)).any():
                raise ValueError("rows of a window came out of order")
            starts = cache(lambda rows, at=at: np.flatnonzero(at <= rows))
            found, arrays = {}, []
            with np.errstate(all="ignore"):
                for k, c in enumerate(columns):
                    found[c] = frames_of(led[1 + k], led[1 + len(columns) + k], starts, lengths[c], c in spread)
                for kind, c, rows, least in wanted.values():
                    n, s, *q = (part[lead:] for part in found[c][rows])
                    result = np.sqrt(q[0] / (n - 1)) if kind == "std" else s / n if kind == "mean" else s
                    arrays.append(pa.array(result, mask=n < max(least, 2 if kind == "std" else 1)))
            before = [p[max(0, len(p) - reach) :] for p in led]
            yield pa.StructArray.from_arrays(arrays, list(wanted))

    return batches


def with_expanding(df: DataFrame, series: Series, wanted: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Exact statistics of each day among its instrument's days so far, in n log n steps.

    ``wanted`` maps a new name to (column, level): the linear-interpolation quantile of the column at that level, or, for
    level None, the current value's average-tie rank over the number of values.  A window would order all days before it for every day.
    One task takes one instrument's days: a date and the wanted columns, one row per calendar day.
    """
    keys, columns = list(series.keys), list(dict.fromkeys(c for c, _ in wanted.values()))
    names = {c: f"_x_{k}" for k, c in enumerate(columns)}
    narrow = df.select(*series.by_session, *[F.col(c).cast("double").alias(n) for c, n in names.items()])
    fields = [f for f in narrow.schema.fields if f.name in series.by_session]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])
    session = series.session

    def so_far_of(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(session)
        made = {}
        for name, (column, level) in wanted.items():
            x = days[names[column]].astype("float64").expanding(1)
            made[name] = x.rank(method="average", pct=True) if level is None else x.quantile(level)
        return days[[*keys, session]].assign(**made)

    found = narrow.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"])).applyInPandas(so_far_of, schema)
    return df.join(found, series.by_session, "left")


def percent_rank_in(x, frame: WindowSpec, least: int = 1) -> Column:
    """Average-tie rank of the current value among the frame's values, divided by their count."""
    x = col(x)
    values = F.collect_list(x).over(frame)
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    share = div(below + (same + F.lit(1)) / F.lit(2.0), F.size(values))
    return at_least(F.when(x.isNotNull(), share), x, frame, least)


def average_rank(x, group: WindowSpec) -> Column:
    """Rank with ties averaged, over the whole (unordered) group window."""
    ordered = group.orderBy(col(x).asc_nulls_last())
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(0, 0))
    return F.when(col(x).isNotNull(), F.rank().over(ordered) + (ties - 1) / F.lit(2.0))


def carried(x, window: WindowSpec) -> Column:
    """Last known value up to the current row."""
    return F.last(col(x), ignorenulls=True).over(so_far(window))
