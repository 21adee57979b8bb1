"""Exponentially decayed means and deviations as plain window sums.

A decayed sum  S(t) = sum (1-a)^(t-i) x(i)  is split into blocks of L rows, with L
chosen so that (1-a)^L is about 1e-17.  Inside a block the sum is a running sum of
x(i) (1-a)^-j (j = row inside the block): the newest terms are the largest, so the
scaling costs no precision.  The block before enters through its total, found L rows
back; anything older weighs less than 1e-17.  No Python, no recursion, no arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.functions.columns import div, root
from marketrisk.series import Series

_BLOCK_DECAY = 1e-17
STEP = "_step"


def numbered(df: DataFrame, series: Series, name: str = STEP) -> DataFrame:
    """Attach a 1-based row counter per instrument."""
    return df.withColumn(name, F.row_number().over(series.days()))


class Decay:
    """Decayed sums with one rate over one daily series that has a ``_step`` counter."""

    def __init__(self, alpha: float, series: Series, step: str = STEP):
        self.keep = 1.0 - alpha
        self.length = max(2, math.ceil(math.log(_BLOCK_DECAY) / math.log(self.keep)))
        self.series = series
        self.step = F.col(step)
        self.block = F.floor((self.step - 1) / self.length)
        self.inside = F.pmod(self.step - 1, F.lit(self.length)).cast("double")
        days = series.days()
        self.whole_block = Window.partitionBy(*series.keys, self.block)
        self.run = self.whole_block.orderBy(series.session).rowsBetween(Window.unboundedPreceding, 0)
        self.days = days
        self.powers: dict[float, tuple[Column, Column]] = {}

    def _powers(self, keep: float) -> tuple[Column, Column]:
        """keep^-j and keep^j for row j of the block."""
        if keep not in self.powers:
            self.powers[keep] = F.pow(F.lit(keep), -self.inside), F.pow(F.lit(keep), self.inside)
        return self.powers[keep]

    def pieces(self, x: Column, keep: float | None = None) -> tuple[Column, Column]:
        """(running sum inside the block, block total) of x scaled to the block start."""
        keep = self.keep if keep is None else keep
        scaled = F.coalesce(x, F.lit(0.0)) * self._powers(keep)[0]
        return F.sum(scaled).over(self.run), F.sum(scaled).over(self.whole_block)

    def joined(self, running: Column, total: Column, keep: float | None = None) -> Column:
        """Put a block's running sum and the total of the block before it together."""
        keep = self.keep if keep is None else keep
        older = F.coalesce(F.lag(total, self.length).over(self.days), F.lit(0.0)) * F.lit(keep**self.length)
        return self._powers(keep)[1] * (running + older)


def _decayed_sums(
    df: DataFrame, requests: dict[str, tuple[Column, float, float]], series: Series, step: str
) -> DataFrame:
    """Add ``name -> decayed sum of x``; a request is (x, alpha for the blocks, keep factor)."""
    staged, finals, decays = {}, {}, {}
    for name, (x, alpha, keep) in requests.items():
        if alpha not in decays:
            decays[alpha] = Decay(alpha, series, step)
        decay = decays[alpha]
        running, total = decay.pieces(x, keep)
        staged[f"_run_{name}"], staged[f"_all_{name}"] = running, total
        finals[name] = decay.joined(F.col(f"_run_{name}"), F.col(f"_all_{name}"), keep)
    return df.withColumns(staged).withColumns(finals).drop(*staged)


def with_ewm_mean(df: DataFrame, specs: dict[str, tuple[str, float]], series: Series) -> DataFrame:
    """Add bias-adjusted decayed means: ``specs`` maps new name to (column, alpha).

    Weights are (1-alpha)^age over the non-null values; a null row still ages the rest.
    """
    own_step = STEP not in df.columns
    df = numbered(df, series) if own_step else df
    requests = {}
    for name, (x, alpha) in specs.items():
        requests[f"_num_{name}"] = (F.col(x), alpha, 1 - alpha)
        requests[f"_den_{name}"] = (F.col(x).isNotNull().cast("double"), alpha, 1 - alpha)
    out = _decayed_sums(df, requests, series, STEP)
    out = out.withColumns({n: div(f"_num_{n}", f"_den_{n}") for n in specs}).drop(*requests)
    return out.drop(STEP) if own_step else out


def with_ewm_std(df: DataFrame, specs: dict[str, tuple[str, float]], series: Series) -> DataFrame:
    """Add bias-corrected decayed standard deviations."""
    own_step = STEP not in df.columns
    df = numbered(df, series) if own_step else df
    requests, results = {}, {}
    for name, (x, alpha) in specs.items():
        here = F.col(x).isNotNull().cast("double")
        requests[f"_w_{name}"] = (here, alpha, 1 - alpha)
        requests[f"_ww_{name}"] = (here, alpha, (1 - alpha) ** 2)
        requests[f"_wx_{name}"] = (F.col(x), alpha, 1 - alpha)
        requests[f"_wxx_{name}"] = (F.col(x) * F.col(x), alpha, 1 - alpha)
        w, ww, wx, wxx = (F.col(f"_{k}_{name}") for k in ("w", "ww", "wx", "wxx"))
        mean = div(wx, w)
        biased = F.greatest(div(wxx, w) - mean * mean, F.lit(0.0))
        correction = F.when(w * w - ww > 1e-12, div(w * w, w * w - ww))
        results[name] = root(biased * correction)
    out = _decayed_sums(df, requests, series, STEP).withColumns(results).drop(*requests)
    return out.drop(STEP) if own_step else out


def with_ewm_recursive(df: DataFrame, specs: dict[str, tuple[str, float]], series: Series) -> DataFrame:
    """Add y(t) = (1-alpha) y(t-1) + alpha x(t), started at the first known x.

    Expects no nulls after the first known value (carry values forward first).
    """
    own_step = STEP not in df.columns
    df = numbered(df, series) if own_step else df
    firsts = {
        f"_first_{n}": F.min(F.when(F.col(x).isNotNull(), F.col(STEP))).over(series.whole())
        for n, (x, _) in specs.items()
    }
    df = df.withColumns(firsts)
    requests = {
        n: (
            F.col(x) * F.when(F.col(STEP) == F.col(f"_first_{n}"), F.lit(1.0)).otherwise(F.lit(alpha)),
            alpha,
            1 - alpha,
        )
        for n, (x, alpha) in specs.items()
    }
    out = _decayed_sums(df, {f"_y_{n}": r for n, r in requests.items()}, series, STEP)
    out = out.withColumns(
        {n: F.when(F.col(STEP) >= F.col(f"_first_{n}"), F.col(f"_y_{n}")) for n in specs}
    ).drop(*firsts, *[f"_y_{n}" for n in specs])
    return out.drop(STEP) if own_step else out
