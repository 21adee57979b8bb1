"""Which columns make up a series, and the windows that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HALO = "is_halo"


@dataclass(frozen=True)
class Series:
    """Column roles shared by all operators.

    ``keys`` identify the instrument (may be empty for one single series),
    ``session`` is the session date and ``order`` the position inside a session.

    ``block`` is set when a session may be too large for one task.  The minute
    table then carries a block column and copies of the rows that precede each
    block (flagged ``is_halo``, see :func:`marketrisk.functions.ordered.blocked`),
    so bounded look-back windows stay exact inside one block.
    """

    keys: tuple[str, ...] = ()
    session: str = "session_date"
    order: str = "minute_of_session"
    block: str | None = None

    @property
    def by_session(self) -> list[str]:
        return [*self.keys, self.session]

    @property
    def minute_parts(self) -> list[str]:
        return [*self.by_session, self.block] if self.block else self.by_session

    def minutes(self) -> WindowSpec:
        """Rows of one session (or one block of it) in time order."""
        return Window.partitionBy(*self.minute_parts).orderBy(self.order)

    def days(self) -> WindowSpec:
        """Sessions of one instrument in date order.

        A daily table holds one row per instrument and calendar day, so such a
        partition grows with history length only, never with the tick volume.
        """
        return Window.partitionBy(*self.keys).orderBy(self.session)

    def whole(self) -> WindowSpec:
        """All sessions of one instrument, unordered."""
        return Window.partitionBy(*self.keys)

    def unblocked(self) -> "Series":
        return replace(self, block=None)


def owned(df: DataFrame, series: Series) -> DataFrame:
    """Drop the look-back copies of a blocked minute table."""
    if series.block is None:
        return df
    return df.filter(~F.col(HALO)).drop(HALO, series.block)
