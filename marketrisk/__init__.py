"""Market-risk time series on Spark: sessions, realized measures, labels, folds, heads and metrics.

Every public operator takes a DataFrame plus a :class:`~marketrisk.series.Series`
(which columns identify an instrument, a session and a position inside it) and
returns a DataFrame.  Nothing here triggers a job, except model fitting in
``marketrisk.heads`` and the sinks in ``marketrisk.sources``.
"""

from marketrisk.series import Series

__all__ = ["Series"]
