"""Independent Spark jobs from a bounded pool of threads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
#: Jobs submitted at a time; Spark shares the executors between them.
AT_ONCE = 8


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """Results of the tasks, in their order; each runs its own jobs.  The first failure is raised."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [future.result() for future in started]
