"""Tables shared between stages, native word helpers and the rows-of-text plumbing of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketrisk.functions.lineage import ensure_checkpoint_dir

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\u000b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end, but for the lasting ones."""
    folder = new_folder(spark)
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder: lineage ends there and nothing is recomputed.

    Inside :func:`scratch` the table goes with it unless it is ``lasting``.
    """
    within = None if lasting else _scratch.get()
    path = f"{within}/{uuid.uuid4().hex}" if within else new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text that is not null; empty without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` begins like that."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = f"_{wanted}"
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
