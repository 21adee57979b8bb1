"""Shards along a Hilbert curve over several metadata dimensions.

Source, language, size and id are quantised to quantile codes, rows are sorted by the index of their cell on
the Hilbert curve and the order is cut into runs of equal row counts (law ``rows``).  Neighbouring
rows of the curve agree in all dimensions at once, so every file covers a small box of each of them and readers
prune by any of them.  Sources and languages are ranked as whole strings, each weighing its rows.  Equal texts
share the source, language and id of the one with the smallest id and so lie together: a shard's edge may cut
a group, nothing else does.

Defined cases: null metadata come first, ids that are no numbers have code 0; a null or empty text has size 1 and
checksum 0; repeated rows are separate rows, in any order among themselves; an empty table gives no shard.  Other
columns pass through ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.ordering import hilbert_index, quantile_codes, running_offsets
from marketrisk.llm.shared import materialised, text_or_empty

SHARDS = 8
BITS = 5
SALTS = 16


def with_rank_code(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Add ``<column>_code``: where the middle row of the value lies among all rows in the order of whole values."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_offsets(counts, [F.col(column).asc_nulls_first()], F.col("_n"), "_before")
    total = counts.agg(F.sum("_n").alias("_rows"))
    code = F.floor((F.col("_before") + F.col("_n") / 2) * 2**bits / F.col("_rows")).cast("int")
    coded = placed.join(F.broadcast(total)).select(F.col(column).alias("_value"), code.alias(f"{column}_code"))  # one row
    return rows.join(coded, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1), BITS))


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, the curve index, shard and slot of every row."""
    text = text_or_empty()
    rows = materialised(
        docs.select(
            "doc_id",
            F.col("source").alias("_source"),
            F.col("lang").alias("_lang"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("_hash"),
            F.monotonically_increasing_id().alias("_uid"),
        )
    )
    same = ["text_crc32", "_hash", "size"]
    first = F.min(F.struct("doc_id", "_source", "_lang"))
    groups = rows.groupBy(*same).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # A text's copies may be a third of all rows: they are spread over salts, and the group's row repeated.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int"))
    met = salted.join(groups.withColumn("_salt", salts), [*same, "_salt"], "left").drop("_salt")
    own = {c: F.when(F.col("_first").isNull(), F.col(c)).otherwise(F.col(f"_first.{c}")) for c in ("_source", "_lang")}
    at_id = F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id"))
    narrow = met.withColumns({**own, "_id": at_id.try_cast("double")}).drop("_first")
    narrow = materialised(with_rank_code(with_rank_code(materialised(narrow), "_source"), "_lang"))
    coded = quantile_codes(narrow, {"_c": F.col("size").cast("double"), "_d": F.col("_id")}, BITS)
    curve = _curve("_source_code", "_lang_code", "_c", "_d").alias("curve")
    keyed = coded.select("doc_id", "size", "text_crc32", "_hash", "_uid", curve)
    order = ["curve", "text_crc32", "_hash", "size", "doc_id", "_uid"]
    placed = running_offsets(keyed, [F.col(c) for c in order], F.lit(1), "_before").drop("_hash", "_uid")
    total = placed.agg(F.count(F.lit(1)).alias("_rows"))
    # Integer arithmetic: rows before shard s are ceil(s * rows / shards), so counts differ by one at most.
    shard = F.expr(f"(_before * {shards}) div _rows")
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_before") - F.expr(f"(shard * _rows + {shards - 1}) div {shards}"))
        .drop("_before", "_rows")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the rows of ``docs`` as one folder of Parquet files per shard, sorted along the curve; returns the plan.

    ``doc_id`` must identify a row here, as the plan is joined back to the texts by it.
    """
    plan = materialised(assigned(docs, shards))
    placed = docs.join(plan.select("doc_id", "shard", "slot"), "doc_id")
    files = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    files.drop("slot").write.partitionBy("shard").parquet(path)
    return plan
