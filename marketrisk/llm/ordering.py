"""Running offsets along a global order, without a one-task window, and Hilbert curve keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.shared import materialised


def running_offsets(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before this one in ``order``.

    Rows are range-partitioned and sorted; every partition writes its own running sums, so that the order is
    fixed once for all, and the table of partition totals (one row per partition, not per row of data) supplies
    what lies before each partition.  ``df`` should be narrow, as all its columns are shuffled once, and
    ``order`` fine enough for range partitioning to split it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn(name, weight.cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    added = [T.StructField("_part", T.IntegerType()), T.StructField("_upto", T.LongType())]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = before + np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
            if batch.num_rows:
                before = int(upto[-1])
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_upto"])

    fixed = materialised(ordered.mapInArrow(along, T.StructType([*ordered.schema.fields, *added])))
    totals = fixed.groupBy("_part").agg(F.sum(name).alias("_total"))
    # One row per partition, whatever the data: a window over all of them and a broadcast are bounded by that.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    return (
        fixed.join(F.broadcast(bases), "_part")
        .withColumn(name, F.col("_base") + F.col("_upto") - F.col(name))
        .drop("_part", "_upto", "_base")
    )


def quantile_codes(df: DataFrame, dims: dict[str, Column], bits: int, accuracy: int = 10_000) -> DataFrame:
    """Add per dimension a code of ``bits`` bits: how many of its 2**bits - 1 quantiles lie at or below the value.

    The quantiles come from a mergeable sketch over all rows; nulls get code 0.
    """
    levels = [k / 2**bits for k in range(1, 2**bits)]
    edges = df.agg(
        *[F.percentile_approx(value, levels, accuracy).alias(f"_e_{name}") for name, value in dims.items()]
    )  # one row of 2**bits - 1 numbers per dimension

    def code(name: str, value: Column) -> Column:
        below = F.size(F.filter(F.array_distinct(f"_e_{name}"), lambda edge: edge <= value))
        return F.when(value.isNull() | F.col(f"_e_{name}").isNull(), 0).otherwise(below).cast("int")

    coded = {name: code(name, value) for name, value in dims.items()}
    return df.join(F.broadcast(edges)).withColumns(coded).drop(*[f"_e_{name}" for name in dims])


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of rows of integer coordinates below 2**bits (dimensions x bits <= 62).

    Skilling's transform: coordinates are turned, from the top bit down, into the transposed index, whose bits
    are then interleaved.
    """
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        q = np.int64(1) << shift
        low = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(inverted, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        q = np.int64(1) << shift
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
    x ^= turn
    index = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> shift) & 1)
    return index
