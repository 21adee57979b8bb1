"""Order-dependent work on groups that may be too large for one task.

A session, or a whole table, can hold a third of all rows.  A plain window over it
would sort it in one task.  The helpers here cut such a group along its clock:

* :func:`positioned` gives every row its exact position.  Rows are numbered inside
  small clock buckets; the (tiny) table of bucket counts supplies the offsets.
* :func:`blocked` cuts a positioned group into blocks of equal size and copies the
  few rows before each block into it, so that bounded look-back frames stay exact.
* :func:`running_totals` is the same two-level idea for running sums, :func:`carried_by_bucket`
  for last known values.
* :func:`exact_quantiles` finds exact order statistics with two aggregations:
  a sketch brackets the wanted ranks, then only the bracketed values are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.functions.lineage import checkpointed
from marketrisk.series import HALO, Series

BLOCK_ROWS = 65_536
SALTS = 32
SKETCH_ACCURACY = 20_000
#: Of the sketches whose bracketed values are listed in place: at most 8 / WIDE_ACCURACY of a group's values.
WIDE_ACCURACY = 2_000
BRACKET_BUCKETS = 256


def positioned(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    clock: Column,
    position: str,
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group's order.

    ``clock`` must not decrease along ``order``; it sets the buckets inside which rows
    are numbered, so it should map a few million rows at most to one value.  ``size``
    optionally names a column for the number of rows in the group.
    """
    group = list(group)
    bucket = "_bucket"
    keyed = df.withColumn(bucket, clock)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *group,
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*group)).alias(size)] if size else []),
    )
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return (
        keyed.withColumn("_inside", inside)
        .join(offsets, [*group, bucket])
        .withColumn(position, F.col("_before") + F.col("_inside"))
        .drop(bucket, "_inside", "_before")
    )


def blocked(
    df: DataFrame, series: Series, look_back: int, block: str = "block", rows: int = BLOCK_ROWS
) -> tuple[DataFrame, Series]:
    """Cut sessions into blocks of ``rows`` positions, each led by ``look_back`` copied rows.

    ``series.order`` must be a gap-free position (see :func:`positioned`).  A session that
    fits one block gains no copies.
    """
    if not 0 < look_back < rows:
        raise ValueError("look_back must be positive and smaller than a block")
    at = F.col(series.order) - 1
    home = F.floor(at / F.lit(rows))
    near_end = F.pmod(at, F.lit(rows)) >= rows - look_back
    cut = (
        df.withColumn("_home", home)
        .withColumn(
            block,
            F.explode(
                F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
            ),
        )
        .withColumn(HALO, F.col(block) != F.col("_home"))
        .drop("_home")
        .repartition(*series.by_session, block)
    )
    return cut, Series(series.keys, series.session, series.order, block)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: dict[str, str],
    bucket_descending: bool = False,
) -> DataFrame:
    """Add running sums (``sums`` maps new name to column) along ``order`` inside ``group``.

    ``bucket`` must be monotone along ``order`` (falling when ``bucket_descending``).  Only
    one bucket's rows share a task; bucket sums carry the rest.
    """
    group = list(group)
    keyed = df.withColumn("_bucket", bucket)
    along = F.col("_bucket").desc() if bucket_descending else F.col("_bucket").asc()
    before = Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = keyed.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = per_bucket.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
        .join(offsets, [*group, "_bucket"])
        .withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums})
        .drop("_bucket", *[f"_i_{n}" for n in sums], *[f"_b_{n}" for n in sums])
    )


def same_keys(columns: Sequence[str], other: str) -> Column:
    """Equality of columns with their namesakes of the other side, which carry the prefix ``other``; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other + c)) for c in columns])


def carried_by_bucket(
    df: DataFrame, group: Sequence[str], at: str, bucket: Column, values: dict[str, str], backward: bool = False
) -> DataFrame:
    """Add the last known value up to each row (``values`` maps new name to column), or the next from it on.

    ``at`` orders a group's rows and ``bucket`` must not decrease along it.  Only one bucket's rows share a task: the last
    known value of each bucket, one row per bucket, is carried over the buckets and fills what a bucket's start lacks.
    Rows with a null ``at`` come first.  Null keys are one group.
    """
    group = list(group)
    along = F.col("_bucket").desc_nulls_last() if backward else F.col("_bucket").asc_nulls_first()
    clock = F.col(at).desc_nulls_last() if backward else F.col(at).asc_nulls_first()
    latest = F.min_by if backward else F.max_by
    keyed = df.withColumn("_bucket", bucket)
    # a null time comes before all others
    known = {n: F.when(F.col(c).isNotNull(), F.struct(F.col(at).isNotNull().alias("dated"), F.col(at).alias("at"))) for n, c in values.items()}
    ends = keyed.groupBy(*group, "_bucket").agg(*[latest(c, known[n]).alias(f"_e_{n}") for n, c in values.items()])
    before = Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*group, "_bucket"]],
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values],
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.withColumns({f"_i_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in values.items()})
    return (
        own.join(carried, same_keys([*group, "_bucket"], "_k_"))
        .withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values})
        .drop("_bucket", *[f"_k_{c}" for c in [*group, "_bucket"]], *[f"{p}_{n}" for n in values for p in ("_i", "_c")])
    )


def clock_of(df: DataFrame, at: str, column: Column | None = None) -> Column:
    """Buckets of a time column: years of dates, minutes of timestamps, 65,536 steps of a number."""
    kind, column = df.schema[at].dataType, F.col(at) if column is None else column
    if isinstance(kind, T.DateType):
        return F.year(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("minute", column)
    return F.floor(column / F.lit(BLOCK_ROWS))


def join_per_group(
    rows: DataFrame, table: DataFrame, group: Sequence[str], salt_by: str, salts: int = SALTS
) -> DataFrame:
    """Inner join of rows with a one-row-per-group table, a large group's rows spread over ``salts`` tasks.

    The salt is a hash of ``salt_by``, so a recomputed task sees the same rows; the small side is
    repeated once per salt.  Adaptive execution still broadcasts it when it turns out small.
    """
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*group, "_salt"])


def sketch_aggs(wanted: dict[str, tuple[str, float]], accuracy: int = SKETCH_ACCURACY) -> list[Column]:
    """Aggregates ``_s_<name>``: two values that enclose the wanted quantile of their column, but for one neighbour."""
    slack = 2.0 / accuracy
    return [
        F.percentile_approx(c, F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), F.lit(accuracy)).alias(
            f"_s_{n}"
        )
        for n, (c, q) in wanted.items()
    ]


def exact_quantiles(
    df: DataFrame, group: Sequence[str], wanted: dict[str, tuple[str, float]], salt_by: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group; ``wanted`` maps name to (column, level).

    Many groups need ``salt_by``, a column that differs between the rows of a group.  Without it
    the groups must be a handful (folds, say): their edges are broadcast.
    """
    return quantiles_between(df, df.groupBy(*group).agg(*sketch_aggs(wanted)), group, wanted, salt_by)


def quantiles_in_place(
    df: DataFrame,
    sketches: DataFrame,
    group: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    salt_by: str,
) -> DataFrame:
    """Exact quantiles of many columns from their sketches, with one look at the rows.

    Every batch of rows tells, per group and column, how many values lie below, at and above the edges, the nearest
    beyond them, and lists those strictly between: of a group's values some 4 to 8 / accuracy, whatever its size and ties.
    Spark adds up the counts, orders what is listed and picks the wanted ranks.  ``sketches`` should be checkpointed.
    """
    group, names = list(group), list(wanted)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    edge = lambda n, k: F.get(F.col(f"_s_{n}"), k).cast("double")
    edges = sketches.select(
        *group, *[x for k, n in enumerate(names) for x in (edge(n, 0).alias(f"_low_{k}"), edge(n, 1).alias(f"_high_{k}"))]
    )
    rows = df.select(*group, salt_by, *[F.col(c).cast("double").alias(f"_x_{k}") for k, c in enumerate(columns)])
    joined = join_per_group(rows, edges, group, salt_by).drop("_salt", *([] if salt_by in group else [salt_by]))
    counts = ("n", "below", "low", "high")
    doubles = ("at_low", "at_high", "top", "bottom")
    schema = T.StructType(
        [
            *[f for f in joined.schema.fields if f.name in group],
            T.StructField("_k", T.IntegerType()),
            *[T.StructField(f"_{c}", T.LongType()) for c in counts],
            *[T.StructField(f"_{c}", T.DoubleType()) for c in doubles],
            T.StructField("_inside", T.ArrayType(T.DoubleType())),
        ]
    )
    told = _told_by_batches(group, [columns.index(c) for c, _ in wanted.values()])
    found = (
        joined.mapInArrow(told, schema)
        .groupBy(*group, "_k")
        .agg(
            *[F.sum(f"_{c}").alias(f"_{c}") for c in counts],
            *[F.max(f"_{c}").alias(f"_{c}") for c in ("at_low", "at_high", "top")],
            F.min("_bottom").alias("_bottom"),
            F.array_sort(F.flatten(F.collect_list("_inside"))).alias("_inside"),
        )
    )
    first = F.col("_below") + F.col("_low")
    last = first + F.size("_inside")

    def at(k: Column) -> Column:
        return (
            F.when(k < F.col("_below"), F.col("_top"))
            .when(k < first, F.col("_at_low"))
            .when(k < last, F.get("_inside", (k - first).cast("int")))
            .when(k < last + F.col("_high"), F.col("_at_high"))
            .otherwise(F.col("_bottom"))
        )

    rank = (F.col("_n") - 1) * F.get(F.array(*[F.lit(q) for _, q in wanted.values()]), F.col("_k"))
    below, above = at(F.floor(rank)), at(F.ceil(rank))
    value = F.when(F.col("_n") > 0, below + (rank - F.floor(rank)) * (above - below))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_k") == k, value)).alias(n) for k, n in enumerate(names)])


def _told_by_batches(group: list[str], of: list[int]):
    """The task function of :func:`quantiles_in_place`; ``of`` are the numbers of the columns of the wanted quantiles."""

    def less(a, b):
        """As Spark orders doubles: NaN is the largest, and equal to itself."""
        return (a < b) | (np.isnan(b) & ~np.isnan(a))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, "int64")
            for c in group:
                key = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                code = np.unique(code * (key.max() + 1) + key, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            heads = batch.select(group).take(pa.array(order[starts]))
            owner = code[order]

            def sorted_by_group(name, batch=batch, order=order):
                column = batch.column(name)
                known = column.is_valid().to_numpy(zero_copy_only=False)[order]
                return column.fill_null(0.0).to_numpy(zero_copy_only=False)[order], known

            for k, column in enumerate(of):
                x, known = sorted_by_group(f"_x_{column}")
                low, bracketed = sorted_by_group(f"_low_{k}")
                high, _ = sorted_by_group(f"_high_{k}")
                known = known & bracketed
                below, above = known & less(x, low), known & less(high, x)
                at_low = known & ~below & ~less(low, x)
                at_high = known & ~above & ~at_low & ~less(x, high)
                inside = known & ~below & ~above & ~at_low & ~at_high
                count = lambda which, starts=starts: np.add.reduceat(which.astype("int64"), starts)
                n_below, n_above = count(below), count(above)
                top = np.fmax.reduceat(np.where(below, x, np.nan), starts)
                bottom = np.fmin.reduceat(np.where(above, x, np.nan), starts)
                ends = np.searchsorted(owner[inside], np.arange(len(starts) + 1))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[inside]))
                edge = lambda e, gone=~bracketed[starts]: pa.array(e[starts], mask=gone)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        *heads.columns,
                        pa.array(np.full(len(starts), k, "int32")),
                        *[pa.array(v) for v in (count(known), n_below, count(at_low), count(at_high))],
                        edge(low),
                        edge(high),
                        pa.array(top, mask=n_below == 0),
                        pa.array(bottom, mask=n_above == 0),
                        listed,
                    ],
                    names=[*group, "_k", "_n", "_below", "_low", "_high", "_at_low", "_at_high", "_top", "_bottom", "_inside"],
                )

    return told


def quantiles_between(
    df: DataFrame,
    sketches: DataFrame,
    group: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    salt_by: str | None = None,
) -> DataFrame:
    """:func:`exact_quantiles` from the sketches of the same rows (one row per group).

    A sketch misses a rank by at most ``1 / SKETCH_ACCURACY`` of the group, and not at all where that is
    less than a rank.  So the two wanted ranks lie between its edges or are their next neighbours.
    One pass counts the distinct values between the edges; of all values below (above) it keeps the count
    and the largest (smallest).  That combines on the map side, and what is left to order is about
    ``4 / SKETCH_ACCURACY`` of the group, in buckets of its range.  Groups of every size go this way.
    """
    group = list(group)
    edges = sketches.select(*group, *[f"_s_{n}" for n in wanted])
    if not group:
        joined = df.crossJoin(F.broadcast(edges))  # exactly one row of edges
    elif salt_by is None:
        joined = df.join(F.broadcast(edges), group)
    else:
        joined = join_per_group(df, edges, group, salt_by)

    def placed(n: str, c: str) -> Column:
        value, low, high = F.col(c), F.get(F.col(f"_s_{n}"), 0), F.get(F.col(f"_s_{n}"), 1)
        inside = F.coalesce(F.floor((value - low) / F.nullif(high - low, F.lit(0)) * BRACKET_BUCKETS), F.lit(0))
        bucket = F.when(value < low, -1).when(value > high, BRACKET_BUCKETS + 1).otherwise(inside).cast("int")
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(n).alias("name"),
                bucket.alias("bucket"),
                F.when(value.between(low, high), value).alias("inside"),
                value.alias("value"),
            ),
        )

    name, bucket = F.col("_m.name").alias("_name"), F.col("_m.bucket").alias("_at")
    counted = (
        joined.select(*group, F.explode(F.array(*[placed(n, c) for n, (c, _) in wanted.items()])).alias("_m"))
        .filter(F.col("_m").isNotNull())
        .groupBy(*group, name, bucket, F.col("_m.inside").alias("_inside"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_m.value").alias("_top"),
            F.min("_m.value").alias("_bottom"),
        )
        .withColumn("_value", F.when(F.col("_at") < 0, F.col("_top")).otherwise(F.col("_bottom")))
    )
    level = F.element_at(
        F.create_map(*[x for n, (_, q) in wanted.items() for x in (F.lit(n), F.lit(q))]), F.col("_name")
    )
    ranked = running_totals(
        counted.select(*group, "_name", "_at", "_value", "_n"), [*group, "_name"], [F.col("_value")], F.col("_at"), {"_upto": "_n"}
    )
    # Runs of a group are ordered: the wanted values are the first whose running count passes the rank.
    totals = counted.groupBy(*group, "_name").agg(((F.sum("_n") - 1) * level).alias("_rank"))
    picked = (
        ranked.join(totals, [*group, "_name"])
        .groupBy(*group, "_name", "_rank")
        .agg(
            F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("_value"))).alias("_lo"),
            F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("_value"))).alias("_hi"),
        )
        .withColumn("_q", F.col("_lo") + (F.col("_rank") - F.floor("_rank")) * (F.col("_hi") - F.col("_lo")))
    )
    return picked.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in wanted]
    )
