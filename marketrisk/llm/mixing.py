"""Mixing sources to target weights by whole repetitions plus one seeded coin per document.

Tokens are summed per source; a source's target over its size is its repetition rate.  A document is
taken floor(rate) times, and once more with probability equal to the fraction; the coin is a hash of the
document's id, its text and a seed.  Of n rows alike in id, source and text, floor(n * fraction) are taken once
more and the coin is for the rest, so a source of copies without ids meets its target as well.  Of ``TRIALS`` seeds, each source takes the one whose total comes nearest to its
target: all are tried in the same aggregation, so the choice costs no further pass.

Defined cases: a null or empty text has size 0.  A null source is a source of its own, last in order.
Repeated ids with different texts toss different coins.  A source without words has target 0 and is taken 0 times.  Other columns
pass through.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.llm.ordering import running_offsets
from marketrisk.llm.shared import WORD, free_name, materialised, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
TRIALS = 64


def sizes(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """md5 of "doc_id:text"; a null id counts as "null"."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text))


def coin(key: Column, seed: Column | int) -> Column:
    """Uniform number in [0, 1): the first 32 bits of md5("seed:key")."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    hashed = F.md5(F.concat_ws(":", seed.cast("string"), key))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(2**32)


def extras(rows: Column, part: Column, key: Column, seed: Column | int) -> Column:
    """How many of ``rows`` rows alike are taken once more."""
    expected = rows * part
    return F.floor(expected) + (coin(key, seed) < expected - F.floor(expected)).cast("long")


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """Add ``target`` to a table of (source, size): weights repeat along the sources' order.

    A source stops at ``limit`` times its size and its excess is shared by weight among the others, until none
    is above.  Each round is one aggregation to two numbers; a source that stopped stays stopped, so there are
    at most as many rounds as distinct ratios of size to weight.
    """
    ranked = running_offsets(sources, [F.col("source").asc_nulls_last()], F.lit(1), "_before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_before") % len(weights) + 1).cast("int"))
    table = materialised(
        ranked.select("source", "size", weight.alias("_w"), (F.col("size") * F.lit(float(limit))).alias("_cap"))
    )
    total = table.agg(F.sum("size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.lit(level) * F.col("_w") > F.col("_cap")
        used, left = table.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("_w"))), F.lit(0.0)),
        ).first()
        if not left:
            break
        higher = (total * share - used) / left
        if higher == level:
            break
        level = higher
    reach = F.least(F.lit(float(level or 0.0)) * F.col("_w"), F.col("_cap"))
    return table.select("source", F.col("size").alias("source_size"), reach.alias("target"))


ALIKE = ("key", "source", "size")
SALTS = 64


def rates(alike: DataFrame, trials: int = TRIALS) -> DataFrame:
    """Per source: size, target, whole repetitions, fraction and the chosen seed, from ``n`` rows of each ``ALIKE``."""
    plan = targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumns({"whole": F.floor(ratio).cast("long"), "part": ratio - F.floor(ratio)})
    plan = materialised(plan)
    rows = alike.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("size").alias("_c"), F.col("n").alias("_n"))
    joined = rows.join(plan, F.col("_s").eqNullSafe(F.col("source")))
    extra = joined.groupBy("source", "source_size", "target", "whole", "part").agg(
        F.array(
            *[F.sum(F.col("_c") * extras(F.col("_n"), F.col("part"), F.col("_k"), k)) for k in range(trials)]
        ).alias("_taken")
    )
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    gaps = F.transform("_taken", lambda x, k: F.struct(F.abs(x - wanted).alias("gap"), k.alias("seed")))
    return extra.select("source", "source_size", "target", "whole", "part", F.array_min(gaps)["seed"].alias("seed"))


def numbered(rows: DataFrame, m: str) -> DataFrame:
    """Add ``place`` to ``m``: the number of a row among the rows alike, from 0; they are counted over salts first."""
    at = [f"{m}.{c}" for c in ALIKE]
    salt = f"{m}_salt"
    rows = materialised(rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    counts = rows.groupBy(*[F.col(c).alias(f"{m}_{k}") for c, k in zip(at, ALIKE, strict=True)], F.col(salt).alias(f"{m}_at")).count()
    before = Window.partitionBy(*[f"{m}_{c}" for c in ALIKE]).orderBy(f"{m}_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(f"{m}_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*at, salt).orderBy(salt)
    own = rows.withColumn(f"{m}_own", F.row_number().over(inside) - 1)
    same = F.col(salt) == F.col(f"{m}_at")
    for c, k in zip(at, ALIKE, strict=True):
        same &= F.col(c).eqNullSafe(F.col(f"{m}_{k}"))
    return own.join(counts, same).withColumn(m, F.col(m).withField("place", F.col(f"{m}_before") + F.col(f"{m}_own")))


def planned(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text"):
    """(table, name of its plan column): every row of ``docs`` with a struct of size, source_size, target, copies.

    Rows alike in id, source and text are numbered apart from the others.  Joins are left to the size limits of Spark's
    own planning and to adaptive execution, which splits a hot source.
    """
    m = free_name(docs, "_mix")
    words = text_or_empty(f"`{text}`")
    row = F.struct(
        row_key(F.col(f"`{doc_id}`"), words).alias("key"), F.col(f"`{source}`").alias("source"), sizes(words).alias("size")
    )
    sized = docs.withColumn(m, row)
    alike = materialised(sized.groupBy(*[F.col(m)[c].alias(c) for c in ALIKE]).agg(F.count(F.lit(1)).alias("n")))
    plan = materialised(rates(alike))
    plan = plan.select(*[F.col(c).alias(f"{m}_{c}") for c in plan.columns])
    # written, so that its size is known before the texts are: a small one is broadcast and no text is shuffled
    repeated = materialised(alike.filter("n > 1").select(*[F.col(c).alias(f"{m}_r_{c}") for c in alike.columns]))
    same = F.lit(True)
    for c in ALIKE:
        same &= F.col(m)[c].eqNullSafe(F.col(f"{m}_r_{c}"))
    single = sized.join(repeated, same, "left_anti").withColumn(
        m, F.col(m).withField("n", F.lit(1).cast("long")).withField("place", F.lit(0).cast("long"))
    )
    several = numbered(
        sized.join(repeated, same).withColumn(m, F.col(m).withField("n", F.col(f"{m}_r_n"))).select(*sized.columns), m
    ).select(*sized.columns)
    joined = single.unionByName(several).join(plan, F.col(m)["source"].eqNullSafe(F.col(f"{m}_source")), "left")
    once_more = F.col(m)["place"] < extras(F.col(m)["n"], F.col(f"{m}_part"), F.col(m)["key"], F.col(f"{m}_seed"))
    return (
        joined.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.struct(
                F.col(m)["size"].alias("size"),
                F.col(f"{m}_source_size").alias("source_size"),
                F.col(f"{m}_target").alias("target"),
                (F.col(f"{m}_whole") + once_more.cast("long")).alias("copies"),
            ).alias(m),
        ),
        m,
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    table, m = planned(docs, doc_id, source, text)
    copies = F.sequence(F.lit(1), F.col(m)["copies"].cast("int"))
    return table.filter(F.col(m)["copies"] > 0).withColumn(m, F.explode(copies)).drop(m)
