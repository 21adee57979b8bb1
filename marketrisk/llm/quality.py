"""Host-level quality rules: a document falls with its own rules or with its host.

Every document gets a few native measures.  Rule failures are counted per host, each host's failure
rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts themselves (so that a
host of three documents is not judged by them alone), and the verdict on the host is joined back to its
documents.  Everything is built-in column functions.

Defined cases: a null or empty text has no words and fails ``too_short``.  A null host joins no host: its
documents are judged by their own rules only.  Null ids, repeated rows and extra columns pass through
unchanged, row by row; clashing names do not matter because measures live in one struct column whose
name is chosen to be free.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.llm.shared import SPACES, WORD, free_name, materialised, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
#: A host whose shrunk failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
#: Prior weight, in documents, when the hosts' rates do not spread beyond chance, and when there is nothing to fit.
POOLED_WEIGHT = 1e6
DEFAULT_WEIGHT = 10.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct of the measures and rule outcomes; every row and column of ``docs`` stays.

    Windows of five words are compared by 64-bit hashes within one text.
    """
    m = free_name(docs, "_rules")
    original = [F.col(f"`{c}`") for c in docs.columns]
    t = docs.select(*original, text_or_empty(f"`{text}`").alias(f"{m}_text"))
    w = t.select(
        *original,
        words(F.col(f"{m}_text")).alias(f"{m}_words"),
        F.filter(F.split(F.col(f"{m}_text"), "\n"), lambda line: line.rlike(WORD)).alias(f"{m}_lines"),
        (F.length(f"{m}_text") - F.length(F.translate(F.col(f"{m}_text"), SYMBOLS, ""))).alias(f"{m}_symbols"),
        F.length(F.translate(F.col(f"{m}_text"), SPACES, "")).alias(f"{m}_chars"),
    )
    h = w.select(
        *original,
        f"{m}_symbols",
        f"{m}_chars",
        F.size(f"{m}_words").alias(f"{m}_n"),
        F.size(f"{m}_lines").alias(f"{m}_nl"),
        (F.size(f"{m}_lines") - F.size(F.array_distinct(f"{m}_lines"))).alias(f"{m}_dup"),
        F.transform(f"{m}_words", lambda x: F.xxhash64(x)).alias(f"{m}_hashes"),
    )
    n, hashes = F.col(f"{m}_n"), F.col(f"{m}_hashes")
    windows = F.when(
        n >= WINDOW_WORDS,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW_WORDS),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW_WORDS)]),
        ),
    )
    rest = [f"{m}_symbols", f"{m}_chars", f"{m}_n", f"{m}_nl", f"{m}_dup"]
    g = h.select(*original, *rest, windows.alias(f"{m}_windows"))
    # Only texts in which some window returns are sorted.
    repeats = F.size(F.array_distinct(f"{m}_windows")) < F.size(f"{m}_windows")
    s = g.select(
        *original,
        *rest,
        F.when(
            repeats,
            F.sort_array(F.transform(f"{m}_windows", lambda x, i: F.struct(x.alias("window"), i.alias("at")))),
        ).alias(f"{m}_sorted"),
    )
    ordered = F.col(f"{m}_sorted")
    p = s.select(
        *original,
        *rest,
        F.sort_array(
            F.transform(
                F.filter(
                    ordered,
                    lambda x, i: (F.get(ordered, i + 1)["window"] == x["window"])
                    | (F.when(i > 0, F.get(ordered, i - 1)["window"]) == x["window"]),
                ),
                lambda x: x["at"],
            )
        ).alias(f"{m}_at"),
    )
    covered = F.aggregate(
        f"{m}_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(
            (at + WINDOW_WORDS).alias("end"),
            (acc["n"] + F.least(F.lit(WINDOW_WORDS), at + WINDOW_WORDS - acc["end"])).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    values = p.select(
        *original,
        F.struct(
            F.col(f"{m}_n").cast("long").alias("n_words"),
            F.col(f"{m}_chars").cast("long").alias("word_chars"),
            F.col(f"{m}_symbols").cast("long").alias("n_symbols"),
            F.col(f"{m}_nl").cast("long").alias("n_lines"),
            F.col(f"{m}_dup").cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ).alias(m),
    )
    base, failed = rules(F.col(m))
    return values.withColumn(
        m, F.struct(*[F.col(m)[x].alias(x) for x in MEASURES], base.alias("base_failed"), failed.alias("rule_failed"))
    )


def rules(m: Column) -> tuple[Column, Column]:
    """(base rules failed, any rule failed); only the first decides about the document itself."""
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    any_rule = (
        base
        | (10 * m["n_symbols"] > m["n_words"])
        | (10 * m["n_dup_lines"] > 3 * m["n_lines"])
        | (m["word_chars"] < 2 * m["n_words"])
        | (m["word_chars"] > 20 * m["n_words"])
    )
    return base, any_rule


def host_verdicts(scored: DataFrame, host: str, measures: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, rejected.

    The beta prior is fitted by moments to the hosts' failure rates (weighted by documents).
    """
    failed = F.col(measures)["rule_failed"].cast("long")
    hosts = (
        scored.filter(F.col(f"`{host}`").isNotNull())
        .groupBy(F.col(f"`{host}`").alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failures"))
    )
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("docs"),
        F.sum("failures").alias("bad"),
        (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("own"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"),
    )
    mean = F.col("bad") / F.col("docs")
    chance = mean * (1 - mean)
    spread = F.col("squares") - F.col("docs") * mean * mean
    room = chance * (F.col("docs") - F.col("own") - (F.col("hosts") - 1))
    correlation = F.when(room > 0, (spread - chance * (F.col("hosts") - 1)) / room)
    weight = (
        F.when(correlation.isNull(), F.lit(DEFAULT_WEIGHT))
        .when(correlation <= 1 / (1 + POOLED_WEIGHT), F.lit(POOLED_WEIGHT))
        .otherwise((1 - F.least(correlation, F.lit(0.999))) / F.least(correlation, F.lit(0.999)))
    )
    prior = total.select(mean.alias("mean"), weight.alias("weight"))
    rate = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return hosts.join(F.broadcast(prior)).select(  # exactly one row of prior
        "host", "n", "failures", rate.alias("rate"), (rate > max_rate).alias("rejected")
    )


def judged(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE):
    """(table, name of its measures column): every row of ``docs``, its measures, and ``kept`` within them.

    The measures are written once to the shared folder; the host table and the final join read them there.
    The join is left to adaptive execution: broadcast if the verdicts are few, else a sort-merge join whose
    hot host is split.
    """
    scored = materialised(measured(docs, text))
    m = scored.columns[-1]
    verdicts = host_verdicts(scored, host, m, max_rate).filter("rejected").select(F.col("host").alias(f"{m}_host"))
    verdicts = materialised(verdicts.withColumn(f"{m}_bad", F.lit(True)))
    joined = scored.join(verdicts, F.col(f"`{host}`") == F.col(f"{m}_host"), "left")
    kept = ~F.col(m)["base_failed"] & F.col(f"{m}_bad").isNull()
    return joined.withColumn(m, F.col(m).withField("kept", kept)).select(*[f"`{c}`" for c in scored.columns]), m


def filtered(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass their own base rules and whose host is not rejected."""
    table, m = judged(docs, host, text, max_rate)
    return table.filter(F.col(m)["kept"]).drop(m)
