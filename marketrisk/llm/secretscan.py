"""Secret scanning: fixed patterns, and a battery of randomness tests for everything that looks like a key.

Three fixed kinds (assigned passwords, access key ids, long hex strings) are found first.  The method adds
kind ``random``: maximal runs of key characters whose encoding is inferred (hex or letters and digits of one case, with
``-`` and ``_`` as separators that do not count; letters and digits of both cases; base64) are tested against the hypothesis
that they are uniformly random in that encoding: chi-squared of the symbol
counts, the Wald-Wolfowitz runs test about the alphabet's middle, and the lag-one serial correlation.  The
smallest of the three p-values, tripled, is the run's.  A Benjamini-Hochberg step over all runs
of the corpus, with weights growing with length as longer strings give the tests more power, rejects
those that are not random.  No weight dismisses a run whose own p is above the level, so a
random string of any length is dismissed with at most that probability.

What stands must also be unlike an ordinary identifier, so that few reports are false.  Under that null hypothesis
letters follow the frequencies of prose, and letters and digits come in stretches (``IDENTIFIER``); the likelihood of
the uniform encoding over that of the identifier has mean one under it and is thus evidence whose reciprocal bounds a
p-value, and it grows by a factor with every symbol.  The Benjamini-Hochberg rule over this evidence, valid for dependent
runs too, keeps the expected share of identifiers among the reports below ``FALSE_DISCOVERY``.

Positions are code points.  Everything is built-in column functions: matches come from regexp_extract_all, what
lies between them from split, and running lengths of both give the positions.

Defined cases: a null or empty text has no spans; repeated rows, null ids and other columns pass
through, each row being judged by its own text; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.llm.shared import free_name, materialised, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"(?i)password|passwd|secret|token|api_?key"
#: Maximal runs of these characters are candidates; for a run, "at least 32" is the same as dropping shorter ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEYLIKE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8
#: Symbols a candidate must have besides separators.
LEAST_SYMBOLS = 16
#: Share of truly random strings among the dismissed ones, and of ordinary identifiers among the reported ones.
FALSE_DISCOVERY = 0.05
#: Letters of English prose in percent, a to z (fixed values).
LETTERS = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4,
    0.15, 2.0, 0.074,
)
#: How an identifier goes on after a small letter (l), a capital (u) or a digit (d), and how it begins (^).  In one of a
#: single case all letters are l.
IDENTIFIER = {
    "l": {"l": 0.86, "u": 0.09, "d": 0.05},
    "u": {"l": 0.60, "u": 0.36, "d": 0.04},
    "d": {"l": 0.25, "u": 0.15, "d": 0.60},
    "^": {"l": 0.60, "u": 0.35, "d": 0.05},
}
ONE_CASE = {"l": {"l": 0.95, "d": 0.05}, "d": {"l": 0.35, "d": 0.65}, "^": {"l": 0.95, "d": 0.05}}
#: Matches and spans handled together, so that lists grow in proportion to their number.
BLOCK = 256
#: Code points of a text cut out together.
PIECE = 1024
#: Steps of log10 p in which the step-up rule is evaluated, and its floor.
STEPS_PER_DECADE, DECADES = 100, 30


def held(value: Column, result) -> Column:
    """``result`` of a value that is computed once, however often ``result`` mentions it inside lambdas."""
    return F.get(F.transform(F.array(value), result), 0)


def blocks_of(array: Column) -> Column:
    """An array in pieces of ``BLOCK`` elements."""
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(array), F.lit(1)) - 1) / BLOCK).cast("int"))
    return F.transform(numbers, lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))


def spans_of(text: Column, pattern: str, keep=None) -> Column:
    """Array of (start, end, match) of the non-overlapping matches of ``pattern``; ``keep`` tests a match's string.

    Positions are added up within blocks of matches and then over the blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    span_type = "array<struct<start:int,end:int,match:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), pair["match"].alias("match"))
        good = pair["match"].isNotNull() if keep is None else pair["match"].isNotNull() & keep(pair["match"])
        return F.struct(
            F.coalesce(end, begin).cast("int").alias("at"),
            F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["match"].alias("match")),
        )

    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span_type}>").alias("out"))

    def added(acc: Column, block: Column) -> Column:
        return F.struct(
            (acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved(block["out"], acc["at"])).alias("out")
        )

    paired = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    within = held(paired, lambda p: F.transform(blocks_of(p), lambda block: F.aggregate(block, start, step)))
    return F.aggregate(within, whole, added, lambda acc: F.flatten(acc["out"]))


def _gated(text: Column, gate: str, spans: Column) -> Column:
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal, by the Abramowitz-Stegun approximation 26.2.17 (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-x * x / 2) * poly)


def alphabet_of(body: Column) -> Column:
    """Symbols of the inferred encoding in the order of their values; null if none fits.

    Every encoding needs digits and letters together, so plain words and plain numbers are no candidates.
    """
    digits, small, large = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    has_digit, has_small, has_large = body.rlike("[0-9]"), body.rlike("[a-z]"), body.rlike("[A-Z]")
    bare = _bare(body)
    return (
        F.when(~has_digit | ~(has_small | has_large) | (F.length(bare) < LEAST_SYMBOLS), F.lit(None).cast("string"))
        .when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(digits + "abcdef"))
        .when(bare.rlike("^[0-9a-z]+$"), F.lit(digits + small))
        .when(bare.rlike("^[0-9A-Z]+$"), F.lit(digits + large))
        .when(body.rlike("^[0-9A-Za-z]+$"), F.lit(digits + large + small))
        .when(has_small & has_large, F.lit(digits + large + small + "+/"))
    )


def _bare(body: Column) -> Column:
    """Without separators."""
    return F.translate(body, "-_", "")


def _moments(codes: Column, size: Column) -> Column:
    """One pass over the symbol values: sums, products of neighbours, symbols of the upper half, changes of half."""
    zero = F.struct(
        *[F.lit(0.0).alias(c) for c in ("n", "sum", "squares", "products", "upper", "runs")],
        F.lit(None).cast("double").alias("last"),
        F.lit(None).cast("double").alias("first"),
    )

    def step(acc: Column, code: Column) -> Column:
        v = code.cast("double")
        half = (2 * v >= size).cast("double")
        last_half = (2 * acc["last"] >= size).cast("double")
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["sum"] + v).alias("sum"),
            (acc["squares"] + v * v).alias("squares"),
            (acc["products"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("products"),
            (acc["upper"] + half).alias("upper"),
            (acc["runs"] + F.when(acc["last"].isNull() | (half != last_half), 1.0).otherwise(0.0)).alias("runs"),
            v.alias("last"),
            F.coalesce(acc["first"], v).alias("first"),
        )

    return F.aggregate(codes, zero, step)


def evidence(body: Column, size: Column) -> Column:
    """log10 of the likelihood of uniform symbols over that of an ordinary identifier, from letters and digits alone."""
    plain = F.regexp_replace(body, "[^0-9A-Za-z]", "")
    small = F.lower(plain)
    digits, small_letters, large = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def times(text: Column, symbol: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))

    def transitions(kinds: Column, model: dict[str, dict[str, float]]) -> Column:
        total = F.lit(0.0)
        for before, after in model.items():
            for kind, share in after.items():
                seen = F.regexp_count(kinds, F.lit(f"^{kind}" if before == "^" else f"{before}(?={kind})"))
                total = total + seen * math.log10(share)
        return total

    letters = F.lit(0.0)
    for letter, percent in zip(small_letters, LETTERS, strict=True):
        letters = letters + times(small, letter) * math.log10(percent / sum(LETTERS))
    kinds = F.translate(plain, small_letters + large + digits, "l" * 26 + "u" * 26 + "d" * 10)
    mixed = F.contains(kinds, F.lit("l")) & F.contains(kinds, F.lit("u"))
    stretches = F.when(mixed, transitions(kinds, IDENTIFIER)).otherwise(
        transitions(F.replace(kinds, F.lit("u"), F.lit("l")), ONE_CASE)
    )
    identifier = stretches + letters - times(kinds, "d")
    uniform = -F.length(plain) * F.log10(F.least(size, F.lit(62.0)))
    return uniform - identifier


def with_p_value(candidates: Column) -> Column:
    """Add ``n``, ``p`` and ``evidence`` to an array of (start, end, body).

    ``p`` is that of "uniformly random in its encoding": the smallest p-value of the three tests, tripled; for
    ``evidence`` see there.  Candidates without an encoding are left out.
    """
    encoded = F.filter(
        F.transform(
            candidates,
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), alphabet_of(x["body"]).alias("alphabet")
            ),
        ),
        lambda x: x["alphabet"].isNotNull(),
    )

    def measured(x: Column) -> Column:
        alphabet = x["alphabet"]
        shown = (
            F.when(F.length(alphabet) == 64, F.translate(x["body"], "-_", "+/"))
            .when(F.length(alphabet) == 16, F.lower(_bare(x["body"])))
            .otherwise(_bare(x["body"]))
        )
        size = F.length(alphabet).cast("double")
        counts = F.transform(F.split(alphabet, ""), lambda c: F.length(shown) - F.length(F.replace(shown, c, F.lit(""))))
        codes = F.transform(F.split(shown, ""), lambda c: F.call_function("instr", alphabet, c) - 1)
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            size.alias("size"),
            F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c).alias("squares"),
            _moments(codes, size).alias("m"),
            evidence(x["body"], size).alias("evidence"),
        )

    def tested(x: Column) -> Column:
        m, size = x["m"], x["size"]
        n, df = m["n"], x["size"] - 1
        ratio = F.greatest(size / n * x["squares"] - n, F.lit(0.0)) / df
        uniform = (F.cbrt(ratio) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_uniform = F.when(uniform <= 0, 1.0).otherwise(_normal_tail(uniform) / 2)
        lower = n - m["upper"]
        mean = 1 + 2 * m["upper"] * lower / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(variance > 0, _normal_tail((m["runs"] - mean) / F.sqrt(variance))).otherwise(1.0)
        average = m["sum"] / n
        around = m["squares"] - n * average * average
        neighbours = m["products"] - average * (2 * m["sum"] - m["first"] - m["last"]) + (n - 1) * average * average
        p_serial = F.when(around > 0, _normal_tail((neighbours / around + 1 / n) * F.sqrt(n))).otherwise(0.0)
        p = F.least(F.lit(1.0), 3 * F.least(p_uniform, p_runs, p_serial))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), p.alias("p"), x["evidence"].alias("evidence")
        )

    return F.transform(F.transform(encoded, measured), tested)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct column: the spans of each fixed kind and the tested candidates; all rows and columns stay."""
    m = free_name(docs, "_secrets")
    whole = docs.withColumn(f"{m}_text", text_or_empty(f"`{text}`"))
    t = F.col(f"{m}_text")
    long_value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE
    found = whole.withColumns(
        {
            f"{m}_assign": _gated(t, ASSIGN_GATE, spans_of(t, ASSIGN, long_value)),
            f"{m}_access": _gated(t, ACCESS, spans_of(t, ACCESS)),
            f"{m}_hex": _gated(t, HEX, spans_of(t, HEX)),
            f"{m}_runs": _gated(t, KEYLIKE, spans_of(t, KEYLIKE)),
        }
    )
    base = F.concat(f"{m}_assign", f"{m}_access", f"{m}_hex")
    apart = held(
        base,
        lambda known: F.filter(
            f"{m}_runs", lambda r: ~F.exists(known, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        ),
    )
    bodies = F.transform(
        apart,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            F.rtrim(r["match"], F.lit("=")).alias("body"),
        ),
    )
    tested = found.withColumn(f"{m}_bodies", bodies).withColumn(f"{m}_tested", with_p_value(F.col(f"{m}_bodies")))
    return tested.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            *[F.transform(f"{m}_{k}", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias(k) for k in KINDS[:3]],
            F.col(f"{m}_tested").alias("tested"),
        ).alias(m),
    )


def _step(x: Column, mean_length: Column, level: float) -> Column:
    """Candidates as steps of -log10 of p over its weight, the length over the mean length; capped at the floor.

    A p above the level counts as 1 whatever its weight: every cut is above that step.
    """
    weighted = F.when(x["p"] > level, 1.0).otherwise(x["p"] * mean_length / x["n"])
    return F.least(
        F.floor(-F.log10(F.greatest(weighted, F.lit(10.0**-DECADES))) * STEPS_PER_DECADE), F.lit(DECADES * STEPS_PER_DECADE)
    )


def _evidence_step(x: Column) -> Column:
    """Steps of the evidence from 0 (none) to the cap; the smaller end of a step counts."""
    return F.least(F.greatest(F.floor(x["evidence"] * STEPS_PER_DECADE), F.lit(0)), F.lit(DECADES * STEPS_PER_DECADE))


def cuts(scored: DataFrame, m: str, level: float = FALSE_DISCOVERY) -> DataFrame:
    """One row: mean length of the candidates, the step from which on they are dismissed as not random, and the step of
    evidence from which on they are reported (both null: none).

    The step-up rules are evaluated on at most ``DECADES * STEPS_PER_DECADE`` counts, each with the cautious end of its step.
    """
    candidates = scored.select(F.explode(F.col(m)["tested"]).alias("x"))
    mean = candidates.agg(F.avg("x.n").alias("mean_length"))
    joined = candidates.join(F.broadcast(mean))  # one row
    step, proof = _step(F.col("x"), F.col("mean_length"), level), _evidence_step(F.col("x"))
    both = joined.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("step")) for k, v in enumerate((step, proof))])).alias("s"))
    counts = both.groupBy("s.rule", "s.step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("rule").orderBy(F.col("step").desc())  # a bounded number of steps, however many candidates
    ranked = counts.select(
        "rule", "step", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("rule")).alias("all")
    )
    passing = F.pow(F.lit(10.0), -F.col("step") / STEPS_PER_DECADE) <= level * F.col("rank") / F.col("all")
    lowest = lambda rule: F.min(F.when(passing & (F.col("rule") == rule), F.col("step")))
    return mean.join(F.broadcast(ranked.agg(lowest(0).alias("cut"), lowest(1).alias("proof"))))


def found(docs: DataFrame, text: str = "text", level: float = FALSE_DISCOVERY) -> tuple[DataFrame, str]:
    """(table, name of its column): every row with an array of spans (start, end, kind) ordered by start, then kind.

    The step-up rule needs the candidates of all rows, so rows are scanned twice, once for the cut and once for the
    result: cheaper than keeping a second copy of all texts.
    """
    scored = scanned(docs, text)
    m = scored.columns[-1]
    names = ("mean_length", "cut", "proof")
    cut = materialised(cuts(scored, m, level).select(*[F.col(c).alias(f"{m}_{c}") for c in names]))
    joined = scored.join(F.broadcast(cut))  # one row
    kept = F.filter(
        F.col(m)["tested"],
        lambda x: F.coalesce(_step(x, F.col(f"{m}_mean_length"), level) < F.col(f"{m}_cut"), F.lit(True))
        & F.coalesce(_evidence_step(x) >= F.col(f"{m}_proof"), F.lit(False)),
    )
    parts = [F.col(m)[k] for k in KINDS[:3]] + [kept]

    def of_kind(part: Column, kind: int) -> Column:
        return F.transform(
            part, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    spans = F.concat(*[of_kind(part, kind) for kind, part in enumerate(parts)])
    return joined.withColumn(m, F.sort_array(spans)).drop(*[f"{m}_{c}" for c in names]), m


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", level: float = FALSE_DISCOVERY) -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``[kind]``; overlapping spans by the first one's.

    ``chars`` names a column for the code points of the text, brought up to date where the text changed.
    """
    table, m = found(docs, text, level)
    t, spans = F.col(f"`{text}`"), F.col(m)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        some = F.slice(cut, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), (start - first * PIECE).cast("int") + 1, end - start)

    def rebuilt_from(cut: Column) -> Column:
        """Per block of spans: what is written, starting at the greatest end before; then the blocks and the rest."""
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def block_step(acc: Column, block: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))

            def step(inner: Column, s: Column) -> Column:
                fresh = s["start"] >= inner["at"]
                piece = F.concat(between(cut, inner["at"], s["start"]), F.get(names, s["kind"]))
                return F.struct(
                    F.greatest(inner["at"], s["end"]).alias("at"),
                    F.when(fresh, F.concat(inner["out"], piece)).otherwise(inner["out"]).alias("out"),
                )

            return F.transform(
                F.array(F.aggregate(block, start, step)),
                lambda done: F.struct(done["at"].alias("at"), F.array_append(acc["out"], done["out"]).alias("out")),
            )[0]

        return F.aggregate(
            held(spans, blocks_of),
            nothing,
            block_step,
            lambda acc: F.concat(F.array_join(acc["out"], ""), between(cut, acc["at"], F.length(t))),
        )

    rebuilt = held(pieces, rebuilt_from)
    hit = F.size(spans) > 0
    changed = table.withColumn(text, F.when(hit, rebuilt).otherwise(t))
    if chars in docs.columns:
        changed = changed.withColumn(chars, F.when(hit, F.length(text).cast("long")).otherwise(F.col(f"`{chars}`")))
    return changed.drop(m)
