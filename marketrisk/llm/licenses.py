"""License detection by ordered signature rules.

A text is reduced to its words (letters, digits and everything beyond ASCII), joined by single spaces.
Rules are regular expressions over that: every license name in every form of naming it, most telling form first.
Keywords gate the rules.  They are derived from the rules' own expressions: what every match of a form and every match of
a name must contain, looked for among the joined words; a rule runs only where both stand.  Texts are reduced to
words only if they contain some of those keywords' words in any spacing.  Overlapping detections are resolved by
priority and containment: going through them by start, longest first, then by rule order, a detection inside one that
stands is suppressed.  Everything is built-in column functions in one narrow map over the documents.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; repeated rows, null ids
and other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.llm.shared import LOWER, UPPER, free_name, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, expression of its name (over words joined by single spaces), short identifier; None if another row has it.
LICENSES = (
    ("mit", "(expat )?mit( expat)?", "mit"),
    ("mit-0", "mit( no attribution| 0)", "mit 0"),
    ("apache-1.1", "apache( software)?( license)?( version)?( v ?| )1 1", "apache 1 1"),
    ("apache-2.0", "apache( software)?( license)?( version)?( 2 0| 2| v2( 0)?)", "apache 2 0"),
    ("apache", "apache( software)?", "apache"),
    ("gpl-2.0", "(gnu )?general public license( version)?( v ?| )2( 0)?", "gpl 2 0( only| or later)?"),
    ("gpl-3.0", "(gnu )?general public license( version)?( v ?| )3( 0)?", "gpl 3 0( only| or later)?"),
    ("gpl", "(gnu )?general public", "gpl"),
    ("gpl-2.0", "(gnu )?gpl( version)?( 2| v2|v2)( 0)?", "gpl2"),
    ("gpl-3.0", "(gnu )?gpl( version)?( 3| v3|v3)( 0)?", "gpl3"),
    ("gpl", "(gnu )?gpl", None),
    ("lgpl-2.1", "(gnu )?(lesser|library) general public license( version)?( v ?| )2 1", "lgpl 2 1( only| or later)?"),
    ("lgpl-3.0", "(gnu )?lesser general public license( version)?( v ?| )3( 0)?", "lgpl 3 0( only| or later)?"),
    ("lgpl", "(gnu )?(lesser|library) general public", "lgpl"),
    ("lgpl-2.1", "(gnu )?lgpl( version)?( 2 1| v ?2 1|v2 1)", None),
    ("lgpl-3.0", "(gnu )?lgpl( version)?( 3| v ?3|v3)( 0)?", None),
    ("lgpl", "(gnu )?lgpl", None),
    ("agpl-3.0", "(gnu )?affero general public license( version)?( v ?| )3( 0)?", "agpl 3 0( only| or later)?"),
    ("agpl", "(gnu )?affero general public", "agpl"),
    ("agpl-3.0", "(gnu )?agpl( version)?( 3| v ?3|v3)( 0)?", None),
    ("agpl", "(gnu )?agpl", None),
    ("bsd-2-clause", "(2 clause|simplified|freebsd) bsd|bsd( 2 clause)", "bsd 2 clause"),
    ("bsd-3-clause", "(3 clause|new|revised|modified) bsd|bsd( 3 clause)", "bsd 3 clause"),
    ("bsd", "bsd", "bsd"),
    ("mpl-1.1", "mozilla public license( version)?( v ?| )1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public license( version)?( v ?| )2 0", "mpl 2 0"),
    ("mpl", "mozilla public", "mpl"),
    ("mpl-1.1", "mpl( version)?( 1 1| v ?1 1|v1 1)", None),
    ("mpl-2.0", "mpl( version)?( 2| v ?2|v2)( 0)?", None),
    ("mpl", "mpl", None),
    ("epl-1.0", "eclipse public license( version)?( v ?| )1 0", "epl 1 0"),
    ("epl-2.0", "eclipse public license( version)?( v ?| )2 0", "epl 2 0"),
    ("epl", "eclipse public", "epl"),
    ("epl-1.0", "epl( version)?( 1| v ?1|v1)( 0)?", None),
    ("epl-2.0", "epl( version)?( 2| v ?2|v2)( 0)?", None),
    ("epl", "epl", None),
    ("eupl", "european union public( license)?( version| v)?( 1 [12])?", "eupl( 1 [12])?"),
    ("eupl", "eupl( version| v)?( 1 [12])?", None),
    ("cddl", "common development and distribution", "cddl( 1 [01])?"),
    ("cddl", "cddl( version| v)?( 1 [01])?", None),
    ("cpl", "common public", "cpl 1 0"),
    ("cpl", "cpl( version| v)?( 1 0)?", None),
    ("artistic-2.0", "artistic license( version)? 2( 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib( libpng)?", "zlib"),
    ("boost", "boost software( license)?( version)?( 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("openssl", "openssl", "openssl"),
    ("python", "python software foundation", "psf 2 0"),
    ("python", "psf", None),
    ("cc0-1.0", "(creative commons )?cc0( 1 0)?( universal)?", "cc0 1 0"),
    ("cc-by", "cc by( [1-4] 0)?", "cc by [1-4] 0"),
    ("cc-by-sa", "cc by sa( [1-4] 0)?", "cc by sa [1-4] 0"),
    ("cc-by-nc", "cc by nc( [1-4] 0)?", "cc by nc [1-4] 0"),
    ("cc-by-nd", "cc by nd( [1-4] 0)?", "cc by nd [1-4] 0"),
    ("cc-by-nc-sa", "cc by nc sa( [1-4] 0)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc by nc nd( [1-4] 0)?", "cc by nc nd [1-4] 0"),
    ("cc-by", "creative commons attribution( [1-4] 0)?( international| unported)?", "cc by"),
    ("cc-by-sa", "creative commons attribution share ?alike( [1-4] 0)?( international| unported)?", "cc by sa"),
    ("cc-by-nc", "creative commons attribution non ?commercial( [1-4] 0)?( international| unported)?", "cc by nc"),
    ("cc-by-nd", "creative commons attribution no ?deriv(ative)?s( [1-4] 0)?( international| unported)?", "cc by nd"),
    ("ofl-1.1", "(sil )?open font( license)?( version)?( 1 1)?", "ofl 1 1"),
    ("ofl-1.1", "(sil )?ofl( version| v)?( 1 1)?", None),
    ("odbl", "open database", "odbl 1 0"),
    ("odbl", "odbl( version| v)?( 1 0)?", None),
    ("fdl", "(gnu )?free documentation( license)?( version| v)?( 1 [123])?", "gfdl( 1 [123])?"),
    ("fdl", "(gnu )?fdl( version| v)?( 1 [123])?", None),
    ("fdl", "gfdl( version| v)?( 1 [123])?", None),
)

#: Forms of naming a license, most telling first: expression and confidence.  ``full`` is a name that says "license" itself.
FORMS = (
    ("spdx license identifier {short}", 1.0),
    ("(this|the) (work|file|program|project|software|code|library|package|document|source code) is "
     "(licensed|released|distributed|made available|provided) under (the )?(terms of )?(the )?({name})( licen[sc]e)?", 0.98),
    ("(licensed|released|distributed|published|available) under (the )?(terms (and conditions )?of )?(the )?({name})( licen[sc]e)?", 0.95),
    ("(subject to|governed by|covered by|under) the (terms of )?(the )?({name}) licen[sc]e", 0.9),
    ("licen[sc]e ({name})", 0.8),
    ("{full}", 0.75),
    ("({name}) licen[sc]e", 0.7),
)

#: Forms that name a license by its own words.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0.97),
    ("bsd", "redistributions? (and use )?in source and binary forms with or without modification", 0.97),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 0.97),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.97),
    ("public-domain", "(dedicated|released|placed) (in|in ?to) the public domain", 0.9),
    ("public-domain", "(is )?in the public domain", 0.8),
    ("proprietary", "(copyright .{0,60})?all rights reserved", 0.5),
    ("apache-2.0", "you may not use this file except in compliance with the license", 0.9),
)

SPAN = "array<struct<start:int,end:int,rule:int>>"


def variants(expression: str) -> frozenset[str]:
    """All strings that match; of the expressions' ``.{0,60}`` two examples."""
    at = 0

    def alternatives() -> set[str]:
        nonlocal at
        out = sequence()
        while expression[at : at + 1] == "|":
            at += 1
            out |= sequence()
        return out

    def sequence() -> set[str]:
        nonlocal at
        out = {""}
        while at < len(expression) and expression[at] not in "|)":
            if expression[at] == "(":
                at += 1
                atom = alternatives()
                at += 1
            elif expression[at] == "[":
                members, end = expression[at + 1 :], expression.index("]", at)
                members = members[: end - at - 1]
                atom = {chr(c) for c in range(ord(members[0]), ord(members[2]) + 1)} if members[1:2] == "-" else set(members)
                at = end + 1
            elif expression.startswith(".{0,60}", at):
                atom = {"", "2020 by some "}
                at += len(".{0,60}")
            else:
                atom = {expression[at]}
                at += 1
            if expression[at : at + 1] == "?":
                atom |= {""}
                at += 1
            out = {left + right for left in out for right in atom}
        return out

    return frozenset(alternatives())


@cache
def keyword(expression: str) -> str:
    """The longest string from the start of a word on that stands in every match, set in spaces; "" if there is none.

    A NUL in the expression stands for whatever is to be filled in.
    """
    every = [f" {v} " for v in variants(expression)]
    least = min(every, key=len)
    parts = (least[i:j] for i in range(len(least)) if least[i] == " " for j in range(i + 2, len(least) + 1))
    return max((p for p in parts if "\0" not in p and all(p in v for v in every)), key=len, default="")


@cache
def rules() -> list[tuple[tuple[str, str], str, str, float]]:
    """((keyword of its name, keyword of its form), expression, label, confidence) in order of priority: forms first, then
    the licenses' order."""
    table = [((keyword(body), ""), body, label, sure) for label, body, sure in BODIES]
    for form, sure in FORMS:
        form_word = keyword(form.format(name="\0", short="\0", full="\0"))
        for label, name, short in LICENSES:
            if (form == "{full}" and " license" not in name) or ("{short}" in form and short is None):
                continue
            # identifiers are many and rare: one keyword for all of them
            words = (form_word, "") if "{short}" in form else (keyword(name), form_word)
            table.append((words, form.format(name=name, short=short, full=name), label, sure))
    return table


def _contains_any(text: Column, words: set[str]) -> Column:
    found = F.lit(False)
    for word in sorted(words):
        found = found | text.contains(word)
    return found


def may_match(low: Column) -> Column:
    """False only for texts in which no rule and no fixed phrase is found, whatever stands between the words."""
    longest = lambda phrase: max(phrase.split(), key=len)
    alone, by_form = set(), {}
    for (name_word, form_word), *_ in rules():
        if "licen" in name_word + form_word:
            continue
        if form_word:
            by_form.setdefault(longest(form_word), set()).add(longest(name_word))
        else:
            alone.add(longest(name_word))
    found = low.contains("licen") | _contains_any(low, alone)
    for form_word, names in by_form.items():
        found = found | (low.contains(form_word) & _contains_any(low, names - alone))
    return found


def normalised(text: Column) -> Column:
    """Words in lower case, joined by single spaces."""
    spaced = F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")
    return F.trim(spaced)


def word_spans(norm: Column, pattern: Column, rule: Column) -> Column:
    """(first word, word after the last, rule) of the non-overlapping matches of ``pattern`` on whole words."""
    whole = F.concat(F.lit("(?<![^ ])(?:"), pattern, F.lit(")(?![^ ])"))
    found = F.regexp_extract_all(norm, whole, F.lit(0))
    gaps = F.split(norm, whole, -1)
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + spaces(pair["gap"])
        last = begin + spaces(pair["match"])
        span = F.struct(begin.alias("start"), (last + 1).alias("end"), rule.alias("rule"))
        return F.struct(
            F.coalesce(last, begin).alias("at"),
            F.when(pair["match"].isNotNull(), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    paired = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(paired, start, step, lambda acc: acc["out"])


def _standing(spans: Column) -> Column:
    """Spans left after suppression; ``spans`` is ordered by start, then longest, then rule."""
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["end"] <= acc["reach"]
        return F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], s)).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def detected(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """(table, name of its column): every row of ``docs`` with a struct of n_words, base (places of the fixed
    phrases; ``rule`` counts the phrases), spans (standing detections; ``rule`` counts :func:`rules`)."""
    m = free_name(docs, "_license")
    t = text_or_empty(f"`{text}`")
    first = docs.withColumns(
        {f"{m}_n": F.regexp_count(t, F.lit(WORD)).cast("long"), f"{m}_norm": F.when(may_match(F.lower(t)), normalised(t))}
    )
    norm = F.col(f"{m}_norm")
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    forms = sorted({form_word for (_, form_word), *_ in rules()})
    groups: dict[str, list[Column]] = {}
    for k, ((name_word, form_word), expression, _, _) in enumerate(rules()):
        rule = F.struct(F.lit(expression).alias("re"), F.lit(k).alias("rule"), F.lit(forms.index(form_word)).alias("form"))
        groups.setdefault(name_word, []).append(rule)
    first = first.withColumns(
        {
            f"{m}_padded": padded,
            f"{m}_forms": F.when(norm.isNotNull(), F.array(*[padded.contains(w) for w in forms])),
        }
    )
    gated = F.array(*[F.struct(F.lit(w).alias("word"), F.array(*r).alias("rules")) for w, r in groups.items()])
    open_groups = F.filter(gated, lambda g: F.call_function("contains", F.col(f"{m}_padded"), g["word"]))
    open_rules = F.flatten(
        F.transform(open_groups, lambda g: F.filter(g["rules"], lambda r: F.get(F.col(f"{m}_forms"), r["form"])))
    )
    second = first.withColumns(
        {
            f"{m}_rules": F.when(norm.isNotNull(), open_rules),
            f"{m}_base": F.when(
                norm.isNotNull(),
                F.concat(*[word_spans(norm, F.lit(p), F.lit(k)) for k, p in enumerate(PHRASES)]),
            ).otherwise(F.array().cast(SPAN)),
        }
    )
    all_spans = F.flatten(F.transform(f"{m}_rules", lambda r: word_spans(norm, r["re"], r["rule"])))
    ordered = F.transform(
        F.sort_array(
            F.transform(
                all_spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["rule"].alias("rule"))
            )
        ),
        lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["rule"].alias("rule")),
    )
    third = second.withColumn(f"{m}_all", F.when(norm.isNotNull(), ordered).otherwise(F.array().cast(SPAN)))
    return (
        third.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.struct(
                F.col(f"{m}_n").alias("n_words"),
                F.col(f"{m}_base").alias("base"),
                _standing(F.col(f"{m}_all")).alias("spans"),
            ).alias(m),
        ),
        m,
    )


def base_labels(found: Column) -> Column:
    names = F.array(*[F.lit(v) for v in PHRASES.values()])
    return F.transform(found["base"], lambda s: F.get(names, s["rule"]))


def own_labels(found: Column) -> Column:
    names = F.array(*[F.lit(label) for _, _, label, _ in rules()])
    return F.transform(found["spans"], lambda s: F.get(names, s["rule"]))


def joined(labels: Column) -> Column:
    """Distinct, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def confidence(found: Column) -> Column:
    """The highest confidence of a standing detection; 0 without any."""
    sure = F.array(*[F.lit(c) for *_, c in rules()])
    return F.coalesce(F.array_max(F.transform(found["spans"], lambda s: F.get(sure, s["rule"]))), F.lit(0.0))
