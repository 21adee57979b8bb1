import re

from pyspark.sql import functions as F

from marketrisk.llm import licenses
from tests.llm.conftest import make

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(want)] == want]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. mit-license; MIT\nLICENSE mit licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License v2.1 and x General  Public -- License general public license",
    "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: BSD-3-Clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "ÉMIT License mit licenseé \x7fmit\x7flicense\x7f MİT LICENSE",
    "nothing about it",
] + ["MIT License apache license " * 300]


def found(docs):
    table, m = licenses.detected(docs)
    f = F.col(m)
    base = licenses.base_labels(f)
    return table.select(
        "text", f["n_words"], F.size(f["base"]), F.array_min(F.transform(f["base"], lambda s: s["start"])),
        F.array_max(F.transform(f["base"], lambda s: s["start"])), licenses.joined(base),
        licenses.joined(F.concat(base, licenses.own_labels(f))).alias("labels"), licenses.confidence(f).alias("score"),
    ).collect()


def test_base_matches_brute_force(spark, odd):
    for text, *got, _labels, score in found(odd.unionByName(make(spark, TEXTS))):
        assert tuple(got) == brute(text), text
        assert 0 <= score <= 1


def test_own_labels(spark):
    labels = {r["text"]: r["labels"] for r in found(make(spark, TEXTS))}
    assert labels[TEXTS[0]] == "mit"
    assert labels[TEXTS[1]] == "apache,apache-2.0,mit"
    assert labels[TEXTS[2]] == "gpl,gpl-3.0"
    assert labels[TEXTS[3]] == "gpl,lgpl-2.1"
    assert labels[TEXTS[4]] == "bsd-3-clause,cc-by-nc"
    assert labels[TEXTS[5]] == "mit"
    assert labels[TEXTS[7]] == ""


def test_hundreds_of_rules_compile():
    rules = licenses.rules()
    assert len(rules) > 250
    for _, expression, _, sure in rules:
        re.compile(expression)
        assert 0 < sure <= 1


def test_contained_detections_are_suppressed(spark):
    table, m = licenses.detected(make(spark, [TEXTS[2]]))
    spans = table.select(F.col(m)["spans"].alias("s")).first()["s"]
    assert len(spans) == 1


def test_empty_table(nothing):
    assert licenses.detected(nothing)[0].count() == 0


def ungated(text):
    """Labels of the detections that stand when every rule runs on every text."""
    norm = " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))
    spans = []
    for k, (_, expression, _, _) in enumerate(licenses.rules()):
        for match in re.finditer(f"(?<![^ ])(?:{expression})(?![^ ])", norm):
            start = norm[: match.start()].count(" ")
            spans.append((start, -(start + match[0].count(" ") + 1), k))
    standing, reach = set(), -1
    for _, end, k in sorted(spans):
        if -end > reach:
            standing.add(licenses.rules()[k][2])
        reach = max(reach, -end)
    return standing


def test_gates_lose_nothing(spark):
    ends = lambda expression: {f(sorted(licenses.variants(expression)), key=len) for f in (min, max)}
    texts = {body for _, expression, _ in licenses.BODIES for body in ends(expression)}
    for form, _ in licenses.FORMS:
        for _, name, short in licenses.LICENSES:
            for k, filled in enumerate(sorted(ends(form.format(name="\0", short="\0", full="\0")))):
                texts |= {filled.replace("\0", (short or name).split("(")[0].strip() if "{short}" in form else v) for v in ends(name)}
    texts = sorted(texts)
    shown = [t.replace(" ", ("\n# ", "  ", "-", "\n * ")[k % 4]).upper() if k % 2 else t for k, t in enumerate(texts)]
    table, m = licenses.detected(make(spark, shown))
    got = {r["text"]: set(r["own"]) for r in table.select("text", licenses.own_labels(F.col(m)).alias("own")).collect()}
    assert len(texts) > 500
    for text in shown:
        assert got[text] == ungated(text), text


def test_names_without_the_word_license(spark):
    cases = {
        "Released under the MIT.": "mit",
        "distributed under the terms of the GNU GPL v2": "gpl-2.0",
        "available under the LGPLv3": "lgpl-3.0",
        "published under the GNU Library General Public License": "gpl,lgpl",
        "Permission to use, copy, modify, and/or distribute this\n# software for any purpose": "isc",
        "Redistributions in source and\n * binary forms, with or without modification": "bsd",
        "All  rights\n// reserved": "proprietary",
        "you may not use this file except in compliance with the License": "apache-2.0",
        "released under the PSF": "python",
        "an artistic commit under the permit": "",
    }
    labels = {r["text"]: r["labels"] for r in found(make(spark, list(cases)))}
    assert labels == cases
