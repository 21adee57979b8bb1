import re
from collections import Counter

from pyspark.sql import functions as F

from marketrisk.llm import quality
from tests.llm.conftest import make, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def measures(table, m):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return table.select("doc_id", "text", *[F.col(m)[c] for c in names], F.col(m)["base_failed"], F.col(m)["kept"]).collect()


def test_measures_match_brute_force_on_odd_rows(spark, odd):
    repeated = "a b c d e f " * 7 + "\nline\nline\n\nline x\n a b c d e"
    docs = odd.unionByName(make(spark, [repeated, "x y z q r s t x y z q r u v w", "a\x1fb a b"]))
    rows = measures(*quality.judged(docs))
    assert len(rows) == len(odd_rows()) + 3
    for _, text, *found, base_failed, _ in rows:
        want = brute(text)
        assert tuple(found) == want
        assert base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(300)]
    texts = ["short"] * 40 + good[:10] + good[10:200] + ["tiny"] + good[200:]
    hosts = ["bad"] * 50 + ["fine"] * 190 + ["single"] + ["fine"] * 100
    table, m = quality.judged(make(spark, texts, source=hosts))
    verdicts = {r["host"]: r for r in quality.host_verdicts(table, "source", m).collect()}
    assert verdicts["bad"]["rejected"] and not verdicts["fine"]["rejected"]
    assert 0.05 < verdicts["single"]["rate"] < 1.0
    kept = table.filter(F.col(m)["kept"]).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"fine": 290}


def test_filtered_keeps_columns_and_empty_table(odd, nothing):
    assert quality.filtered(odd).columns == odd.columns
    assert quality.filtered(nothing).count() == 0
    assert quality.filtered(nothing).columns == nothing.columns
