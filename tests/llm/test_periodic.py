import binascii
import hashlib
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketrisk.llm import periodic, queries
from tests.llm.conftest import make


def brute(w, least=12):
    """Every stretch that keeps a period, is not extended and has no smaller period."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q):
                part = w[i : i + n]
                if not any(part[d:] == part[: n - d] for d in range(1, q)):
                    found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(found):
    return {k for start, n, q in found for k in range(start + q, start + n)}


def query_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = binascii.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words) if len(words) < 2000 else periodic.runs(periodic.word_numbers(words))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = dropped(found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def check_query(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.periodic_runs(spark, str(tmp_path)).collect()]
    want = [query_row(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_equal_brute_force(w):
    assert periodic.runs(np.array(w, np.int64)) == brute(w)


def test_runs_of_periodic_texts_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(500):
        n = int(rng.integers(20, 160))
        w = rng.integers(0, int(rng.integers(2, 40)), n)
        for _ in range(int(rng.integers(1, 3))):
            a, p = int(rng.integers(0, n - 2)), int(rng.integers(1, 30))
            w[a:] = w[a + np.arange(n - a) % min(p, n - a)]
        assert periodic.runs(w) == brute(w.tolist())


def test_query_on_odd_rows(spark, odd, tmp_path):
    check_query(spark, tmp_path, odd.select("doc_id", "text", "source"))


def test_query_rewrites_a_tenth_of_the_documents(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(0, 120)))) for _ in range(400)]
    want = check_query(spark, tmp_path, make(spark, texts))
    assert 20 < sum(row[1] > 0 for row in want) < 80


def test_collapsed_texts_keep_first_periods(spark):
    block = "a b c d e f g"
    texts = [f"x y {block} {block} {block} z", "la " * 30 + "end", block]
    table, name = periodic.collapsed(make(spark, texts))
    rows = sorted(table.collect(), key=lambda r: r["doc_id"])
    assert [r[name]["text"] for r in rows] == [f"x y {block} z", "la end", block]
    assert [[tuple(x) for x in r[name]["runs"]] for r in rows] == [[(2, 21, 7)], [(0, 30, 1)], []]
    assert [r["text"] for r in rows] == texts and [r[name]["n_words"] for r in rows] == [24, 31, 7]


def test_columns_with_the_name_of_the_result(spark, odd):
    table, name = periodic.collapsed(odd.withColumnRenamed("n", "_periodic"))
    assert name != "_periodic" and table.count() == odd.count()


def test_long_periodic_texts_take_time_in_proportion():
    for numbers in (np.zeros(200_000, np.int64), np.arange(200_000) % 40_000, np.arange(200_000) % 7):
        begin = time.process_time()
        assert len(periodic.runs(numbers)) == 1
        assert time.process_time() - begin < 10


def test_empty_table(nothing):
    assert periodic.collapsed(nothing)[0].count() == 0
