import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketrisk.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def scored(spark, odd):
    words = "the of and to in is that for it was on are with as his they at be this from".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 80)) + f" rare{k % 40}" for k in range(150)]
    more = spark.createDataFrame([(100 + k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    docs = odd.select("doc_id", "text", F.col("n").alias("n_tokens")).union(more.select("doc_id", "text", "n_tokens"))
    docs = docs.withColumn("held_out", lm.held_out(F.col("doc_id"))).cache()
    model = lm.trained(docs.filter(~F.col("held_out")))
    return docs, model, lm.scored(docs, model).collect()


def test_base_is_exact(scored):
    docs, _, rows = scored
    everything = docs.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert all(r["held_out"] == out(r["doc_id"]) for r in rows) and any(r["held_out"] for r in rows)
    counts = Counter(t for r in everything if not out(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r["doc_id"]), len(tokens(r["text"])), sum(counts[t] > 0 for t in tokens(r["text"])),
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r["text"])), 6)) for r in everything
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["train_tokens"] == n for r in rows)


def test_score_never_falls_far_below_base_and_gains_on_known_text(scored):
    _, _, rows = scored
    floor = math.log10(len(lm.WEIGHTS))
    assert all(r["score"] >= r["base_score"] - floor - 1e-9 for r in rows)
    seen = [r for r in rows if not r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in seen) > 0.99 * sum(r["base_score"] for r in seen)


def test_exchange_equals_broadcast(scored):
    docs, model, rows = scored
    other = lm.scored(docs, model, max_broadcast=0).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
    assert sorted(map(key, other)) == sorted(map(key, rows))


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    counts = rng.zipf(2.0, len(keys))
    bits = lm.build_bits(keys, counts)
    rows = [(0, keys.tobytes(), counts.astype(np.int64).tobytes(), bits.tobytes())]
    known = lm.Segments.of(rows, [(0, len(keys), len(bits))], 1, 0, 1)
    assert (known.word_counts(keys) == counts).all() and not known.word_counts(keys + np.uint64(1)).any()
    found = known.pair_levels(keys)
    assert (found >= lm.levels(counts)).all()
    assert (found > lm.levels(counts)).mean() < 0.01
    strangers = rng.integers(0, 2**63, 50_000, dtype=np.uint64) | np.uint64(2**63)
    assert (known.pair_levels(strangers) > 0).mean() < 0.005


def test_empty(spark, nothing):
    docs = nothing.select("doc_id", "text")
    assert lm.scored(docs, lm.trained(docs)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.scored(one, lm.trained(docs)).first()
    assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["train_tokens"] == 0
