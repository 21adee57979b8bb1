import hashlib

import numpy as np
import pytest

from marketrisk.llm import fingerprints as fp
from tests.llm.conftest import make


def test_rolling_entropy_equals_direct(rng=np.random.default_rng(2)):
    data = rng.integers(97, 110, 500).astype(np.uint8)
    data[100:180] = 97
    direct = []
    for k in range(len(data) - fp.WINDOW + 1):
        n = np.unique(data[k : k + fp.WINDOW], return_counts=True)[1]
        total = sum(int(fp._GAINS[:c].sum()) for c in n)
        direct.append(fp._RARITY[total])
        entropy = -(n / fp.WINDOW * np.log2(n / fp.WINDOW)).sum()
        assert abs(np.log2(fp.WINDOW) - total / fp._SCALE / fp.WINDOW - entropy) < 1e-3
    assert (fp.window_rarity(data) == direct).all()


def test_fingerprint_does_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 3, 40, 63, 64, 500, 9000)]
    alone = [fp.written(fp.fingerprints([t])[0]) for t in texts]
    assert [fp.written(p) for p in fp.fingerprints(texts)] == alone
    assert [fp.written(p) for p in fp.fingerprints(texts[::-1])][::-1] == alone


def brute(docs):
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, text) in enumerate(order):
        changed = fp.edited(text, order[(k + 1) % len(order)][1])
        a, b, c = (fp.fingerprints([t.encode()])[0] for t in (text, changed, order[(k + 1) % len(order)][1]))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [1, 2, 300])
def test_matches_brute_force(spark, rows):
    rng = np.random.default_rng(rows)
    texts = ["".join(rng.choice(list("abcdefgh éß日 "), rng.integers(0, 400))) for _ in range(rows)]
    docs = make(spark, texts).repartition(3)
    got = sorted((tuple(r) for r in fp.compared(docs).collect()), key=str)
    assert got == brute([(k, t) for k, t in enumerate(texts)])


def test_odd_rows(odd, nothing):
    rows = fp.compared(odd).collect()
    assert len(rows) == odd.count()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[1] == prints[20] == prints[None] != prints[7]
    assert prints[3] == prints[4] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fp.compared(nothing).count() == 0


def test_likeness():
    rng = np.random.default_rng(8)
    a, b = (bytes(rng.integers(97, 123, 4000).astype(np.uint8)) for _ in range(2))
    same, other, half = (fp.fingerprints([t])[0] for t in (a, b, a[:2000] + b[2000:]))
    assert fp.likeness(same, same) == 1.0
    assert fp.likeness(same, other) < 0.1 < 0.3 < fp.likeness(same, half) < 0.7


def test_shared_and_missing_ids_are_spread_over_blocks(spark):
    """A third of the rows has no id, a third has the same: both are cut along their hashes, and neighbours stay neighbours."""
    texts = [f"text number {k * k} of many" for k in range(600)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 10 * k - 3000, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = fp.in_blocks(docs, 24).groupBy("_block").count().toPandas()["count"]
    assert len(sizes) > 30 and sizes.max() < 60
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    assert sorted((tuple(r) for r in fp.compared(docs).collect()), key=str) == brute(rows)


def test_every_row_without_id(spark):
    docs = spark.createDataFrame([(None, f"{k} is a text") for k in range(50)], "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows = sorted(((None, t) for t in hashes), key=lambda r: hashes[r[1]])
    assert sorted((tuple(r) for r in fp.compared(docs).collect()), key=str) == brute(rows)
