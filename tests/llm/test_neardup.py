import random
from collections import defaultdict

import numpy as np
import pytest

from marketrisk.llm import neardup
from marketrisk.llm.components import components
from tests.llm.conftest import BASE, make


def sets_of(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(texts, size):
    sets = sets_of(texts, size)
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 2, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 12, 40])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    # a chain: each version is near to the next only
    words = [f"c{k}" for k in range(100)]
    for k in range(12):
        words = [*words[4:], *[f"d{k}_{j}" for j in range(4)]]
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_groups_match_brute_force(spark, seed, size):
    texts = near_copies(seed)
    rows = neardup.grouped(make(spark, texts).repartition(5), size).select("row.doc_id", "n_shingles", "component_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == brute(texts, size)


def test_odd_rows(odd, nothing):
    rows = neardup.grouped(odd, 2).select("row.doc_id", "text", "n_shingles", "component_id", "_uid", "keeper").collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["text"] and r["text"].startswith(BASE):
            assert r["component_id"] == 0
        if not (r["text"] or "").strip():
            assert r["n_shingles"] == 0 and r["keeper"] == r["_uid"] and r["component_id"] == r["doc_id"]
    kept = neardup.deduplicated(odd, 2)
    assert kept.columns == odd.columns
    assert sum(r["text"] == BASE for r in kept.collect()) == 1
    assert neardup.deduplicated(nothing).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    owners = np.repeat([0, 1], 1000)
    _, _, packed, bands = neardup.signatures(np.concatenate([a, b]), owners, 2)
    x = packed[: neardup.MINIMA * neardup.BITS // 64, 0] ^ packed[: neardup.MINIMA * neardup.BITS // 64, 1]
    flips = packed[neardup.MINIMA * neardup.BITS // 64 :]
    apart = sum(bin(int(v)).count("1") for v in flips[:, 0] ^ flips[:, 1])
    assert 150 < apart <= 200  # never above the 200 shingles that are in one set only
    either = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    differing = sum(bin(int(v)).count("1") for v in either)
    estimate = (1 - differing / neardup.MINIMA - 0.25) / 0.75
    assert abs(estimate - 900 / 1100) < 0.15
    assert (bands[0] == bands[1]).any()


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1003, 1001)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(labels[k] == 0 for k in range(201)) and labels[1003] == labels[1000] == labels[1001] == 1000
    groups = defaultdict(set)
    for node, label in labels.items():
        groups[label].add(node)
    assert sorted(map(len, groups.values())) == [3, 201]
