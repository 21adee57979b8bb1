from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketrisk.llm import mixing
from tests.llm.conftest import make


def water_fill(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in order if s not in stopped)
        got = {s: limit * sizes[s] if s in stopped else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in stopped and got[s] > limit * sizes[s]}
        if not over:
            return got
        stopped |= over


def test_targets_and_totals(spark):
    texts = [" ".join(["w"] * (5 + k % 90)) for k in range(600)]
    names = [["a", "b", "c", "d", None][k % 5 if k % 7 else 0] for k in range(600)]
    table, m = mixing.planned(make(spark, texts, source=names))
    rows = table.select("source", F.col(m)["size"], F.col(m)["source_size"], F.col(m)["target"], F.col(m)["copies"]).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for source, size, whole, aim, copies in rows:
        sizes[source] += size
        taken[source] += size * copies
        target[source] = aim
        assert 0 <= copies <= 2
    assert {r[0]: r[2] for r in rows} == dict(sizes)
    want = water_fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.05)
    assert mixing.mixed(make(spark, texts, source=names)).count() == sum(r[4] for r in rows)


def test_odd_rows_rerun_alike(odd):
    first, second = (mixing.planned(odd) for _ in range(2))
    one, two = (sorted(t.select("doc_id", F.col(m)["size"], F.col(m)["copies"]).collect(), key=str) for t, m in (first, second))
    assert one == two and len(one) == odd.count()
    assert mixing.mixed(odd).columns == odd.columns


def test_empty_and_wordless(spark, nothing):
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(make(spark, [None, "", " "])).count() == 0


def test_rows_alike_share_the_fraction(spark):
    """Sources of nothing but copies without ids, and of one id with many texts, come near their targets too."""
    texts = ["same words here again"] * 1000 + [f"w {k} x" for k in range(1000)] + ["a b c"] * 997 + [None] * 40
    names = ["one"] * 1000 + ["two"] * 1000 + [None] * 997 + ["one"] * 40
    docs = make(spark, texts, source=names).withColumn("doc_id", F.when(F.col("source") == "two", F.lit(7)))
    table, m = mixing.planned(docs.repartition(9))
    rows = table.select("source", F.col(m)["size"], F.col(m)["target"], F.col(m)["copies"]).collect()
    assert len(rows) == len(texts)
    taken, target = defaultdict(int), {}
    for source, size, aim, copies in rows:
        taken[source] += size * copies
        target[source] = aim
        assert 0 <= copies <= 2
    assert all(abs(taken[s] - target[s]) <= (4 if s != "two" else 0.01 * target[s]) for s in target)
    again, n = mixing.planned(docs.repartition(3))
    assert sorted(map(str, rows)) == sorted(
        map(str, again.select("source", F.col(n)["size"].alias(f"{m}.size"), F.col(n)["target"].alias(f"{m}.target"), F.col(n)["copies"].alias(f"{m}.copies")).collect())
    )
