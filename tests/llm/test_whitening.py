import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketrisk.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, deviation int"


def table(spark, vectors):
    rows = [(k, v, 1, "x", 2) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def exact_covariance(x):
    n = len(x)
    mean = [Fraction(sum(c), n) for c in zip(*x, strict=True)]
    centred = [[v - m for v, m in zip(row, mean, strict=True)] for row in x]
    dims = range(len(mean))
    return [[sum(row[i] * row[j] for row in centred) / n for j in dims] for i in dims]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 5
    found = [list(map(float, v)) for v in base.astype(np.float32)]
    return found + [found[0]] * 200 + [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] * 6, [1.0], [3e38] * 6]


def test_covariances_and_rows_equal_exact_fractions(spark, vectors):
    df = table(spark, vectors)
    model = whitening.fitted(df)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors[:600]]
    exact = exact_covariance(x)
    v = np.array([[float(c) for c in row] for row in exact])
    assert model.n == 600 and model.trace == pytest.approx(np.trace(v), rel=1e-15)
    for k in range(6):
        c = model.components[:, k]
        assert np.linalg.norm(c) == pytest.approx(1, abs=1e-12)
        assert np.allclose(v @ c, model.variances[k] * c, rtol=1e-9, atol=1e-9 * model.variances[0])
    assert list(model.variances) == sorted(model.variances, reverse=True)
    rows = {r["vec_id"]: r for r in whitening.whitened(df, model).collect()}
    assert sorted(rows) == list(range(600))
    sums = [sum(c) for c in zip(*x, strict=True)]
    w = []
    for k in range(600):
        assert int(rows[k]["deviation"]) == sum((600 * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        centred = np.array([float(Fraction(a) - Fraction(s, 600)) for a, s in zip(x[k], sums, strict=True)])
        assert np.allclose(rows[k]["whitened"], centred @ model.components / np.sqrt(model.variances), atol=1e-9)
        w.append(rows[k]["whitened"])
    error = np.abs(np.cov(np.array(w).T, bias=True) - np.eye(6)).max()
    assert error < 1e-6 and model.identity_error == pytest.approx(error, abs=1e-6)


def test_matrix_holds_the_doubles_nearest_to_the_exact_covariances():
    rng = np.random.default_rng(8)
    x = rng.integers(-(10**6), 10**6, (50, 4)).tolist()
    n, sums = 50, [sum(c) for c in zip(*x, strict=True)]
    middle, rest = [s // n for s in sums], [s % n for s in sums]
    squares = []
    for i, j in whitening.pairs(4):
        squares.append(sum((r[i] - middle[i] + (0 if i == j else r[j] - middle[j])) ** 2 for r in x))
    got = whitening.covariance(n, rest, squares)
    assert got.tolist() == [[float(c) for c in row] for row in exact_covariance(x)]


def test_great_entries_stay_exact(spark):
    big = [[1e12, -1e12, 3.0], [2e12, 5.0, -1e12], [0.0, 1.0, 2.0], [1e12, 1e12, 1e12]]
    df = table(spark, big).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    model = whitening.fitted(df)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in big]
    want = np.array([[float(c) for c in row] for row in exact_covariance(x)])
    assert model.trace == pytest.approx(np.trace(want), rel=1e-15)
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in whitening.whitened(df, model).collect():
        assert int(r["deviation"]) == sum((4 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
    assert model.solid().tolist() == [True, True, True]


def test_equal_vectors_and_few_vectors_have_null_directions(spark):
    equal = table(spark, [[1.0, 2.0]] * 5)
    model = whitening.fitted(equal)
    assert model.explained() == [None, None] and model.identity_error == 0
    assert [r["whitened"] for r in whitening.whitened(equal, model).collect()] == [[None, None]] * 5
    two = table(spark, [[1.0, 2.0, 0.0], [2.0, 1.0, 0.0]])
    model = whitening.fitted(two)
    assert model.solid().tolist() == [True, False, False] and model.identity_error < 1e-6
    assert all(r["whitened"][1:] == [None, None] for r in whitening.whitened(two, model).collect())


def test_of_equally_frequent_lengths_the_greater_one_counts(spark):
    df = table(spark, [[1.0], [2.0], [1.0, 2.0], [3.0, 1.0]])
    assert len(whitening.fitted(df).middle) == 2


def test_nothing_remains(spark):
    for vectors in ([], [None, [], [math.nan]]):
        df = table(spark, vectors)
        assert whitening.fitted(df) is None
        assert whitening.whitened(df, None).count() == 0


def test_the_query_gives_one_row_for_each_vector_and_component(spark):
    df = queries.whitened_embeddings(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(rows) == 8 * 500 and {r["component"] for r in rows} == set(range(1, 9))
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-4
    shares = [next(r["explained"] for r in rows if r["component"] == k) for k in range(1, 9)]
    assert shares == sorted(shares, reverse=True) and sum(shares) < 1
    assert all(r["deviation"] == int(r["deviation_exact"]) for r in rows)


def test_the_query_on_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.whitened_embeddings(spark, str(tmp_path)).collect() == []
