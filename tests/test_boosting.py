import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marketrisk.functions.concurrent import concurrently
from marketrisk.heads import boosting as bo
from marketrisk.heads import expanding as ex
from marketrisk.heads.quantiles import level_name

LEVELS = (0.1, 0.5, 0.9)


def frame(spark, x, y, **columns):
    names = list(columns)
    rows = [(k, list(map(float, v)), float(t), *[c[k] for c in columns.values()]) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    kinds = "".join(f", {n} {'boolean' if isinstance(columns[n][0], bool) else 'double'}" for n in names)
    df = spark.createDataFrame(rows, f"row int, x array<double>, label double{kinds}").repartition(3)
    return df.withColumn("features", array_to_vector("x"))


def best_cut(x, rows, g, h, edges, settings):
    """Greatest gain over all features and edges, by adding up the raw rows of each side."""
    def part(some):
        return (g[some].sum()) ** 2 / (h[some].sum() + settings.ridge)

    best = (1e-9, None)
    for f, cuts in enumerate(edges):
        for edge in cuts:
            left = rows & (x[:, f] <= edge)
            right = rows & ~left
            if left.sum() >= settings.least and right.sum() >= settings.least:
                gain = part(left) + part(right) - part(rows)
                if gain > best[0] + 1e-7:
                    best = (gain, (f, edge))
    return best[1]


def brute(x, y, w, loss, start, edges, settings):
    """Margins after all rounds, one row and node at a time; no bins, no heap of nodes, no whole numbers."""
    margins = np.tile(np.array(start), (len(x), 1))
    for _ in range(settings.rounds):
        g, h = loss.gradients(y, margins)
        g, h = g * w[:, None], h * w[:, None]
        step = np.zeros_like(margins)
        for k in range(len(start)):
            open_nodes = [(np.ones(len(x), bool), settings.depth)]
            while open_nodes:
                rows, left_over = open_nodes.pop()
                cut = best_cut(x, rows, g[:, k], h[:, k], edges, settings) if left_over else None
                if cut:
                    below = rows & (x[:, cut[0]] <= cut[1])
                    open_nodes += [(below, left_over - 1), (rows & ~below, left_over - 1)]
                elif loss.levels:
                    step[rows, k] = np.quantile(y[rows] - margins[rows, k], loss.levels[k])
                else:
                    step[rows, k] = -g[rows, k].sum() / (h[rows, k].sum() + settings.ridge)
        margins = margins + settings.rate * step
    return margins


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 3)).round(2)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) > 0).astype(int) + (x[:, 1] > 0.7)
    return x, y.astype(float), x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(size=200) * 0.3, rng.uniform(0.5, 2, 200)


def test_softmax_trees_equal_brute_force(spark, data):
    x, y, _, w = data
    settings = bo.Settings(rounds=4, depth=3, rate=0.3, bins=16, least=5, ridge=0.1)
    head = bo.softmax_boosting(frame(spark, x, y, weight=[float(v) for v in w]), settings)
    model = head.parts[0]
    want = brute(x, y, w, bo.softmax_loss(3), model.start, model.edges, settings)
    assert np.allclose(model.margins(x), want, atol=1e-4)
    scored = head.score(frame(spark, x, y)).orderBy("row").collect()
    assert np.allclose([[r[f"p_{k}"] for k in range(3)] for r in scored], bo.shares(want), atol=1e-4)
    loss = bo.softmax_loss(3).of_rows(y, want)
    assert model.losses[-1][0] == pytest.approx(np.average(loss, weights=w), abs=1e-4)
    assert [a[0] > b[0] for a, b in zip(model.losses, model.losses[1:], strict=False)] == [True] * 4
    assert sum(head.importances) == pytest.approx(1)


def test_pinball_trees_equal_brute_force(spark, data):
    x, _, y, _ = data
    settings = bo.Settings(rounds=3, depth=2, rate=0.5, bins=16, least=10, ridge=1e-12)
    df = frame(spark, x, y)
    predict, model = bo.boosted_quantiles(df, "label", LEVELS, settings)
    assert model.start == pytest.approx(np.quantile(y, LEVELS))
    want = brute(x, y, np.ones(200), bo.pinball_loss(LEVELS), model.start, model.edges, settings)
    got = predict(df).orderBy("row").collect()
    assert np.allclose([[r[level_name(q)] for q in LEVELS] for r in got], want, atol=1e-9)


def test_margins_rewritten_in_between_change_nothing(spark, data, monkeypatch):
    x, y, _, _ = data
    settings = bo.Settings(rounds=5, depth=2, rate=0.3, least=5)
    df = frame(spark, x, y)
    whole = bo.softmax_boosting(df, settings).parts[0].margins(x)
    monkeypatch.setattr(bo, "REWRITE", 2)
    assert np.allclose(bo.softmax_boosting(df.repartition(7), settings).parts[0].margins(x), whole, atol=1e-12)


def test_held_out_rows_stop_the_rounds_and_are_not_learned(spark, data):
    x, y, _, _ = data
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 3, 200).astype(float)
    held = [bool(k % 4 == 0) for k in range(200)]
    settings = bo.Settings(rounds=40, depth=4, rate=0.5, least=2, patience=3)
    model = bo.softmax_boosting(frame(spark, x, noise, held_out=held), settings, "held_out").parts[0]
    losses = [loss for _, loss in model.losses]
    assert len(model.trees) == int(np.argmin(losses)) and len(losses) < 12
    first = bo.softmax_boosting(frame(spark, x[[not h for h in held]], noise[[not h for h in held]]), settings).parts[0]
    assert np.allclose(first.start, model.start)


def test_node_table_gives_the_margins(spark, data):
    x, y, _, _ = data
    model = bo.softmax_boosting(frame(spark, x, y), bo.Settings(rounds=2, depth=2, rate=0.3, least=5)).parts[0]
    nodes = {(r["round"], r["output"], r["node"]): r for r in model.nodes(spark).collect()}
    for row, want in zip(x[:20], model.margins(x[:20]), strict=True):
        for k in range(3):
            total = model.start[k]
            for r in range(2):
                at = nodes[r, k, 1]
                while at["feature"] is not None:
                    at = nodes[r, k, 2 * at["node"] + (row[at["feature"]] > at["threshold"])]
                total += at["value"]
            assert total == pytest.approx(want[k], abs=1e-12)


def test_one_class_and_constant_features(spark):
    df = frame(spark, np.ones((30, 2)), np.zeros(30))
    head = bo.softmax_boosting(df, bo.Settings(rounds=2, depth=2))
    row = head.score(df).first()
    assert row["p_0"] > 0.999 and sum(head.importances) == 0


def test_refits_equal_a_fit_of_all_dates_before(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", "b"):
        for day in range(90):
            for _ in range(0 if key == "b" and day < 45 else int(rng.integers(1, 4))):
                a, b = rng.normal(size=2) * [1, 1000] + [5, 1e6]
                rows.append((key, day, float(a), float(b), float(3 * a - 0.002 * b + rng.normal())))
    df = spark.createDataFrame(rows, "key string, day int, a double, b double, y double").repartition(4)
    got = ex.expanding_coefficients(df, "y", ["a", "b"], 30, 20, "day", ["key"]).collect()
    assert sorted((r["key"], r["refit_at"]) for r in got) == [("a", 30), ("a", 40), ("a", 60), ("a", 80), ("b", 60), ("b", 80)]
    for r in got:
        known = np.array([v[2:] for v in rows if v[0] == r["key"] and v[1] < r["refit_at"]])
        assert r["trained_on"] == len(known)
        want = np.linalg.lstsq(np.c_[np.ones(len(known)), known[:, :2] - known[:, :2].mean(0)], known[:, 2], rcond=None)[0]
        assert r["coefficients"] == pytest.approx(want[1:], rel=1e-6)
        assert r["intercept"] == pytest.approx(want[0] - want[1:] @ known[:, :2].mean(0), rel=1e-5)
    scored = ex.expanding_forecasts(df, "y", ["a", "b"], 30, 20, "day", ["key"]).collect()
    by = {(r["key"], r["refit_at"]): r for r in got}
    assert len(scored) == sum(v[1] >= (60 if v[0] == "b" else 30) for v in rows)
    for r in scored:
        fit = by[r["key"], max(30, r["day"] // 20 * 20)]
        assert r["hat"] == pytest.approx(fit["intercept"] + np.dot(fit["coefficients"], [r["a"], r["b"]]))


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 5, 0.1, 1, 1, 0]
    y = x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=300)
    xc, yc = x - x.mean(0), y - y.mean()
    b = ex.solved(xc.T @ xc / 300, xc.T @ yc / 300, 0.1, 0.7)
    spread = xc.std(0)
    slope = xc.T @ (yc - xc @ b) / 300
    for j in range(5):
        beta, s = b[j] * spread[j], slope[j] / spread[j]
        assert abs(s - 0.03 * beta - 0.07 * np.sign(beta)) < 1e-9 if beta else abs(s) <= 0.07 + 1e-9
    assert b[5] == 0


def test_tasks_run_side_by_side_and_keep_their_order(spark):
    meet = threading.Barrier(3, timeout=20)

    def task(k):
        meet.wait()
        return spark.range(k).agg(F.count("*")).first()[0]

    assert concurrently(spark, [lambda k=k: task(k) for k in (3, 1, 2)]) == [3, 1, 2]


def test_a_failing_task_is_raised(spark):
    def fails():
        time.sleep(0.1)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        concurrently(spark, [lambda: 1, fails])
