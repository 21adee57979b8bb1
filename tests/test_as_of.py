"""As-of joins and carried values, equal to brute force also when one key or one time holds nearly all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketrisk.functions.ordered import carried_by_bucket
from marketrisk.operators.impute import fill_gaps
from marketrisk.operators.joins import as_of_left
from marketrisk.series import Series

START = datetime.datetime(2021, 3, 1, 9, 30)
DAY = datetime.date(2019, 12, 1)


def brute(left, right):
    out = []
    for row, key, at in left:
        best = [(t, tie, v) for k, t, tie, v in right if k == key and t is not None and at is not None and t <= at]
        out.append((row, max(best, key=lambda b: b[:2])[2] if best else None))
    return sorted(out)


def tables(spark, kind, clock):
    pick = random.Random(5)
    key = lambda: pick.choice(["hot"] * 8 + ["b", None])
    time = lambda: None if pick.random() < 0.03 else clock(pick.choice([7] * 4 + list(range(400))))
    left = [(i, key(), time()) for i in range(1500)]
    right = [(key(), time(), i, None if i % 9 == 0 else i) for i in range(300)]
    return left, right, spark.createDataFrame(left, f"row int, k string, at {kind}"), spark.createDataFrame(right, f"k string, seen {kind}, tie int, v int")


@pytest.mark.parametrize(
    "kind, clock",
    [
        ("timestamp", lambda n: START + datetime.timedelta(seconds=11 * n)),
        ("date", lambda n: DAY + datetime.timedelta(days=3 * n)),
        ("long", lambda n: 1000 * n - 90_000),
    ],
)
def test_as_of_equals_brute_force(spark, kind, clock):
    left, right, rows, events = tables(spark, kind, clock)
    got = as_of_left(rows, events, "at", "seen", ["v"], ["k"], tie_break="tie")
    assert got.columns == ["row", "k", "at", "v"]
    assert sorted((r["row"], r["v"]) for r in got.collect()) == brute(left, right)
    one = as_of_left(rows, events, "at", "seen", ["v"], tie_break="tie").select("row", "v").collect()
    assert sorted(map(tuple, one)) == brute([(i, 0, t) for i, _, t in left], [(0, t, n, v) for _, t, n, v in right])


def test_as_of_without_events_or_rows(spark):
    _, _, rows, events = tables(spark, "date", lambda n: DAY + datetime.timedelta(days=n))
    assert as_of_left(rows, events.limit(0), "at", "seen", ["v"], ["k"]).filter("v is null").count() == 1500
    assert as_of_left(rows.limit(0), events, "at", "seen", ["v"], ["k"]).count() == 0


def test_row_windows_are_cut_by_time(spark):
    """Without keys, the only window over everything is the one over the bucket table."""
    _, _, rows, events = tables(spark, "date", lambda n: DAY + datetime.timedelta(days=n))
    plan = as_of_left(rows, events, "at", "seen", ["v"])._jdf.queryExecution().optimizedPlan()
    windows = [line.split("windowspecdefinition(")[1] for line in plan.toString().splitlines() if "windowspecdefinition(" in line]
    whole = [w for w in windows if w.startswith("_bucket#") and " ASC" in w.split(",")[0]]
    cut = [w for w in windows if w.startswith("_bucket#") and " ASC" not in w.split(",")[0]]
    assert len(whole) == len(cut) == 1 and len(windows) == 2


@pytest.mark.parametrize("backward", [False, True])
def test_carried_values_equal_plain_ones(spark, backward):
    pick = random.Random(3)
    values = [(k, n, None if pick.random() < 0.7 else n) for k in ("a", None) for n in range(500)]
    df = spark.createDataFrame(values, "k string, n int, x int").repartition(5)
    got = carried_by_bucket(df, ["k"], "n", F.floor(F.col("n") / 16), {"y": "x"}, backward)
    for k, n, _, y in got.select("k", "n", "x", "y").collect():
        near = [v for key, m, v in values if key == k and v is not None and (m >= n if backward else m <= n)]
        assert y == (None if not near else min(near) if backward else max(near))


def test_gaps_without_keys(spark):
    days = [(DAY + datetime.timedelta(days=40 * n), None if n % 7 else float(n)) for n in range(-3, 60)]
    df = spark.createDataFrame(days, "session_date date, x double")
    forward = {r[0]: r[1] for r in fill_gaps(df, ["x"], Series()).collect()}
    both = {r[0]: r[1] for r in fill_gaps(df, ["x"], Series(), backward=True).collect()}
    for n in range(-3, 60):
        day = DAY + datetime.timedelta(days=40 * n)
        assert forward[day] == (None if n < 0 else float(n - n % 7)) and both[day] == (0.0 if n < 0 else float(n - n % 7))
