import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.operators.rolling import EMPTY, TwoStackQueue, combine, rolling_totals, trailing_rows

SCHEMA = "symbol string, timestamp timestamp_ntz, x double, y double, row_id bigint, e string, v0 string, t int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    return rolling_totals(df, "symbol", "timestamp", ["x", "y"], sequence="row_id", **kw)


@given(st.lists(st.tuples(st.integers(0, 5), st.floats(-5, 5)), max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_queue_matches_brute_force(steps, width):
    q, held, at = TwoStackQueue((EMPTY,), combine), [], 0
    for gap, x in steps:
        at += gap
        q.evict_through(at - width)
        q.push(at, ((x, 1, x, x),))
        held = [(k, v) for k, v in held if k > at - width] + [(at, x)]
        (s, n, lo, hi), = q.total()
        values = [v for _, v in held]
        assert n == len(values) and lo == min(values) and hi == max(values) and s == pytest.approx(sum(values), abs=1e-9)


def test_order_matters_for_the_combine():
    q = TwoStackQueue("", lambda a, b: a + b)
    for i, c in enumerate("abcdef"):
        q.push(i, c)
        q.evict_through(i - 3)
    assert q.total() == "def"


def test_idle_days_are_emitted():
    rows = list(trailing_rows(iter([(1, ((1.0, 1, 1.0, 1.0),)), (4, ((2.0, 1, 2.0, 2.0),))]), [2], 1))
    assert [(d, a, t[0][0][:2]) for d, a, t in rows] == [(1, True, (1.0, 1)), (2, False, (1.0, 1)), (3, False, (0.0, 0)), (4, True, (2.0, 1))]


def test_brute_force(spark):
    rng, rows = random.Random(3), []
    base = datetime(2025, 1, 1)
    for i in range(400):
        x = rng.choice([None, float("nan"), float("inf"), rng.random(), -rng.random()])
        rows.append((rng.choice(["A", "B", None]), base + timedelta(days=rng.randint(0, 60), minutes=rng.randint(0, 3)), x, rng.choice([None, rng.random()]), i))
    got = {(r["symbol"], r["day"]): r for r in run(spark, rows, periods=[7, 30]).collect()}
    finite = lambda v: v is not None and v == v and abs(v) != float("inf")
    once = {}
    for s, t, x, y, i in sorted(rows, key=lambda r: r[4]):
        for k, v in ((0, x), (1, y)):
            if finite(v):
                once[s, t, k] = v
    for s in {"A", "B", None}:
        days = sorted({t.date() for (u, t, _) in once if u == s})
        span = [days[0] + timedelta(days=i) for i in range((days[-1] - days[0]).days + 1)]
        assert sorted(d for u, d in got if u == s) == span
        for d in span:
            r = got[s, d]
            assert r["active"] == (d in days)
            for p in (7, 30):
                vs = [v for (u, t, k), v in once.items() if u == s and k == 0 and d - timedelta(days=p) < t.date() <= d]
                assert r[f"x_count_{p}d"] == len(vs) and r[f"x_sum_{p}d"] == pytest.approx(sum(vs), abs=1e-9)
                assert r[f"x_max_{p}d"] == (max(vs) if vs else None)


def test_null_timestamps_and_empty_tables(spark):
    assert run(spark, [("A", None, 1.0, 1.0, 1)]).count() == 0
    assert run(spark, []).count() == 0
    assert run(spark, [("A", datetime(2025, 1, 1), None, None, 1)]).count() == 0
