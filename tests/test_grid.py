from datetime import datetime, timedelta

import numpy as np
import pytest

from panelmill.operators.grid import local_linear, regular_grid

T0 = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "clash", 3) for i, r in enumerate(rows)], "symbol string, timestamp timestamp_ntz, close double, reading_id long, src string, slot int")


def contracts(spark, rows=(("A", 5), ("B", 1), ("Z", None))):
    return spark.createDataFrame(list(rows), "symbol string, interval_minutes int")


def test_local_linear_matches_least_squares():
    rng = np.random.default_rng(0)
    at, grid, reach = np.sort(rng.random(40) * 10), np.linspace(0, 10, 23), 1.7
    y = rng.random(40)
    est, sup = local_linear(grid, at, y, reach)
    for g, e, s in zip(grid, est, sup):
        w = np.clip(0.75 * (1 - ((at - g) / reach) ** 2), 0, None) * (abs(at - g) < reach)
        if (w > 0).sum() >= 2:
            x = np.stack([np.ones_like(at), at - g], 1)
            assert e == pytest.approx(np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * y))[0], abs=1e-8)
        assert s == pytest.approx(w.sum() ** 2 / max((w * w).sum(), 1e-300) if w.sum() else 0)


def test_a_line_is_reproduced_and_gaps_are_marked(spark):
    rows = [("A", T0 + timedelta(minutes=m), 10.0 + m) for m in range(0, 200, 2) if not 60 <= m < 75 and not 100 <= m < 190]
    got = {r["slot"]: r for r in regular_grid(frame(spark, rows), "symbol", "timestamp", "close", contracts(spark)).collect()}
    assert len(got) == 40
    missing = sorted(int((s - T0).total_seconds() // 60) for s, r in got.items() if r["missing"])
    assert missing == [60, 65, 70, *range(100, 190, 5)]
    assert all(r["estimate"] == pytest.approx(10 + (s - T0).total_seconds() / 60, abs=1e-6) for s, r in got.items() if r["estimate"] is not None)
    assert got[T0 + timedelta(minutes=65)]["status"] == "filled" and got[T0 + timedelta(minutes=150)]["status"] == "missing"
    assert got[T0 + timedelta(minutes=150)]["estimate"] is None


def test_chunks_do_not_show(spark):
    rng = np.random.default_rng(1)
    rows = [("B", T0 + timedelta(seconds=float(s)), float(5 + rng.random())) for s in np.sort(rng.random(300) * 20_000)]
    a, b = (sorted(map(tuple, regular_grid(frame(spark, rows), "symbol", "timestamp", "close", contracts(spark), chunk_slots=c).collect())) for c in (16, 4096))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and x[6] == y[6] and (x[4] == y[4] or x[4] == pytest.approx(y[4], rel=1e-9))


def test_unusable_and_repeated_readings(spark):
    t = lambda m: T0 + timedelta(minutes=m)
    rows = [("A", t(0), 1.0), ("A", t(5), None), ("A", t(10), float("nan")), ("A", t(15), 0.0), ("A", t(20), -1.0), ("A", t(25), float("inf")), ("A", t(30), 2.0), ("A", t(30), 3.0), ("A", None, 1.0), (None, t(0), 4.0), ("new", t(7), 1.0)]
    got = regular_grid(frame(spark, rows), "symbol", "timestamp", "close", contracts(spark, [("A", 5), ("A", 15)])).collect()
    a = {r["slot"]: r for r in got if r["symbol"] == "A"}
    assert len(a) == 7 and sum(r["missing"] for r in a.values()) == 5 and a[t(30)]["readings"] == 1
    assert [r["slot"] for r in got if r["symbol"] is None] == [t(0)] and [r["slot"] for r in got if r["symbol"] == "new"] == [t(5)]


def test_before_1970_and_empty(spark):
    old = datetime(1969, 12, 31, 23, 58)
    got = regular_grid(frame(spark, [("A", old, 1.0), ("A", old + timedelta(minutes=12), 1.0)]), "symbol", "timestamp", "close", contracts(spark)).collect()
    assert sorted(r["slot"] for r in got) == [datetime(1969, 12, 31, 23, 55), datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 5), datetime(1970, 1, 1, 0, 10)]
    assert regular_grid(frame(spark, []), "symbol", "timestamp", "close", contracts(spark)).count() == 0
    assert regular_grid(frame(spark, [("A", old, 1.0)]), "symbol", "timestamp", "close").count() == 1
