from datetime import datetime, timedelta

import numpy as np
import pytest

from panelmill.operators.spikes import PARTS, WEEKDAYS, block_of, both_sides, flag_implausible, local_scale, run_lengths, stuck_cutoff, tail_cutoff, bin_of, weighted_quantile

T0 = datetime(2025, 3, 1)
SCHEMA = "bar_id long, symbol string, timestamp timestamp_ntz, close double, quote_volume double, trade_count long, volume double, src string, at int, f0 string"


def walk(n=1500, seed=0, symbol="A", first=0):
    rng = np.random.default_rng(seed)
    close = np.exp(np.cumsum(rng.normal(0, 1e-3, n))) * 50
    quote, trades = np.exp(rng.normal(10, 0.3, n)), np.exp(rng.normal(5, 0.3, n)).astype(int) + 1
    return [[first + i, symbol, T0 + timedelta(minutes=5 * i), float(close[i]), float(quote[i]), int(trades[i]), float(quote[i] / close[i]), "c", 1, "c"] for i in range(n)]


def found(spark, rows, **kw):
    return {(r["bar_id"], r["field"]): r["verdict"] for r in flag_implausible(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), **kw).collect()}


def test_planted_faults_and_nothing_else(spark):
    rows = walk()
    rows[100][3] *= 1.05
    rows[101][3] *= 1.05
    rows[300][4] *= 60
    rows[500][5] = 1
    rows[700][3] = float("nan")
    rows[701][4] = float("-inf")
    rows[702][3] = 0.0
    rows[703][5] = -4
    for i in range(901, 915):
        rows[i][3] = rows[900][3]
    for r in rows[1200:]:
        r[3] *= 1.3  # a move that lasts
    for r in rows[1300:1340]:
        r[4], r[5] = r[4] * 8, r[5] * 8  # a busy spell
    want = {(100, "close"): "spike", (101, "close"): "spike", (300, "quote_volume"): "spike", (500, "trade_count"): "spike", (700, "close"): "impossible", (701, "quote_volume"): "impossible", (702, "close"): "impossible", (703, "trade_count"): "impossible"}
    assert found(spark, rows) == want | {(i, "close"): "stuck" for i in range(901, 915)}


def test_pauses_nulls_and_repeated_deliveries(spark):
    rows = walk(800, 2)
    for r in rows[200:260]:  # no trades: close stands still
        r[3], r[4], r[5], r[6] = rows[199][3], 0.0, 0, 0.0
    rows[400][3], rows[401][4], rows[402][5] = None, None, None
    rows[600][3] *= 0.9
    again = [*rows[600]]
    again[0] = 5000
    no_time = [6000, "A", None, float("nan"), 1.0, 1, 1.0, "c", 1, "c"]
    no_source = [7000, None, T0, -1.0, 1.0, 1, 1.0, "c", 1, "c"]
    got = found(spark, [*rows, again, no_time, no_source])
    assert got == {(600, "close"): "spike", (5000, "close"): "spike", (6000, "close"): "impossible", (7000, "close"): "impossible"}


def test_rows_without_a_time_are_judged_one_by_one(spark):
    rows = [[i, s, None, c, 1.0, 1, 1.0, "c", 1, "c"] for i, s, c in ((1, "A", -1.0), (2, "A", 5.0), (3, "B", 5.0), (4, "B", float("nan")), (5, None, 0.0), (6, "A", None))]
    rows[1][4], rows[2][5] = float("inf"), -3
    want = {(1, "close"), (2, "quote_volume"), (3, "trade_count"), (4, "close"), (5, "close")}
    assert found(spark, rows) == {k: "impossible" for k in want}


def test_traded_bars_that_drop_to_nothing(spark):
    rows = walk(900, 11)
    rows[300][4], rows[500][5] = 0.0, 0
    assert found(spark, rows) == {(300, "quote_volume"): "spike", (500, "trade_count"): "spike"}


def test_season_by_time_of_day_and_weekday():
    hour = 3_600_000_000
    monday = int((datetime(2025, 3, 3) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert block_of(np.array([monday, monday + 7 * hour, monday + 6 * 24 * hour + 23 * hour])).tolist() == [0, 1, PARTS * WEEKDAYS - 1]
    rng = np.random.default_rng(6)
    blocks = np.repeat(np.arange(PARTS * WEEKDAYS), 4000)
    loud = np.where(blocks // PARTS >= 5, 3.0, 1.0) * np.where(blocks % PARTS == 2, 2.0, 1.0)
    cut = tail_cutoff(blocks, bin_of(rng.normal(0, 1, len(blocks)) * loud), np.ones(len(blocks)), 5e-6).reshape(WEEKDAYS, PARTS)
    assert 1.6 < cut[0, 2] / cut[0, 1] < 2.4 and 2.2 < cut[6, 1] / cut[0, 1] < 3.4


def test_chunks_hardly_show(spark):
    rows = walk(2500, 3)
    for i in range(50, 2450, 97):
        rows[i][3] *= 1.08
    a, b = found(spark, rows, chunk_days=2), found(spark, rows, chunk_days=365)
    assert a == b and len(a) == 25


def test_short_sources_and_empty_tables(spark):
    assert found(spark, walk(2)) == {}
    assert found(spark, []) == {}
    assert found(spark, [r[:3] + [5.0, 1.0, 1, 1.0] + r[7:] for r in walk(40)]) != {}  # all equal while trades go on


def test_both_sides_ignores_level_shifts_and_trends():
    assert np.abs(both_sides(np.arange(30.0))[2:-2]).max() == 0  # at the ends one side decides alone
    step = np.concatenate([np.zeros(15), np.ones(15)])
    assert np.abs(both_sides(step)).max() == 0
    spike = np.zeros(21)
    spike[10] = -4
    assert both_sides(spike)[10] == -4 and np.abs(np.delete(both_sides(spike), 10)).max() == 0


def test_each_value_has_its_own_scale_window():
    x = np.cumsum(np.random.default_rng(6).normal(0, 1, 403))
    move = np.abs(np.diff(x))
    whole = max(0.5 * np.quantile(move, 0.75), move[move > 0].min())
    around = [np.sort(move[max(i - 30, 0) : i + 30]) for i in range(len(x))]
    want = [max(w[int(np.ceil(0.75 * len(w))) - 1], whole) for w in around]
    assert local_scale(x).tolist() == want


def test_run_lengths():
    length, place = run_lengths(np.array([1.0, 1, 2, 3, 3, 3]))
    assert length.tolist() == [2, 2, 1, 3, 3, 3] and place.tolist() == [0, 1, 0, 0, 1, 2]


def test_cutoffs_follow_the_source():
    rng = np.random.default_rng(5)
    for scale in (1e-4, 1e-2, 1.0):
        r = rng.normal(0, scale, 20_000)
        b, n = np.unique(bin_of(r), return_counts=True)
        cut = tail_cutoff(np.zeros(len(b), int), b, n, 3e-6)
        assert len(cut) == PARTS * WEEKDAYS and 3.5 * scale < cut[0] < 9 * scale
    assert np.isinf(tail_cutoff(np.zeros(1, int), np.array([-1]), np.array([100]), 1e-6)).all()
    assert stuck_cutoff(np.array([1]), np.array([1000]), 1e-3) < 5
    runs = np.arange(1, 12)
    assert stuck_cutoff(runs, np.round(3000 * 0.5**runs) + 0.0, 1e-3) > 14
    assert weighted_quantile(np.array([1.0, 2.0]), np.array([3.0, 1.0]), 0.5) == 1.0
