import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators import costs as C
from panelmill.operators import portfolio as P
from panelmill.operators import rebalance as Y
from panelmill.operators import sensitivity as S
from panelmill.operators import xsection as R

MIN = 60_000_000
T0 = datetime(2026, 1, 1)


def panel(spark, hours, scores, returns=(0.01, 0.02, 0.03, 0.04)):
    rows = [("m", T0 + timedelta(hours=h), s, float(p), r) for h, ps in zip(hours, scores) for s, p, r in zip("ABCD", ps, returns)]
    return spark.createDataFrame(rows, "model string, timestamp timestamp_ntz, symbol string, prediction double, execution_return double")


SCORES = [[0, 1, 2, 3], [0, 1, 2, 3], [3, 2, 1, 0]]


def turnover(spark, hours):
    w = P.rank_weights(panel(spark, hours, SCORES), 1, ["model"])
    return [round(r["turnover"], 12) for r in P.portfolio_periods(w, 5 * MIN, 12, ["model"]).orderBy("timestamp").collect()]


def test_weights_are_neutral_with_unit_gross(spark):
    w = P.rank_weights(panel(spark, [0, 1, 2], SCORES), 2, ["model"]).groupBy("timestamp").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"))
    assert [(r["net"], r["gross"]) for r in w.collect()] == [(0.0, 1.0)] * 3


def test_equal_scores_go_by_symbol(spark):
    w = P.rank_weights(panel(spark, [0], [[1, 1, 1, 1]]), 1, ["model"]).orderBy("symbol").collect()
    assert [r["weight"] for r in w] == [-0.5, 0.0, 0.0, 0.5]


def test_too_few_symbols(spark):
    rows = panel(spark, [0], [[1, 2, 3, 4]])
    with pytest.raises(Exception, match="too large: 4 symbols"):
        P.rank_weights(rows, 3, ["model"]).collect()
    assert P.rank_weights(rows, 3, ["model"], short="skip").count() == 0


def test_leaving_a_position_is_paid_for(spark):
    """D is held at 01:00 and gone at 02:00."""
    rows = panel(spark, [0, 1, 2], SCORES).where("not (symbol = 'D' and hour(timestamp) = 2)")
    w = P.rank_weights(rows, 1, ["model"])
    got = [r["turnover"] for r in P.portfolio_periods(w, 5 * MIN, 12, ["model"]).orderBy("timestamp").collect()]
    assert got == [1.0, 0.0, 2.0]  # A from -1/2 to 1/2, C from 0 to -1/2, D from 1/2 to nothing


def test_turnover_contiguous_and_after_a_gap(spark):
    assert turnover(spark, [0, 1, 2]) == [1.0, 0.0, 2.0]
    assert turnover(spark, [0, 1, 3]) == [1.0, 0.0, 1.0]


def test_thirteen_bars_fill_twelve_cohorts(spark):
    df = spark.createDataFrame([(T0 + timedelta(minutes=5 * i),) for i in range(13)], "timestamp timestamp_ntz")
    assert [r[0] for r in df.select(P.cohort(5 * MIN, 12)).collect()] == [*range(12), 0]


def test_breadth_and_exclusion_match_the_plain_portfolio(spark):
    rows = panel(spark, [0, 1, 2], SCORES)
    plain = sorted(map(tuple, P.portfolio_periods(P.rank_weights(rows, 1, ["model"]), 5 * MIN, 12, ["model"]).select("timestamp", "gross_return", "turnover").collect()))
    wide = S.breadth_periods(rows, [1, 2], 5 * MIN, 12)
    assert sorted(map(tuple, wide.where("top_count = 1").select("timestamp", "gross_return", "turnover").collect())) == plain
    without = S.leave_one_out_periods(rows, ["B"], 1, 5 * MIN, 12)
    direct = P.portfolio_periods(P.rank_weights(rows.where("symbol <> 'B'"), 1, ["model"]), 5 * MIN, 12, ["model"])
    shown = lambda d: sorted(tuple(map(str, r)) for r in d.select("cohort", "timestamp", F.round("gross_return", 12), "turnover").collect())
    assert without.count() == 3 and shown(without) == shown(direct)
    assert S.leave_one_out_periods(rows.where("symbol <> 'D'"), rows.select("symbol").distinct(), 2, 5 * MIN, 12).count() == 0


@pytest.mark.parametrize("top", [1, 2, 4])
def test_exclusions_match_plain_portfolios_on_ragged_sections(spark, top):
    rng = random.Random(top)
    rows = [("m", T0 + timedelta(hours=h), s, rng.choice([0.0, 1.0, rng.random()]), rng.random()) for h in range(9) for s in "ABCDEFGHI" if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "model string, timestamp timestamp_ntz, symbol string, prediction double, execution_return double").cache()
    shown = lambda d: sorted(tuple(map(str, r)) for r in d.select("cohort", "timestamp", F.round("gross_return", 9), F.round("turnover", 9)).collect())
    every = S.leave_one_out_periods(df, df.select("symbol").distinct(), top, 60 * MIN, 3).cache()
    for s in "ADI":
        plain = P.portfolio_periods(P.rank_weights(df.where(F.col("symbol") != s), top, ["model"], short="skip"), 60 * MIN, 3, ["model"])
        assert shown(every.where(F.col("excluded_symbol") == s)) == shown(plain)


def test_excluded_rank_ic_matches_ranking_again(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, 0.5, 0.5, rng.random()])
    rows = [(m, T0 + timedelta(hours=h), s, value(), value()) for m in "mn" for h in range(7) for s in "ABCDEFG" if rng.random() < 0.7] + [("m", T0 - timedelta(hours=1), "A", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, timestamp timestamp_ntz, symbol string, prediction double, target double").cache()
    got = S.leave_one_out_summary(df, ["A", "E", "none"]).cache()
    for s in ("A", "E", "none"):
        want = R.summarize_predictions(df.where(F.col("symbol") != s)).orderBy("model")
        mine = got.where(F.col("excluded_symbol") == s).orderBy("model").select(want.columns)
        for a, b in zip(mine.collect(), want.collect()):
            assert a["model"] == b["model"] and [a[c] for c in want.columns[1:]] == pytest.approx([b[c] for c in want.columns[1:]], nan_ok=True)


def test_contributions_add_up(spark):
    w = P.rank_weights(panel(spark, [0, 1, 2], SCORES), 1, ["model"])
    c = S.symbol_contributions(w).collect()
    gross = P.portfolio_periods(w, 5 * MIN, 12, ["model"]).agg(F.sum("gross_return")).first()[0]
    assert sum(r["cumulative_gross_log_return_contribution"] for r in c) == pytest.approx(gross) and sum(r["absolute_contribution_share"] for r in c) == pytest.approx(1)


def metrics(spark):
    rows = [("m", 0.0, 0, 100, 2e-4, 1.0, 0.02, 1.0, 0.5), ("m", 0.0, 1, 200, 1e-4, 0.5, 0.02, 1.0, 0.5), ("m", 5.0, 0, 100, -3e-4, 1.0, -0.03, 1.0, 0.5)]
    return spark.createDataFrame(rows, "model string, cost_bps double, cohort int, period_count bigint, mean_net_return double, mean_turnover double, cumulative_net_log_return double, annualized_sharpe double, annualized_net_return double")


def test_break_even_is_two_basis_points(spark):
    cohorts = C.break_even_cohorts(metrics(spark), 8760)
    assert [r["break_even_cost_bps"] for r in cohorts.collect()] == pytest.approx([2.0, 2.0])
    row = C.break_even_summary(cohorts, 8760, [0.0, 0.5, 5.0]).first()
    assert row["pooled_break_even_cost_bps"] == pytest.approx(2.0) and row["equal_weighted_break_even_cost_bps"] == pytest.approx(2.0)
    assert (row["positive_cohort_fraction_at_0bps"], row["positive_cohort_fraction_at_0p5bps"], row["positive_cohort_fraction_at_5bps"]) == (1.0, 1.0, 0.0)
    curve = {r["cost_bps"]: r["pooled_mean_net_return"] for r in C.cost_curve(cohorts, [0.0, 2.0], 8760).collect()}
    assert curve[2.0] == pytest.approx(0, abs=1e-15) and curve[0.0] > 0


def test_cost_grid():
    assert C.cost_grid(0, 1, 0.25) == [0, 0.25, 0.5, 0.75, 1.0] and C.cost_grid(2, 2, 1) == [2]
    for bad in ((0, 1, 0.3), (0, 1, 0), (1, 0, 0.1)):
        with pytest.raises(ValueError):
            C.cost_grid(*bad)


def test_cadences(spark):
    rows = [("m", c, 100, g, 1.0, g * 100, g, 100.0, g * 1e4) for c, g in enumerate([2e-4, 1e-4, -1e-4, 3e-4])]
    cohorts = spark.createDataFrame(rows, "model string, cohort int, period_count bigint, gross_mean_return double, mean_turnover double, gross_cumulative_log_return double, gross_annualized_return double, total_turnover double, break_even_cost_bps double")
    phases = Y.phase_metrics(cohorts, [1, 2, 4], [0.0, 1.0], 4, 8760)
    assert phases.where("cost_bps = 0").count() == 7 and Y.phase_map(spark, [1, 2, 4], 4, 5).count() == 7
    assert phases.where("cadence_bars = 1").first()["break_even_cost_bps"] == pytest.approx(1.25)
    assert phases.where("cadence_bars = 1").first()["selected_cohorts"] == "0,1,2,3"
    assert Y.cadence_summary(phases).where("cadence_bars = 4 and cost_bps = 0").first()["worst_phase_break_even_cost_bps"] == pytest.approx(-1.0)
    with pytest.raises(ValueError):
        Y.check_cadences([3], 4)


def test_year_must_hold_whole_periods():
    assert [S.annual_periods(5, h) for h in (3, 12, 24)] == [35040, 8760, 4380]
    with pytest.raises(ValueError):
        S.annual_periods(5, 11)
