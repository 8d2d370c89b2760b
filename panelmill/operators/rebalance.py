"""Rebalancing less often: cadences and their phases as selections of cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.costs import break_even, net_mean
from panelmill.operators.portfolio import BPS


def check_cadences(cadences: list[int], holding: int) -> list[int]:
    """Sorted distinct cadences; each must be positive and divide the holding period."""
    for c in cadences:
        if c <= 0 or c > holding or holding % c:
            raise ValueError(f"cadence {c} does not divide the holding period {holding}")
    return sorted(set(cadences))


def _phases(cadences: list[int]):
    pairs = [(c, p) for c in cadences for p in range(c)]
    return F.array(*[F.struct(F.lit(c).alias("cadence_bars"), F.lit(p).alias("phase")) for c, p in pairs])


def phase_map(spark: SparkSession, cadences: list[int], holding: int, interval_minutes: int) -> DataFrame:
    """Every phase of every cadence with the cohorts it holds."""
    rows = [
        (c, c * interval_minutes, p, p * interval_minutes, holding // c, c / holding, ",".join(str(x) for x in range(p, holding, c)))
        for c in check_cadences(cadences, holding)
        for p in range(c)
    ]
    return spark.createDataFrame(
        rows,
        "cadence_bars int, cadence_minutes int, phase int, phase_offset_minutes int, sleeve_count int, capital_fraction_per_sleeve double, selected_cohorts string",
    )


def phase_metrics(cohorts: DataFrame, cadences: list[int], costs: list[float], holding: int, annual: float, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Pooled and equal-weighted results of each phase at each cost; ``cohorts`` are break-even cohorts."""
    checked = check_cadences(cadences, holding)
    rows = cohorts.select("*", F.inline(_phases(checked))).where(F.pmod("cohort", "cadence_bars") == F.col("phase"))
    net = lambda c: F.avg((net_mean(c) > 0).cast("double"))
    gross, turnover, n = F.sum("gross_cumulative_log_return"), F.sum("total_turnover"), F.sum("period_count")
    base = rows.groupBy(*by, "cadence_bars", "phase").agg(
        F.count("*").alias("sleeve_count"),
        n.alias("total_periods"),
        gross.alias("total_gross_log_return"),
        turnover.alias("total_turnover"),
        break_even(gross, turnover).alias("break_even_cost_bps"),
        F.avg("gross_mean_return").alias("equal_weighted_gross_mean_return"),
        F.avg("mean_turnover").alias("equal_weighted_mean_turnover"),
        (turnover / n).alias("pooled_mean_turnover"),
        F.array_join(F.transform(F.sort_array(F.collect_list("cohort")), lambda c: c.cast("string")), ",").alias("selected_cohorts"),
        F.array(*[F.struct(F.lit(float(c)).alias("cost_bps"), net(c).alias("positive_sleeve_fraction")) for c in costs]).alias("__costs"),
    )
    # Net returns are linear in cost: no second aggregation per cost level.
    pooled = (F.col("total_gross_log_return") - F.col("total_turnover") * F.col("cost_bps") / BPS) / F.col("total_periods")
    equal = F.col("equal_weighted_gross_mean_return") - F.col("equal_weighted_mean_turnover") * F.col("cost_bps") / BPS
    return base.select("*", F.inline("__costs")).drop("__costs").select(
        "*",
        pooled.alias("pooled_net_mean_return"),
        equal.alias("equal_weighted_net_mean_return"),
        (pooled * annual).alias("pooled_annualized_net_return"),
        (equal * annual).alias("equal_weighted_annualized_net_return"),
        (F.col("positive_sleeve_fraction") == 1.0).alias("all_sleeves_positive"),
    )


def cadence_summary(phases: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Phases of a cadence together, per cost."""
    be, net = F.col("break_even_cost_bps"), F.col("pooled_annualized_net_return")
    four = lambda c: [("mean", F.avg(c)), ("median", F.percentile(c, 0.5)), ("worst", F.min(c)), ("best", F.max(c))]
    return phases.groupBy(*by, "cadence_bars", "cost_bps").agg(
        F.count("*").alias("phase_count"),
        F.max("sleeve_count").alias("sleeve_count"),
        *[c.alias(f"{n}_phase_break_even_cost_bps") for n, c in four(be)],
        *[c.alias(f"{n}_pooled_annualized_net_return") for n, c in four(net)],
        F.avg((F.col("pooled_net_mean_return") > 0).cast("double")).alias("positive_phase_fraction"),
        F.avg("positive_sleeve_fraction").alias("mean_positive_sleeve_fraction"),
        F.avg("pooled_mean_turnover").alias("mean_pooled_turnover"),
    )
