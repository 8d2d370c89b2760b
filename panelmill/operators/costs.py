"""Break-even transaction costs.  Mean net return is linear in cost, so nothing is re-aggregated per cost level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.scalar import label_number
from panelmill.operators.portfolio import BPS


def at_cost(metrics: DataFrame, cost: float) -> DataFrame:
    """Rows of one cost level."""
    return metrics.where(F.abs(F.col("cost_bps") - cost) <= 1e-12)


def cost_grid(start: float, end: float, step: float) -> list[float]:
    """Evenly spaced costs including both ends; the range must be a whole number of steps."""
    if step <= 0 or end < start:
        raise ValueError("cost grid needs a positive step and an end that is not before the start")
    n = round((end - start) / step)
    if abs((end - start) / step - n) > 1e-10:
        raise ValueError("cost range is not a whole number of steps")
    return [start + i * (end - start) / n for i in range(n + 1)] if n else [start]


def break_even(gross: Column, turnover: Column) -> Column:
    return F.try_divide(gross, turnover) * BPS


def break_even_cohorts(metrics: DataFrame, annual: float, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Per cohort, from its zero-cost metrics: the cost at which its cumulated return is nil."""
    total = F.col("mean_turnover") * F.col("period_count")
    return at_cost(metrics, 0.0).select(
        *by,
        "cohort",
        "period_count",
        F.col("mean_net_return").alias("gross_mean_return"),
        "mean_turnover",
        F.col("cumulative_net_log_return").alias("gross_cumulative_log_return"),
        (F.col("mean_net_return") * annual).alias("gross_annualized_return"),
        total.alias("total_turnover"),
        break_even(F.col("cumulative_net_log_return"), total).alias("break_even_cost_bps"),
        (F.col("cumulative_net_log_return") > 0).alias("positive_at_zero_cost"),
    )


def net_mean(cost: Column | float) -> Column:
    return F.col("gross_mean_return") - F.col("mean_turnover") * cost / BPS


def break_even_summary(cohorts: DataFrame, annual: float, costs: list[float], by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Per group: equal-weighted and pooled break-even, its spread over cohorts, share of positive cohorts per cost."""
    gross, turnover, be = F.avg("gross_mean_return"), F.avg("mean_turnover"), F.col("break_even_cost_bps")
    total_gross, total_turnover, periods = F.sum("gross_cumulative_log_return"), F.sum("total_turnover"), F.sum("period_count")
    return cohorts.groupBy(*by).agg(
        F.count("*").alias("cohort_count"),
        periods.alias("total_periods"),
        gross.alias("equal_weighted_gross_mean_return"),
        (gross * annual).alias("equal_weighted_gross_annualized_return"),
        (total_gross / periods).alias("pooled_gross_mean_return"),
        (total_gross / periods * annual).alias("pooled_gross_annualized_return"),
        turnover.alias("equal_weighted_mean_turnover"),
        (total_turnover / periods).alias("pooled_mean_turnover"),
        break_even(gross, turnover).alias("equal_weighted_break_even_cost_bps"),
        break_even(total_gross, total_turnover).alias("pooled_break_even_cost_bps"),
        F.avg(be).alias("mean_individual_break_even_cost_bps"),
        F.percentile(be, 0.5).alias("median_individual_break_even_cost_bps"),
        F.min(be).alias("worst_individual_break_even_cost_bps"),
        F.max(be).alias("best_individual_break_even_cost_bps"),
        *[F.avg((net_mean(c) > 0).cast("double")).alias(f"positive_cohort_fraction_at_{label_number(c)}bps") for c in costs],
    )


def cost_curve(cohorts: DataFrame, costs: list[float], annual: float, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Net return over cohorts along a grid of costs."""
    rows = cohorts.select("*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps")).withColumn("net", net_mean(F.col("cost_bps")))
    net, n = F.col("net"), F.sum("period_count")
    pooled = F.sum(net * F.col("period_count")) / n
    spread = [("mean", F.avg(net)), ("median", F.percentile(net, 0.5)), ("worst", F.min(net)), ("best", F.max(net))]
    return rows.groupBy(*by, "cost_bps").agg(
        F.count("*").alias("cohort_count"),
        n.alias("total_periods"),
        *[c.alias(f"{name}_cohort_net_return") for name, c in spread],
        *[(c * annual).alias(f"{name}_cohort_annualized_net_return") for name, c in spread],
        F.avg((net > 0).cast("double")).alias("positive_cohort_fraction"),
        pooled.alias("pooled_mean_net_return"),
        (pooled * annual).alias("pooled_annualized_net_return"),
        F.sum(net * F.col("period_count")).alias("pooled_cumulative_net_log_return"),
    )


def sensitivity_break_even(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Break-even per group of zero-cost cohort metrics (breadth, horizon, exclusion, variant as columns)."""
    gross, turnover = F.col("mean_net_return"), F.col("mean_turnover")
    own = break_even(gross, turnover)
    return at_cost(metrics, 0.0).groupBy(*by).agg(
        F.count("*").alias("cohort_count"),
        F.sum("period_count").alias("total_periods"),
        break_even(F.avg(gross), F.avg(turnover)).alias("equal_weighted_break_even_cost_bps"),
        break_even(F.sum("cumulative_net_log_return"), F.sum(turnover * F.col("period_count"))).alias("pooled_break_even_cost_bps"),
        F.avg(own).alias("mean_individual_break_even_cost_bps"),
        F.percentile(own, 0.5).alias("median_individual_break_even_cost_bps"),
        F.min(own).alias("worst_individual_break_even_cost_bps"),
        F.max(own).alias("best_individual_break_even_cost_bps"),
        F.avg("annualized_net_return").alias("mean_gross_annualized_return"),
        F.avg("annualized_sharpe").alias("mean_zero_cost_sharpe"),
        F.avg(turnover).alias("mean_turnover"),
        F.avg((gross > 0).cast("double")).alias("positive_cohort_fraction"),
    )


def focus_cost_returns(metrics: DataFrame, focus: float, annual: float, by: list[str]) -> DataFrame:
    """Pooled annualised net return and share of positive cohorts at one cost level."""
    return at_cost(metrics, focus).groupBy(*by).agg(
        (F.sum("cumulative_net_log_return") / F.sum("period_count") * annual).alias("pooled_annualized_net_return_at_focus_cost"),
        F.avg((F.col("mean_net_return") > 0).cast("double")).alias("positive_cohort_fraction_at_focus_cost"),
    )
