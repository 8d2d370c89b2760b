"""Results by period: fold, month, regime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.costs import at_cost, break_even
from panelmill.operators.portfolio import BPS, with_costs


def month(timestamp: str = "timestamp"):
    return F.date_format(timestamp, "yyyy-MM")


def temporal_groups(periods: DataFrame, groups: list[str], costs: list[float], annual: float) -> DataFrame:
    """Per group and cost: totals, break-even, pooled mean and the mean of cohort means.

    Two aggregations, cohort then group; turnover is taken as given, so cutting by month or regime
    does not reset it.
    """
    cohorts = with_costs(periods, costs).groupBy(*groups, "cost_bps", "cohort").agg(
        F.count("*").alias("n"), F.sum("gross_return").alias("g"), F.sum("turnover").alias("t"), F.avg("net_return").alias("m")
    )
    n, g, t, m = F.sum("n"), F.sum("g"), F.sum("t"), F.col("m")
    pooled = (g - t * F.first("cost_bps") / BPS) / n
    return cohorts.groupBy(*groups, "cost_bps").agg(
        n.alias("period_count"),
        F.count("*").alias("cohort_count"),
        g.alias("total_gross_log_return"),
        t.alias("total_turnover"),
        (t / n).alias("mean_turnover"),
        break_even(g, t).alias("break_even_cost_bps"),
        (g / n).alias("pooled_gross_mean_return"),
        pooled.alias("pooled_net_mean_return"),
        F.avg(m).alias("equal_weighted_net_mean_return"),
        (pooled * annual).alias("pooled_annualized_net_return"),
        (F.avg(m) * annual).alias("equal_weighted_annualized_net_return"),
        (F.min(m) * annual).alias("worst_cohort_annualized_net_return"),
        (F.max(m) * annual).alias("best_cohort_annualized_net_return"),
        F.avg((m > 0).cast("double")).alias("positive_cohort_fraction"),
    )


def stability_summary(ic_fold: DataFrame, ic_month: DataFrame, pf_fold: DataFrame, pf_month: DataFrame, focus: float, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Spread of IC, break-even and focus-cost return over folds and over months."""

    def ic(df: DataFrame, kind: str, count: str, share: str) -> DataFrame:
        x = F.col("mean_rank_ic")
        return df.groupBy(*by).agg(
            F.count("*").alias(count), F.avg(x).alias(f"mean_{kind}_rank_ic"), F.stddev_samp(x).alias(f"{kind}_rank_ic_std"),
            F.min(x).alias(f"worst_{kind}_rank_ic"), F.max(x).alias(f"best_{kind}_rank_ic"), F.avg((x > 0).cast("double")).alias(share),
        )

    def be(df: DataFrame, kind: str) -> DataFrame:
        x = F.col("break_even_cost_bps")
        extra = [F.avg((x > 0).cast("double")).alias("positive_month_break_even_fraction")] if kind == "month" else []
        return at_cost(df, 0.0).groupBy(*by).agg(F.avg(x).alias(f"mean_{kind}_break_even_cost_bps"), F.min(x).alias(f"worst_{kind}_break_even_cost_bps"), *extra)

    def net(df: DataFrame, kind: str) -> DataFrame:
        x = F.col("pooled_annualized_net_return")
        return at_cost(df, focus).groupBy(*by).agg(
            F.avg(x).alias(f"mean_{kind}_annualized_net_return_at_focus_cost"),
            F.min(x).alias(f"worst_{kind}_annualized_net_return_at_focus_cost"),
            F.avg((x > 0).cast("double")).alias(f"positive_{kind}_fraction_at_focus_cost"),
        )

    parts = [
        ic(ic_fold, "fold", "fold_count", "positive_fold_fraction"), ic(ic_month, "month", "month_segment_count", "positive_month_rank_ic_fraction"),
        be(pf_fold, "fold"), be(pf_month, "month"), net(pf_fold, "fold"), net(pf_month, "month"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by)
    return out.withColumn("focus_cost_bps", F.lit(focus))
