"""Dollar-neutral rank portfolios, gap-aware turnover, transaction costs and their summaries.

Frames stay long.  Dimensions (model, breadth, horizon, excluded symbol, ...) are columns named in
``by`` and ride in the partition keys, so one job evaluates all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalar import epoch_micros, floor_div

BPS = 10_000.0


def cohort(interval: int, holding: int, timestamp: str = "timestamp") -> Column:
    """Which of the ``holding`` staggered sleeves a bar belongs to."""
    return F.pmod(floor_div(epoch_micros(F.col(timestamp)), interval), F.lit(holding)).cast("int")


def rank_weights(df: DataFrame, top: Column | int, by: list[str] = [], short: str = "raise") -> DataFrame:  # noqa: B006
    """``weight``: -0.5/k for the k lowest predictions of a timestamp, +0.5/k for the k highest, else 0.

    Equal predictions are ordered by symbol.  A cross-section of under 2k symbols raises when it is
    reached, or is left out with ``short="skip"``.
    """
    k = F.lit(top) if isinstance(top, int) else top
    keys = [*by, "timestamp"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("prediction", "symbol"))
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.select("*", place.alias("__place"), n.alias("__n"))
    weight = F.when(F.col("__place") <= k, -0.5).when(F.col("__place") > F.col("__n") - k, 0.5).otherwise(0.0) / k
    if short == "skip":
        return ranked.where(F.col("__n") >= 2 * k).withColumn("weight", weight).drop("__place", "__n")
    problem = F.raise_error(F.format_string("top count is too large: %s symbols at %s", F.col("__n"), F.col("timestamp").cast("string"))).cast("double")
    return ranked.withColumn("weight", F.when(F.col("__n") >= 2 * k, weight).otherwise(problem)).drop("__place", "__n")


def weight_change(held: Column, before: Column) -> Column:
    """Sum of absolute changes between two arrays of (symbol, weight); a symbol that is not there weighs nothing."""
    old, new = F.map_from_entries(before), F.map_from_entries(held)
    kept = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.abs(x["weight"] - F.coalesce(F.try_element_at(old, x["symbol"]), F.lit(0.0))))
    gone = F.aggregate(F.filter(before, lambda x: ~F.map_contains_key(new, x["symbol"])), F.lit(0.0), lambda a, x: a + F.abs(x["weight"]))
    return kept + gone


def held_periods(books: DataFrame, interval: int, holding: int, by: list[str]) -> DataFrame:
    """``gross_return`` and ``turnover`` from one row per period with its ``held`` array of (symbol, weight) and ``gross_return``."""
    us = epoch_micros(F.col("timestamp"))
    rows = books.withColumn("cohort", cohort(interval, holding))
    w = Window.partitionBy(*by, "cohort").orderBy("timestamp")
    follows = F.coalesce(us - F.lag(us).over(w) == holding * interval, F.lit(False))
    before = F.when(follows, F.lag("held").over(w))
    none = F.array().cast(books.schema["held"].dataType)
    placed = rows.select(*by, "cohort", "timestamp", "gross_return", "held", F.coalesce(before, none).alias("__before"))
    return placed.select(*by, "cohort", "timestamp", "gross_return", weight_change(F.col("held"), F.col("__before")).alias("turnover"))


def portfolio_periods(weighted: DataFrame, interval: int, holding: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``gross_return`` and ``turnover`` per cohort and timestamp.

    A cohort's turnover is the sum of absolute weight changes since its previous period, exits of symbols
    that have left the cross-section included; after a gap (or at its start) it enters from cash and pays
    for its whole weights.  A period shrinks to one row with the weights it holds before neighbouring
    periods meet.
    """
    w = F.col("weight")
    books = weighted.groupBy(*by, "timestamp").agg(
        F.sum(w * F.col("execution_return")).alias("gross_return"), F.collect_list(F.when(w != 0, F.struct("symbol", "weight"))).alias("held")
    )
    return held_periods(books, interval, holding, by)


def with_costs(periods: DataFrame, costs: list[float]) -> DataFrame:
    """Each period once per cost level, with ``cost`` and ``net_return``."""
    rows = periods.select("*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps"))
    return rows.withColumn("cost", F.col("turnover") * F.col("cost_bps") / BPS).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def cohort_metrics(periods: DataFrame, costs: list[float], annual: float, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Return, volatility, Sharpe ratio, turnover and cumulated log return per cost level and cohort."""
    net = F.col("net_return")
    spread = F.stddev_samp(net)
    return with_costs(periods, costs).groupBy(*by, "cost_bps", "cohort").agg(
        F.count("*").alias("period_count"),
        F.avg(net).alias("mean_net_return"),
        (F.avg(net) * annual).alias("annualized_net_return"),
        (spread * F.sqrt(F.lit(annual))).alias("annualized_volatility"),
        (F.try_divide(F.avg(net), F.when(spread > 0, spread)) * F.sqrt(F.lit(annual))).alias("annualized_sharpe"),
        F.avg((net > 0).cast("double")).alias("positive_fraction"),
        F.avg("turnover").alias("mean_turnover"),
        F.sum(net).alias("cumulative_net_log_return"),
    )


def portfolio_summary(metrics: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Cohort metrics across cohorts, per group and cost level."""
    return metrics.groupBy(*by, "cost_bps").agg(
        F.countDistinct("cohort").alias("cohort_count"),
        F.sum("period_count").alias("total_periods"),
        F.avg("annualized_sharpe").alias("mean_cohort_sharpe"),
        F.percentile("annualized_sharpe", 0.5).alias("median_cohort_sharpe"),
        F.min("annualized_sharpe").alias("worst_cohort_sharpe"),
        F.max("annualized_sharpe").alias("best_cohort_sharpe"),
        F.avg("annualized_net_return").alias("mean_annualized_net_return"),
        F.percentile("annualized_net_return", 0.5).alias("median_annualized_net_return"),
        F.min("annualized_net_return").alias("worst_annualized_net_return"),
        F.max("annualized_net_return").alias("best_annualized_net_return"),
        F.avg("annualized_volatility").alias("mean_annualized_volatility"),
        F.avg("positive_fraction").alias("mean_positive_fraction"),
        F.avg("mean_turnover").alias("mean_turnover"),
        F.avg("cumulative_net_log_return").alias("mean_cumulative_net_log_return"),
    )


def model_comparison(predictions: DataFrame, summary: DataFrame, costs: list[float]) -> DataFrame:
    """Prediction summary beside the portfolio summary at some cost levels, one row per model."""
    shown = ["mean_cohort_sharpe", "worst_cohort_sharpe", "mean_annualized_net_return", "worst_annualized_net_return", "mean_turnover"]
    wide = summary.groupBy("model").agg(
        *[F.max(F.when(F.abs(F.col("cost_bps") - c) <= 1e-12, F.col(m))).alias(f"{m}_{c:g}bps") for c in costs for m in shown]
    )
    return predictions.join(wide, "model", "left")
