"""Market states, regimes by calibration-period tertiles, and results per regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.bars import by_symbol
from panelmill.operators.costs import at_cost
from panelmill.operators.features import full_window
from panelmill.operators.splits import Fold, with_folds

STATES = ["market_return", "market_realized_volatility", "cross_sectional_dispersion"]


def market_state(bars: DataFrame, window: int) -> DataFrame:
    """Per timestamp with full history in every symbol present: mean trailing return, mean trailing
    root of summed squared returns, population spread of trailing returns."""
    w = by_symbol()
    one = F.ln(F.col("close") / F.lag("close").over(w))
    trailing = F.ln(F.col("close") / F.lag("close", window).over(w))
    first = bars.select("symbol", "timestamp", one.alias("r"), trailing.alias("t"))
    square = F.col("r") * F.col("r")
    rows = first.select("timestamp", "t", F.sqrt(full_window(square, F.sum(square), w, window)).alias("v"))
    return rows.groupBy("timestamp").agg(
        F.avg("t").alias("market_return"), F.avg("v").alias("market_realized_volatility"), F.stddev_pop("t").alias("cross_sectional_dispersion"),
        F.count_if(F.col("t").isNull() | F.col("v").isNull()).alias("__gaps"),
    ).where("__gaps = 0").drop("__gaps")


def regime_thresholds(states: DataFrame, folds: Sequence[Fold], low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """Per fold, exact quantiles of the states up to the end of its validation period."""
    if not 0 < low < high < 1:
        raise ValueError("regime quantiles must lie in order between 0 and 1")
    rows = with_folds(states, folds).where("timestamp <= validation_end")
    return rows.groupBy("fold").agg(
        F.count("*").alias("calibration_timestamp_count"),
        F.max("timestamp").alias("calibration_end_timestamp"),
        *[F.percentile(s, q).alias(f"{s}_{n}") for s in STATES for n, q in (("lower", low), ("upper", high))],
    )


def three_way(value: Column, low: Column, high: Column, labels: tuple[str, str, str] = ("low", "medium", "high")) -> Column:
    """First label up to ``low`` (included), third above ``high``, second between."""
    return F.when(value <= low, labels[0]).when(value > high, labels[2]).when(value.isNotNull(), labels[1])


def assign_regimes(states: DataFrame, thresholds: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """``fold``, ``timestamp`` and a regime per state for the fold's test period; thresholds are one row per fold."""
    rows = with_folds(states, folds).where("timestamp > validation_end and timestamp <= test_end")
    joined = rows.join(thresholds, "fold")
    return joined.select("fold", "timestamp", *[three_way(F.col(s), F.col(f"{s}_lower"), F.col(f"{s}_upper")).alias(s) for s in STATES])


def melt_regimes(assigned: DataFrame) -> DataFrame:
    """One row per fold, timestamp and dimension."""
    return assigned.unpivot(["fold", "timestamp"], STATES, "regime_dimension", "regime")


def regime_summary(cells: DataFrame, portfolio: DataFrame, focus: float) -> DataFrame:
    """Per model and dimension over its (fold, regime) cells, naming the worst cell (first by fold and regime among equals)."""
    keys = ["model", "regime_dimension"]

    def worst(value: str) -> Column:
        return F.min_by(F.struct("fold", "regime"), F.struct(F.round(value, 12).alias("v"), F.col("fold"), F.col("regime")))

    m = F.col("mean_rank_ic")
    ic = cells.groupBy(*keys).agg(
        F.count("*").alias("regime_cell_count"), F.avg(m).alias("mean_cell_rank_ic"), F.min(m).alias("worst_cell_rank_ic"), F.max(m).alias("best_cell_rank_ic"),
        F.avg((m > 0).cast("double")).alias("positive_rank_ic_cell_fraction"), worst("mean_rank_ic").alias("w"),
    ).select("*", F.col("w.fold").alias("worst_rank_ic_fold"), F.col("w.regime").alias("worst_rank_ic_regime")).drop("w")
    b = F.col("break_even_cost_bps")
    be = at_cost(portfolio, 0.0).groupBy(*keys).agg(
        F.avg(b).alias("mean_break_even_cost_bps"), F.min(b).alias("worst_break_even_cost_bps"), F.max(b).alias("best_break_even_cost_bps"),
        F.avg((b > 0).cast("double")).alias("positive_break_even_cell_fraction"), worst("break_even_cost_bps").alias("w"),
    ).select("*", F.col("w.fold").alias("worst_break_even_fold"), F.col("w.regime").alias("worst_break_even_regime")).drop("w")
    r = F.col("pooled_annualized_net_return")
    net = at_cost(portfolio, focus).groupBy(*keys).agg(
        F.avg(r).alias("mean_annualized_net_return_at_focus_cost"), F.min(r).alias("worst_annualized_net_return_at_focus_cost"),
        F.avg((r > 0).cast("double")).alias("positive_cell_fraction_at_focus_cost"),
    )
    return ic.join(be, keys).join(net, keys).withColumn("focus_cost_bps", F.lit(focus))
