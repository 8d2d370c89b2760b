"""Cross-sectional ranks, rank correlation and prediction summaries.

A cross-section holds the few symbols of one timestamp, so its windows partition finely; summaries
over timestamps are partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A deviation up to this is rounding, not variation.
FLAT = 1e-12


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean rank; null values have none."""
    ordered = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), ordered + (ties - 1) / 2.0)


def ordinal_rank(value: str, by: list[str], tie: str = "symbol") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value), F.col(tie)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of ranks as an aggregate over pairs without nulls; null where either side does not vary.

    From plain sums, which are exact for ranks (multiples of a half): a correlation of nil comes out
    as nil, and so does the variation of a constant side.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n, sa, sb = F.count(a), F.sum(a), F.sum(b)
    va, vb = n * F.sum(a * a) - sa * sa, n * F.sum(b * b) - sb * sb
    return F.try_divide(n * F.sum(a * b) - sa * sb, F.when((va > 0) & (vb > 0), F.sqrt(va * vb)))


def with_ranks(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with ``prediction_rank`` and ``target_rank`` in their cross-section."""
    keys = [*by, "timestamp"]
    return df.select("*", average_rank("prediction", keys).alias("prediction_rank"), average_rank("target", keys).alias("target_rank"))


def _sections(df: DataFrame, by: list[str]) -> DataFrame:
    """Per timestamp: rank IC, symbols, and the sums that errors are made of."""
    error = F.col("prediction") - F.col("target")
    return with_ranks(df, by).groupBy(*by, "timestamp").agg(
        correlation("prediction_rank", "target_rank").alias("rank_ic"), F.count("*").alias("symbols"),
        F.sum(error * error).alias("__squares"), F.sum(F.abs(error)).alias("__sizes"), F.count(error).alias("__errors"),
    )


def rank_ic(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``rank_ic`` of every timestamp, null where undefined; the row stays."""
    return _sections(df, by).select(*by, "timestamp", "rank_ic", "symbols")


def ic_moments() -> list[Column]:
    """Aggregates of a timeline of rank ICs: moments of the defined ones; ``n_timestamps`` counts all timestamps."""
    x = F.col("rank_ic")
    spread = F.stddev_samp(x)
    return [
        F.avg(x).alias("mean_rank_ic"),
        F.percentile(x, 0.5).alias("median_rank_ic"),
        spread.alias("rank_ic_std"),
        F.try_divide(F.avg(x), F.when(spread > FLAT, spread)).alias("rank_ic_ir"),
        F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("positive_timestamp_fraction"),
        F.count("*").alias("n_timestamps"),
    ]


def summarize_ic(ic: DataFrame, by: list[str]) -> DataFrame:
    return ic.groupBy(*by).agg(*ic_moments())


def summarize_predictions(df: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Rank IC summary and errors per group; ranks are taken within (group, timestamp).  One exchange by cross-section, one by group."""
    n = F.sum("__errors")
    return _sections(df, by).groupBy(*by).agg(
        *ic_moments(), F.sqrt(F.try_divide(F.sum("__squares"), n)).alias("rmse"), F.try_divide(F.sum("__sizes"), n).alias("mae"), F.sum("symbols").alias("n_rows")
    )


def fold_summary_of_metrics(metrics: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Fold metrics across folds: mean, worst and best fold IC and the means of the rest."""
    return metrics.groupBy(*by).agg(
        F.avg("mean_rank_ic").alias("mean_fold_rank_ic"),
        F.min("mean_rank_ic").alias("worst_fold_rank_ic"),
        F.max("mean_rank_ic").alias("best_fold_rank_ic"),
        F.avg("rank_ic_ir").alias("mean_rank_ic_ir"),
        F.avg("positive_timestamp_fraction").alias("mean_positive_timestamp_fraction"),
        F.avg("rmse").alias("mean_rmse"),
        F.avg("mae").alias("mean_mae"),
        F.sum("n_rows").alias("total_rows"),
    )


def shifted_rank_ic(df: DataFrame, shifts: list[int], by: list[str] = ["model", "fold"]) -> DataFrame:  # noqa: B006
    """Mean rank IC of predictions against the targets ``shift`` rows later, within a fold.

    Ranks are computed once; each row pairs with its shifted targets in one window over the symbol.
    """
    w = Window.partitionBy(*by, "symbol").orderBy("timestamp")
    ranked = with_ranks(df, by)
    lead = lambda k: F.lead("target_rank", k).over(w) if k >= 0 else F.lag("target_rank", -k).over(w)
    shifted = ranked.select(*by, "timestamp", "prediction_rank", *[lead(k).alias(f"__t{i}") for i, k in enumerate(shifts)])
    pairs = F.array(*[F.struct(F.lit(k).alias("shift_bars"), F.col(f"__t{i}").alias("t")) for i, k in enumerate(shifts)])
    paired = shifted.select(*by, "timestamp", "prediction_rank", F.inline(pairs))
    per = paired.where(F.col("t").isNotNull()).groupBy(*by, "shift_bars", "timestamp").agg(correlation("prediction_rank", "t").alias("rank_ic"))
    return per.groupBy(*by, "shift_bars").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("rank_ic").alias("n_timestamps"))


def shift_summary(shifted: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Shifted rank IC over folds: the mean weighted by timestamps, and mean, worst and best fold."""
    m, n = F.col("mean_rank_ic"), F.col("n_timestamps")
    return shifted.groupBy(*by, "shift_bars").agg(
        F.try_divide(F.sum(m * n), F.sum(F.when(m.isNotNull(), n))).alias("mean_rank_ic"), F.avg(m).alias("mean_fold_rank_ic"),
        F.min(m).alias("worst_fold_rank_ic"), F.max(m).alias("best_fold_rank_ic"), F.sum(n).alias("n_timestamps"),
    )
