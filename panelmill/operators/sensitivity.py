"""Breadth, horizon and leave-one-symbol-out as dimensions of one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelmill.functions.scalar import epoch_micros, join_null_safe
from panelmill.operators.bars import by_symbol
from panelmill.operators.features import demean
from panelmill.operators.portfolio import held_periods, portfolio_periods
from panelmill.operators.xsection import ic_moments, with_ranks


def breadth_periods(joined: DataFrame, tops: list[int], interval: int, holding: int, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Portfolio periods for each number of symbols a side; ``joined`` has prediction and execution return.

    Places are computed once, then rows fan out over ``tops``.
    """
    keys = [*by, "timestamp"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("prediction", "symbol"))
    ranked = joined.select(*keys, "symbol", "execution_return", place.alias("place"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    rows = ranked.select("*", F.explode(F.array(*[F.lit(k) for k in tops])).alias("top_count")).where(F.col("n") >= 2 * F.col("top_count"))
    side = F.when(F.col("place") <= F.col("top_count"), -0.5).when(F.col("place") > F.col("n") - F.col("top_count"), 0.5).otherwise(0.0)
    return portfolio_periods(rows.withColumn("weight", side / F.col("top_count")), interval, holding, [*by, "top_count"])


def horizon_reference(bars: DataFrame, horizons: list[int], interval: int, entry: int = 1) -> DataFrame:
    """Label end, raw target and execution return for each horizon; incomplete tails are left out.

    All horizons come from one window over the symbol; a row counts for a horizon only if the row it
    leads to is exactly that many intervals later.
    """
    for h in horizons:
        if h < entry:
            raise ValueError(f"horizon {h} ends before the entry bar {entry}")
    w = by_symbol()
    us = epoch_micros(F.col("timestamp"))
    one = lambda h: F.struct(
        F.lit(h).alias("horizon_bars"),
        F.lead("timestamp", h).over(w).alias("label_end_timestamp"),
        F.ln(F.lead("close", h).over(w) / F.col("close")).alias("raw_target"),
        F.ln(F.lead("close", h).over(w) / F.lead("open", entry).over(w)).alias("execution_return"),
        (epoch_micros(F.lead("timestamp", h).over(w)) - us == h * interval).alias("__exact"),
    )
    ahead = bars.select("timestamp", "symbol", *[one(h).alias(f"__h{h}") for h in horizons])
    rows = ahead.select("timestamp", "symbol", F.inline(F.array(*[F.col(f"__h{h}") for h in horizons])))
    return rows.where("__exact").drop("__exact")


def horizon_targets(reference: DataFrame) -> DataFrame:
    """The reference with ``target`` centred per horizon and timestamp."""
    return reference.withColumn("target", demean("raw_target", ["horizon_bars", "timestamp"]))


def horizon_violations(targets: DataFrame, expected: int) -> DataFrame:
    """Per horizon: timestamps, those that lack one of ``expected`` symbols, and those whose targets are not centred."""
    sections = targets.groupBy("horizon_bars", "timestamp").agg(F.countDistinct("symbol").alias("held"), F.avg("target").alias("mean"))
    return sections.groupBy("horizon_bars").agg(
        F.count("*").alias("timestamps"), F.count_if(F.col("held") != expected).alias("incomplete_cross_sections"), F.count_if(F.abs("mean") > 1e-12).alias("targets_not_centred")
    )


def annual_periods(interval_minutes: float, horizon: int) -> float:
    """Non-overlapping periods of ``horizon`` bars in a year of 525,600 minutes; must be whole."""
    n = 525_600 / (interval_minutes * horizon)
    if abs(n - round(n)) > 1e-9:
        raise ValueError("the year is not a whole number of periods")
    return float(round(n))


def _universe(df: DataFrame, symbols: list[str] | DataFrame) -> DataFrame:
    """The rows with ``__symbols``, all that are to be left out: a literal list, or a table with ``symbol`` of any length as a one-row aggregate."""
    if isinstance(symbols, DataFrame):
        return df.crossJoin(F.broadcast(symbols.agg(F.sort_array(F.collect_set("symbol")).alias("__symbols"))))
    return df.withColumn("__symbols", F.array(*[F.lit(s) for s in symbols]).cast("array<string>"))


def section_ic_without(symbols: np.ndarray, p: np.ndarray, t: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Rank IC of one cross-section without each of ``left_out``; a symbol that is not in it leaves it whole.

    ``p`` and ``t`` are average ranks.  Leaving one out lowers the ranks above it by one and its ties by a
    half, so all cases come from the ranks of the whole section.  NaN stands for a missing value.
    """
    place = {s: i for i, s in enumerate(symbols)}
    at = np.array([place.get(s, -1) for s in left_out], "int64")
    out = np.full(len(at), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        for a in range(0, len(at), 256):
            own = at[a : a + 256, None]
            inside = own >= 0
            cut = [np.where(inside, (x[None, :] > x[own]) + 0.5 * (x[None, :] == x[own]), 0.0) for x in (p, t)]
            keep = np.isfinite(p) & np.isfinite(t) & (np.arange(len(p))[None, :] != own)
            x, y = (np.where(keep, r[None, :] - c, 0.0) for r, c in zip((p, t), cut))
            n, sx, sy = keep.sum(1), x.sum(1), y.sum(1)
            vx, vy = n * (x * x).sum(1) - sx * sx, n * (y * y).sum(1) - sy * sy
            out[a : a + 256] = np.where((vx > 0) & (vy > 0), (n * (x * y).sum(1) - sx * sy) / np.sqrt(vx * vy), np.nan)
    return out


def leave_one_out_summary(df: DataFrame, symbols: list[str] | DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """The prediction summary once per ``excluded_symbol``, without that symbol's rows.

    A cross-section is gathered once and gives its rank ICs for all symbols; errors are those of all rows
    less the symbol's own.  The work grows with timestamps x symbols output rows, not with rows x symbols.
    """
    ranked = with_ranks(df, by)
    section = ranked.groupBy(*by, "timestamp").agg(F.collect_list(F.struct("symbol", "prediction_rank", "target_rank")).alias("rows"))
    whole = _universe(section, symbols).select(*by, "timestamp", *[F.col(f"rows.{c}").alias(c) for c in ("symbol", "prediction_rank", "target_rank")], "__symbols")
    schema = T.StructType([df.schema[b] for b in by] + [T.StructField("excluded_symbol", df.schema["symbol"].dataType), T.StructField("rank_ic", T.DoubleType())])
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            names, p, t, left_out = (batch.column(n_by + 1 + i).to_pylist() for i in range(4))
            for r in range(batch.num_rows):
                out = [x for x in left_out[r] if names[r] != [x]]  # nothing is left of a section of that symbol only
                ic = section_ic_without(np.array(names[r], object), np.array(p[r], "float64"), np.array(t[r], "float64"), np.array(out, object))
                key = [batch.column(i).take(pa.array(np.full(len(ic), r))).cast(target.field(i).type) for i in range(n_by)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(out, pa.string()), pa.array(ic, from_pandas=True)], schema=target)

    ic = whole.mapInArrow(run, schema).groupBy(*by, "excluded_symbol").agg(*ic_moments())
    error = F.col("prediction") - F.col("target")
    own = df.groupBy(*by, "symbol").agg(F.sum(error * error).alias("s"), F.sum(F.abs(error)).alias("a"), F.count(error).alias("e"), F.count("*").alias("n"))
    total = own.groupBy(*by).agg(*[F.sum(c).alias(f"all_{c}") for c in ("s", "a", "e", "n")])
    less = lambda c: F.col(f"all_{c}") - F.coalesce(c, F.lit(0))
    joined = join_null_safe(join_null_safe(ic, total, by), own.withColumnRenamed("symbol", "excluded_symbol"), [*by, "excluded_symbol"], "left") if by else None
    if joined is None:
        raise ValueError("leave_one_out_summary needs a grouping column")
    moments = ["mean_rank_ic", "median_rank_ic", "rank_ic_std", "rank_ic_ir", "positive_timestamp_fraction", "n_timestamps"]
    return joined.select(
        *by, "excluded_symbol", *moments, F.sqrt(F.try_divide(less("s"), less("e"))).alias("rmse"), F.try_divide(less("a"), less("e")).alias("mae"), less("n").alias("n_rows")
    )


def leave_one_out_periods(joined: DataFrame, symbols: list[str] | DataFrame, top: int, interval: int, holding: int, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Portfolio periods once per ``excluded_symbol``; cross-sections of under 2 x ``top`` other symbols are left out.

    Of a cross-section only the ``top`` + 1 rows at either end can be held, whichever symbol is left out, so
    it shrinks to those before it fans out over the symbols.
    """
    keys = [*by, "timestamp"]
    section = Window.partitionBy(*keys)
    ranked = joined.select(*keys, "symbol", "execution_return", F.row_number().over(section.orderBy("prediction", "symbol")).alias("place"), F.count("*").over(section).alias("n"))
    row = F.struct("place", "symbol", "execution_return")
    ends = ranked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("place") <= top + 1, row))).alias("low"),
        F.sort_array(F.collect_list(F.when(F.col("place") > F.col("n") - top - 1, row))).alias("high"),
        F.max("n").alias("n"),
    )
    fanned = _universe(ends, symbols).select(*keys, "low", "high", "n", F.explode("__symbols").alias("excluded_symbol"))
    other = lambda side: F.filter(side, lambda x: x["symbol"] != F.col("excluded_symbol"))
    # With exactly 2 x top symbols every one of them is at an end, so its absence shows there.
    enough = (F.col("n") > 2 * top) | (F.col("n") == 2 * top) & (F.size(other("low")) == F.size("low")) & (F.size(other("high")) == F.size("high"))
    picked = fanned.where(enough).select(*keys, "excluded_symbol", F.slice(other("low"), 1, top).alias("low"), F.slice(other("high"), -top, top).alias("high"))
    weigh = lambda side, w: F.transform(side, lambda x: F.struct(x["symbol"].alias("symbol"), F.lit(w).alias("weight")))
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["execution_return"])
    books = picked.select(
        *keys, "excluded_symbol", ((total("high") - total("low")) * (0.5 / top)).alias("gross_return"), F.concat(weigh("low", -0.5 / top), weigh("high", 0.5 / top)).alias("held")
    )
    return held_periods(books, interval, holding, [*by, "excluded_symbol"])


def symbol_contributions(weighted: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """How often each symbol is held and what it adds to the cumulated gross return."""
    w, c = F.col("weight"), F.col("weight") * F.col("execution_return")
    base = weighted.groupBy(*by, "symbol").agg(
        F.count("*").alias("timestamp_count"),
        F.count_if(w > 0).alias("long_selection_count"),
        F.count_if(w < 0).alias("short_selection_count"),
        F.count_if(w != 0).alias("active_selection_count"),
        F.avg((w > 0).cast("double")).alias("long_selection_fraction"),
        F.avg((w < 0).cast("double")).alias("short_selection_fraction"),
        F.avg((w != 0).cast("double")).alias("active_selection_fraction"),
        F.avg(F.abs(w)).alias("mean_absolute_weight"),
        F.avg(c).alias("mean_gross_return_contribution"),
        F.sum(c).alias("cumulative_gross_log_return_contribution"),
    )
    every = Window.partitionBy(*by)
    size = F.abs("cumulative_gross_log_return_contribution")
    return base.select(
        "*",
        size.alias("absolute_cumulative_contribution"),
        F.try_divide(size, F.sum(size).over(every)).alias("absolute_contribution_share"),
        F.sum("cumulative_gross_log_return_contribution").over(every).alias("portfolio_gross_cumulative_log_return"),
        F.rank().over(every.orderBy(size.desc())).alias("absolute_contribution_rank"),
    )


def first_of_largest(value: str, size, tie: str):
    """Aggregate: ``value`` of the row with the largest ``size``, the first by ``tie`` among equals."""
    return F.min_by(value, F.struct((-size).alias("s"), F.col(tie).alias("t")))


def dependence_summary(ic: DataFrame, portfolio: DataFrame, contributions: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """How far results hang on single symbols.

    ``ic`` has excluded_symbol, mean_rank_ic and full_mean_rank_ic; ``portfolio`` has excluded_symbol,
    pooled_break_even_cost_bps, full_break_even_cost_bps and positive_cohort_fraction_at_focus_cost.
    """
    rows = ic.join(portfolio, [*by, "excluded_symbol"])
    d_ic, d_be = F.abs(F.col("mean_rank_ic") - F.col("full_mean_rank_ic")), F.abs(F.col("pooled_break_even_cost_bps") - F.col("full_break_even_cost_bps"))
    m, be = F.col("mean_rank_ic"), F.col("pooled_break_even_cost_bps")
    left = rows.groupBy(*by).agg(
        F.count("*").alias("excluded_symbol_count"),
        F.max("full_mean_rank_ic").alias("full_mean_rank_ic"),
        F.avg(m).alias("mean_exclusion_rank_ic"), F.min(m).alias("worst_exclusion_rank_ic"), F.max(m).alias("best_exclusion_rank_ic"),
        F.avg((m > 0).cast("double")).alias("positive_exclusion_rank_ic_fraction"),
        F.max(d_ic).alias("maximum_absolute_rank_ic_delta"),
        first_of_largest("excluded_symbol", F.round(d_ic, 12), "excluded_symbol").alias("most_influential_prediction_symbol"),
        F.max("full_break_even_cost_bps").alias("full_break_even_cost_bps"),
        F.avg(be).alias("mean_exclusion_break_even_cost_bps"), F.min(be).alias("worst_exclusion_break_even_cost_bps"), F.max(be).alias("best_exclusion_break_even_cost_bps"),
        F.avg((be > 0).cast("double")).alias("positive_exclusion_break_even_fraction"),
        F.max(d_be).alias("maximum_absolute_break_even_delta_bps"),
        first_of_largest("excluded_symbol", F.round(d_be, 12), "excluded_symbol").alias("most_influential_economic_symbol"),
        F.avg((F.col("positive_cohort_fraction_at_focus_cost") > 0.5).cast("double")).alias("positive_exclusion_fraction_at_focus_cost"),
    )
    share = F.col("absolute_contribution_share")
    top3 = F.slice(F.sort_array(F.collect_list(share), asc=False), 1, 3)
    right = contributions.groupBy(*by).agg(
        first_of_largest("symbol", F.round(share, 12), "symbol").alias("largest_absolute_contribution_symbol"),
        F.max(share).alias("largest_absolute_contribution_share"),
        F.aggregate(top3, F.lit(0.0), lambda a, x: a + x).alias("top_three_absolute_contribution_share"),
        F.sum(share * share).alias("absolute_contribution_hhi"),
    )
    return left.join(right, by)
