"""Point-in-time features and forward labels of a bar panel.

All window expressions of one symbol share one partitioning and order, so Spark plans a single
exchange and sort for them.  Missing history is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions.scalar import any_of, cyclic, epoch_micros, is_finite, safe_divide
from panelmill.operators.bars import by_symbol, complete_cross_sections

# The names that configurations and feature families refer to.
FEATURES = [
    "return_1", "return_3", "return_12", "return_48", "log_range", "close_open_return", "realized_vol_12", "realized_vol_48",
    "log_quote_volume", "volume_zscore_48", "trade_count_zscore_48", "taker_buy_ratio", "time_of_day_sin", "time_of_day_cos", "weekday_sin", "weekday_cos",
]


def full_window(value: Column, aggregate: Column, w: WindowSpec, n: int) -> Column:
    """``aggregate`` over the last ``n`` rows where all of them have a value, else null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def log_return(lag: int, w: WindowSpec, price: str = "close") -> Column:
    return F.ln(F.col(price) / F.lag(price, lag).over(w))


def rolling_zscore(value: Column, w: WindowSpec, n: int) -> Column:
    """(value - mean) / population deviation over the last ``n`` rows; null before they exist and where they are constant."""
    spread = full_window(value, F.stddev_pop(value), w, n)
    return F.try_divide(value - full_window(value, F.avg(value), w, n), F.when(spread > 0, spread))


def realized_volatility(ret: Column, w: WindowSpec, n: int) -> Column:
    return full_window(ret, F.stddev_pop(ret), w, n) * F.sqrt(F.lit(float(n)))


def taker_ratio(buy: str = "taker_buy_quote_volume", total: str = "quote_volume") -> Column:
    """Share of aggressive buying; neutral 0.5 where nothing traded."""
    return safe_divide(F.col(buy), F.when(F.col(total) > 0, F.col(total)), 0.5)


def symbol_features(bars: DataFrame, short: int = 12, long: int = 48, lags: tuple[int, int, int, int] = (1, 3, 12, 48)) -> DataFrame:
    """The bars with 16 features; names keep the default window lengths."""
    w = by_symbol()
    ts = F.col("timestamp")
    sin_time, cos_time = cyclic(F.hour(ts) * 60 + F.minute(ts), 1440.0)
    sin_day, cos_day = cyclic(F.weekday(ts).cast("double"), 7.0)
    first = bars.select(
        "*",
        *[log_return(k, w).alias(n) for k, n in zip(lags, FEATURES[:4])],
        F.ln(F.col("high") / F.col("low")).alias("log_range"),
        F.ln(F.col("close") / F.col("open")).alias("close_open_return"),
        F.log1p("quote_volume").alias("log_quote_volume"),
        F.log1p("volume").alias("__lv"),
        F.log1p(F.col("trade_count").cast("double")).alias("__lt"),
        taker_ratio().alias("taker_buy_ratio"),
        sin_time.alias("time_of_day_sin"), cos_time.alias("time_of_day_cos"), sin_day.alias("weekday_sin"), cos_day.alias("weekday_cos"),
    )
    r = F.col("return_1")
    return first.select(
        *bars.columns,
        *[
            {
                "realized_vol_12": realized_volatility(r, w, short),
                "realized_vol_48": realized_volatility(r, w, long),
                "volume_zscore_48": rolling_zscore(F.col("__lv"), w, long),
                "trade_count_zscore_48": rolling_zscore(F.col("__lt"), w, long),
            }.get(n, F.col(n)).alias(n)
            for n in FEATURES
        ],
    )


def demean(value: str, by: list[str] = ["timestamp"]) -> Column:  # noqa: B006
    """Value less the mean of the values present in its cross-section."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))


def forward_targets(panel: DataFrame, horizon: int, interval: int) -> DataFrame:
    """``label_end_timestamp``, ``raw_target`` = ln(close h bars later / close) and its cross-sectional ``target``.

    Bars with an ``available_time`` also get ``label_end_time``, when the label's last bar is available.  Null where the row ``horizon`` rows on is not exactly ``horizon`` intervals later.
    """
    w = by_symbol()
    end = F.lead("timestamp", horizon).over(w)
    exact = epoch_micros(end) - epoch_micros(F.col("timestamp")) == horizon * interval
    known = [F.when(exact, F.lead("available_time", horizon).over(w)).alias("label_end_time")] if "available_time" in panel.columns else []
    labelled = panel.select(
        "*", *known, F.when(exact, end).alias("label_end_timestamp"), F.when(exact, F.ln(F.lead("close", horizon).over(w) / F.col("close"))).alias("raw_target")
    )
    return labelled.withColumn("target", demean("raw_target"))


def execution_returns(bars: DataFrame, holding: int, entry: int = 1) -> DataFrame:
    """ln(close at exit / open at entry): in one bar after the signal, out ``holding`` bars after it."""
    w = by_symbol()
    value = F.ln(F.lead("close", holding).over(w) / F.lead("open", entry).over(w))
    return bars.select("timestamp", "symbol", value.alias("execution_return")).where(F.col("execution_return").isNotNull())


def with_execution(predictions: DataFrame, bars: DataFrame, holding: int) -> DataFrame:
    """Predictions with their ``execution_return``; a prediction without one raises when it is reached, none is lost."""
    joined = predictions.join(execution_returns(bars, holding), ["timestamp", "symbol"], "left")
    lost = F.raise_error(F.format_string("no execution return for %s at %s", F.col("symbol"), F.col("timestamp").cast("string"))).cast("double")
    return joined.withColumn("execution_return", F.coalesce("execution_return", lost))


def panel_violations(panel: DataFrame, features: list[str], expected: int) -> DataFrame:
    """``check`` and ``violations`` of a panel whose rows are complete: what ``require_panel`` refuses.

    One aggregation by timestamp and one over timestamps.
    """
    late = (F.col("available_time") > F.col("label_end_time")) if {"available_time", "label_end_time"} <= set(panel.columns) else F.lit(False)
    number = lambda c: F.col(c).cast("double")
    sections = panel.groupBy("timestamp").agg(
        F.count("*").alias("rows"), F.countDistinct("symbol").alias("held"), F.count_if(any_of([~is_finite(number(f)) for f in features])).alias("features"),
        F.count_if(any_of([~is_finite(number(c)) for c in ("raw_target", "target")])).alias("targets"), F.avg("target").alias("mean"), F.count_if(late).alias("late"),
    )
    one = sections.agg(
        (F.count("*") == 0).cast("bigint").alias("empty"), F.sum(F.col("rows") - F.col("held")).alias("repeated_keys"), F.sum("features").alias("features_not_finite"),
        F.sum("targets").alias("targets_not_finite"), F.count_if(F.col("held") != expected).alias("incomplete_cross_sections"),
        F.count_if(F.abs("mean") > 1e-12).alias("targets_not_centred"), F.sum("late").alias("available_after_label_end"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations")) for c in one.columns])))


def require_panel(panel: DataFrame, features: list[str], expected: int) -> None:
    broken = {r["check"]: r["violations"] for r in panel_violations(panel, features, expected).where("violations > 0").collect()}
    if broken:
        raise ValueError(f"panel refused: {broken}")


def finalize_panel(panel: DataFrame, features: list[str], expected: int | None = None) -> DataFrame:
    """Rows with all features and labels, features as float.

    With an ``expected`` number of symbols the panel is checked now and refused for repeated keys,
    numbers that are not finite, incomplete cross-sections, targets that are not centred or features that
    are available only after their label ends.  Without one, incomplete cross-sections (fewer symbols
    than the fullest has) are left out and targets recentred on the rest.
    """
    ends = [c for c in ("label_end_timestamp", "label_end_time") if c in panel.columns]
    rows = panel.dropna(subset=[*features, "raw_target", "target", *ends])
    if expected is not None:
        require_panel(rows, features, expected)
    else:
        rows = complete_cross_sections(rows).withColumn("target", demean("raw_target"))
    return rows.withColumns({f: F.col(f).cast("float") for f in features})
