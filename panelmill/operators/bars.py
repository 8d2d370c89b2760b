"""Trades or events to OHLCV bars, and checks of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalar import all_of, any_of, bucket_micros, epoch_micros, is_finite, micros_to_ntz

BAR_COLUMNS = [
    "timestamp", "available_time", "symbol", "open", "high", "low", "close", "volume",
    "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume",
]


def ohlcv_bars(
    ticks: DataFrame,
    symbol: Column,
    timestamp: Column,
    price: Column,
    quantity: Column,
    order: list[Column],
    width: int,
    origin: int = 0,
    taker: Column | None = None,
) -> DataFrame:
    """Bars of ``width`` microseconds, buckets counted from ``origin``.

    One aggregation with map-side combine.  ``order`` must be total within a bar: the first and last
    price are picked by it, never by arrival.  ``available_time`` is one millisecond before the end.
    """
    rows = ticks.select(
        symbol.alias("symbol"),
        bucket_micros(timestamp, width, origin).alias("us"),
        price.alias("p"),
        quantity.alias("q"),
        F.struct(*order).alias("o"),
        (taker if taker is not None else F.lit(False)).alias("taker"),
    )
    return rows.groupBy("symbol", "us").agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.sum("q").alias("volume"),
        F.sum(F.col("p") * F.col("q")).alias("quote_volume"),
        F.count("*").alias("trade_count"),
        F.sum(F.when(F.col("taker"), F.col("q")).otherwise(0.0)).alias("taker_buy_volume"),
        F.sum(F.when(F.col("taker"), F.col("p") * F.col("q")).otherwise(0.0)).alias("taker_buy_quote_volume"),
    ).select(
        micros_to_ntz(F.col("us")).alias("timestamp"),
        micros_to_ntz(F.col("us") + width - 1000).alias("available_time"),
        *BAR_COLUMNS[2:],
    )


def by_symbol(*extra: str):
    """The window of one symbol's rows in time order."""
    return Window.partitionBy(*extra, "symbol").orderBy("timestamp")


def bar_rules(interval: int) -> list[tuple[str, Column]]:
    """Row rules of a bar in the order in which the first broken one is reported; true where broken."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    activity = [F.col(c) for c in ("volume", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")]
    lasting = epoch_micros(F.col("available_time")) - epoch_micros(F.col("timestamp"))
    return [
        ("null_value", any_of([F.col(c).isNull() for c in BAR_COLUMNS])),
        ("non_finite", any_of([~is_finite(c.cast("double")) & c.isNotNull() for c in prices + activity])),
        ("price_not_positive", any_of([c <= 0 for c in prices])),
        ("negative_activity", any_of([c < 0 for c in activity])),
        ("high_too_low", F.col("high") < F.greatest("open", "close", "low")),
        ("low_too_high", F.col("low") > F.least("open", "close", "high")),
        ("available_before_start", lasting < 0),
        ("longer_than_interval", lasting > interval),
    ]


def validate_bars(bars: DataFrame, interval: int) -> DataFrame:
    """Per symbol: rows, counts of each broken rule, ``duplicate_rows``, ``off_grid_steps`` and ``missing_intervals``.

    Spacing is taken between neighbouring times within each month of a symbol, then from month to month
    over one row each, so a symbol with very many rows is many tasks.
    """
    us, month = epoch_micros(F.col("timestamp")), F.date_trunc("MONTH", "timestamp")
    rules = bar_rules(interval)
    rows = bars.select("symbol", "timestamp", month.alias("__month"), us.alias("__us"), *[c.alias(n) for n, c in rules])
    own = Window.partitionBy("symbol", "__month").orderBy("timestamp")
    step = F.col("__step")

    def spacing() -> dict[str, Column]:
        return {
            "duplicate_rows": F.count_if(step == 0),
            "off_grid_steps": F.count_if(F.pmod(step, F.lit(interval)) != 0),
            "missing_intervals": F.sum(F.when(step > 0, F.floor(step / interval) - 1).otherwise(0)),
        }

    by_month = rows.withColumn("__step", F.col("__us") - F.lag("__us").over(own)).groupBy("symbol", "__month").agg(
        F.count("*").alias("row_count"), *[F.count_if(F.col(n)).alias(n) for n, _ in rules], *[c.alias(n) for n, c in spacing().items()],
        F.min("__us").alias("__first"), F.max("__us").alias("__last"),
    )
    months = Window.partitionBy("symbol").orderBy("__month")
    counted = ["row_count", *[n for n, _ in rules]]
    joined = by_month.withColumn("__step", F.col("__first") - F.lag("__last").over(months))
    return joined.groupBy("symbol").agg(
        *[F.sum(n).alias(n) for n in counted], *[(F.sum(n) + F.coalesce(c, F.lit(0))).cast("bigint").alias(n) for n, c in spacing().items()]
    )


def require_valid(report: DataFrame) -> None:
    """Raise with the first broken rule, in rule order, over all symbols; one aggregate reaches the driver."""
    counted = [n for n in report.columns if n not in {"symbol", "row_count", "missing_intervals"}]
    row = report.agg(F.count("*").alias("symbols"), *[F.sum(n).alias(n) for n in counted]).first()
    if not row["symbols"]:
        raise ValueError("no bars")
    for n in counted:
        if row[n]:
            raise ValueError(f"bars break the rule {n}: {row[n]} rows")


def complete_cross_sections(df: DataFrame, expected: int | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of the timestamps at which ``expected`` symbols are present (default: as many as ever are).

    One aggregation by timestamp and a join back; timestamps are many, symbols at each are few.
    """
    counts = df.groupBy(*by, "timestamp").agg(F.countDistinct("symbol").alias("__n"))
    if expected is None:
        most = counts.agg(F.max("__n").alias("__most"))
        counts = counts.join(F.broadcast(most), F.col("__n") == F.col("__most"))
    else:
        counts = counts.where(F.col("__n") == expected)
    return df.join(counts.select(*by, "timestamp"), [*by, "timestamp"], "left_semi")


def contiguous(df: DataFrame, interval: int) -> Column:
    """True where a row follows its symbol's previous row by exactly ``interval`` (or has none)."""
    us = epoch_micros(F.col("timestamp"))
    return F.coalesce(us - F.lag(us).over(by_symbol()) == interval, F.lit(True))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all ``columns`` are finite."""
    return df.where(all_of([is_finite(F.col(c).cast("double")) for c in columns]))
