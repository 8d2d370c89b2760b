"""Bars from a stream of trades or events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_bars(events: DataFrame, symbol: str, timestamp: str, price: str, quantity: Column, order: list[str], width: str, late: str) -> DataFrame:
    """Tumbling bars of ``width``; events later than ``late`` behind the newest are dropped by the watermark.

    First and last price go by ``order``, not by arrival, so a bar does not depend on micro-batches.
    The frame works on a static input too and then equals the batch bars.
    """
    at = F.col(timestamp).cast("timestamp")
    rows = events.select(F.col(symbol).alias("symbol"), at.alias("t"), F.col(price).alias("p"), quantity.alias("q"), F.struct(*order).alias("o"))
    bars = rows.withWatermark("t", late).groupBy(F.window("t", width), "symbol").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("q").alias("volume"), F.sum(F.col("p") * F.col("q")).alias("quote_volume"), F.count("*").alias("trade_count"),
    )
    return bars.select(F.col("window.start").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def write_bars_stream(bars: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Closed bars appended to parquet, each exactly once; ``checkpoint`` belongs in the shared folder."""
    writer = bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
