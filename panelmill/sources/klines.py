"""Kline CSV files to validated bars."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.scalar import micros_to_ntz
from panelmill.operators.bars import BAR_COLUMNS, require_valid, validate_bars
from panelmill.operators.parsing import KLINE_FIELDS

#: Median epoch from which a file counts in microseconds.
MICROSECONDS_FROM = 1e14
_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in KLINE_FIELDS] + [T.StructField("broken", T.StringType())])


def scan_klines(spark: SparkSession, *paths: str) -> DataFrame:
    """All fields as text with ``file``; nothing is cast or dropped yet."""
    rows = spark.read.schema(_TEXT).option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", "true").csv(list(paths))
    # Rows of a file's first block are read in order, so its first row has the least of their numbers.
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    return rows.select("*", F.col("_metadata.file_path").alias("file"), first.alias("number"))


def _unit_factor() -> Column:
    return F.when(F.col("median") >= MICROSECONDS_FROM, 1).otherwise(1000)


def read_klines(spark: SparkSession, *paths: str, symbol_pattern: str = r"([A-Z0-9]+)-[^/]*\.csv$") -> DataFrame:
    """Typed bars of the files, the symbol from the file name.

    A file may have a header as its first line; any other line whose fields are missing or not numbers raises, as
    does a file whose open and close times differ in unit.  The unit is that of the file's median.
    """
    rows = scan_klines(spark, *paths)
    first = F.lower(F.regexp_replace(F.btrim("open_time"), "^﻿", ""))
    header = F.coalesce(first == "open_time", F.lit(False))
    typed = rows.select(
        "file",
        "number",
        header.alias("header"),
        *[F.col(c).try_cast("bigint").alias(c) for c in ("open_time", "close_time", "trade_count")],
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")],
        F.col("broken").isNotNull().alias("broken"),
    )
    numbers = [c for c in KLINE_FIELDS if c != "ignore"]
    bad = F.col("broken")
    for c in numbers:
        bad = bad | F.col(c).isNull()
    data = ~F.col("header")
    files = typed.groupBy("file").agg(
        F.count_if(F.col("header")).alias("headers"),
        F.coalesce(F.min_by("header", F.when(F.col("number").isNotNull(), F.col("number"))), F.lit(False)).alias("on_top"),
        F.count_if(data & bad).alias("bad"),
        F.percentile(F.when(data, F.col("open_time")), 0.5).alias("median"),
        F.percentile(F.when(data, F.col("close_time")), 0.5).alias("close_median"),
    )
    wrong = files.where((F.col("headers") > F.col("on_top").cast("int")) | (F.col("bad") > 0) | ((F.col("median") >= MICROSECONDS_FROM) != (F.col("close_median") >= MICROSECONDS_FROM))).limit(5).collect()
    if wrong:
        raise ValueError(f"unreadable kline files: {[r.asDict() for r in wrong]}")
    units = files.select("file", _unit_factor().alias("factor"))
    joined = typed.where(data).join(units, "file")
    return joined.select(
        micros_to_ntz(F.col("open_time") * F.col("factor")).alias("timestamp"),
        micros_to_ntz(F.col("close_time") * F.col("factor")).alias("available_time"),
        F.regexp_extract("file", symbol_pattern, 1).alias("symbol"),
        *BAR_COLUMNS[3:],
    )


def check_months(paths: Iterable[str], expected: Iterable[str], symbol_pattern: str = r"([A-Z0-9]+)-[^/]*\.csv$") -> None:
    """Each symbol's files, by their names, must cover the expected months and no others."""
    months: dict[str, set[str]] = {}
    for p in paths:
        named, month = re.search(symbol_pattern, p), re.search(r"\d{4}-\d{2}(?=[^/]*$)", p)
        if named and month:
            months.setdefault(named[1], set()).add(month[0])
    wanted = set(expected)
    wrong = {s: (sorted(wanted - found), sorted(found - wanted)) for s, found in sorted(months.items()) if found != wanted}
    if not months and wanted:
        raise ValueError(f"months missing: {sorted(wanted)}, no files")
    if wrong:
        raise ValueError("; ".join(f"{s}: months missing: {a}, unexpected: {b}" for s, (a, b) in wrong.items()))


def normalize(spark: SparkSession, paths: list[str], interval: int) -> DataFrame:
    """Bars of the files after all bar rules hold, for writing by symbol."""
    bars = read_klines(spark, *paths)
    require_valid(validate_bars(bars, interval))
    return bars
