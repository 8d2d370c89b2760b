"""History windows of a panel for sequence models, as arrays; nothing is materialised before endpoints are chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalar import any_of, epoch_micros, is_finite
from panelmill.operators.bars import by_symbol


def number_timestamps(stamps: DataFrame, name: str) -> DataFrame:
    """Distinct timestamps with their place from 0 as ``name``.

    Each month numbers its own; the months before it, one row each, add what they hold.
    """
    month = F.date_trunc("MONTH", "timestamp")
    own = stamps.select("timestamp", month.alias("__month"))
    held = own.groupBy("__month").agg(F.count("*").alias("n"))
    before = held.select("__month", (F.sum("n").over(Window.orderBy("__month")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__month").orderBy("timestamp")) - 1
    return own.select("timestamp", "__month", place.alias("__place")).join(before, "__month").select("timestamp", (F.col("__before") + F.col("__place")).alias(name))


def timestamp_positions(df: DataFrame) -> DataFrame:
    """Distinct timestamps with their position from 0."""
    return number_timestamps(df.select("timestamp").where("timestamp is not null").distinct(), "position")


def sequence_endpoints(df: DataFrame, length: int, split: str | None = None) -> DataFrame:
    """Timestamps with ``length`` timestamps of history up to and including them; with ``split``, only those at which every row is in it."""
    positions = timestamp_positions(df)
    if split is not None:
        uniform = df.groupBy("timestamp").agg(F.bool_and(F.coalesce(F.col("split") == split, F.lit(False))).alias("all")).where("all").select("timestamp")
        positions = positions.join(uniform, "timestamp", "left_semi")
    return positions.where(F.col("position") >= length - 1)


def subsample_endpoints(endpoints: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th endpoint, from the first."""
    kept = number_timestamps(endpoints.select("timestamp"), "__place").where(F.col("__place") % stride == 0)
    return endpoints.join(kept.select("timestamp"), "timestamp", "left_semi")


def endpoint_coverage(df: DataFrame, length: int, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Per split: timestamps wholly in it, endpoints among them, those without enough history, first and last endpoint."""
    state = df.groupBy("timestamp").agg(*[F.bool_and(F.coalesce(F.col("split") == s, F.lit(False))).alias(s) for s in splits])
    rows = state.join(timestamp_positions(df), "timestamp").select(
        "timestamp", "position", F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in splits]))).alias("split")
    )
    able = F.col("position") >= length - 1
    return rows.groupBy("split").agg(
        F.count("*").alias("timestamps"), F.count_if(able).alias("endpoints"), F.count_if(~able).alias("excluded_for_history"),
        F.min(F.when(able, F.col("timestamp"))).alias("first_endpoint"), F.max(F.when(able, F.col("timestamp"))).alias("last_endpoint"),
    )


def panel_shape_violations(df: DataFrame, features: list[str], interval: int) -> DataFrame:
    """What keeps a panel from being a full block of timestamps x symbols x finite features: ``check`` and ``violations``."""
    symbols = df.agg(F.countDistinct("symbol").alias("width"))
    bad = any_of([~is_finite(F.col(c).cast("double")) for c in [*features, "target"]])
    sections = df.groupBy("timestamp").agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("held"), F.count_if(bad).alias("bad"))
    numbered = number_timestamps(sections.select("timestamp"), "position")
    us = epoch_micros(F.col("timestamp"))
    start = numbered.agg(F.min(us).alias("start"))
    one = (
        sections.join(numbered, "timestamp")
        .crossJoin(F.broadcast(symbols))  # one row each
        .crossJoin(F.broadcast(start))
        .agg(
            F.count_if(F.col("rows") != F.col("held")).alias("repeated_keys"), F.count_if(F.col("held") != F.col("width")).alias("incomplete_sections"),
            F.sum("bad").alias("not_finite"), F.count_if(us != F.col("start") + F.col("position") * interval).alias("off_grid"), (F.count("*") == 0).cast("bigint").alias("empty"),
        )
    )
    names = ["empty", "repeated_keys", "incomplete_sections", "not_finite", "off_grid"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("violations")) for n in names])))


def sequence_windows(df: DataFrame, features: list[str], length: int, endpoints: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``window``: the features of the last ``length`` rows of the symbol, oldest first, at full histories (and endpoints) only; ``keep`` names more columns to carry."""
    frame = by_symbol().rowsBetween(-(length - 1), 0)
    rows = df.select("timestamp", "symbol", "target", *keep, F.collect_list(F.array(*[F.col(f).cast("float") for f in features])).over(frame).alias("window"))
    rows = rows.where(F.size("window") == length)
    return rows if endpoints is None else rows.join(endpoints.select("timestamp"), "timestamp", "left_semi")
