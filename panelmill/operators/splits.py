"""Purged walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Ends of the three periods, as UTC times without zone; each must come after the one before."""

    fold: int
    train_end: datetime
    validation_end: datetime
    test_end: datetime

    def __post_init__(self) -> None:
        if not self.train_end < self.validation_end < self.test_end:
            raise ValueError(f"fold {self.fold}: boundaries are not in order")

    @staticmethod
    def parse(fold: int, *ends: str) -> Fold:
        """From texts with a zone (``Z`` or an offset), turned to UTC; a time without one is refused."""
        return Fold(fold, *(_utc(e) for e in ends))


def _utc(text: str) -> datetime:
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        raise ValueError(f"fold boundary without a time zone: {text!r}")
    return moment.astimezone(UTC).replace(tzinfo=None)


def _fold_rows(folds: Sequence[Fold]) -> Column:
    stamp = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.array(
        *[
            F.struct(F.lit(f.fold).alias("fold"), stamp(f.train_end).alias("train_end"), stamp(f.validation_end).alias("validation_end"), stamp(f.test_end).alias("test_end"))
            for f in folds
        ]
    )


def with_folds(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Each row once per fold (a few), with the fold's boundaries; no join, no shuffle."""
    return df.select("*", F.inline(_fold_rows(folds)))


def split_label() -> Column:
    """``train``, ``validation``, ``test``, ``purged`` (its label ends beyond its period) or null (after the fold)."""
    ts, end = F.col("timestamp"), F.col("label_end_timestamp")
    periods = (("train", None, "train_end"), ("validation", "train_end", "validation_end"), ("test", "validation_end", "test_end"))
    label = F.lit(None).cast("string")
    for name, low, high in reversed(periods):
        inside = ts <= F.col(high) if low is None else (ts > F.col(low)) & (ts <= F.col(high))
        label = F.when(inside, F.when(end <= F.col(high), name).otherwise("purged")).otherwise(label)
    return label


def assign_folds(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows by fold with ``split``; rows after a fold's test period leave that fold."""
    return with_folds(panel, folds).withColumn("split", split_label()).where(F.col("split").isNotNull())


def fold_summary(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows of each split and rows purged at each boundary, per fold; one aggregation."""
    ts, end = F.col("timestamp"), F.col("label_end_timestamp")

    def crossing(low: Column | None, high: str) -> Column:
        inside = ts <= F.col(high) if low is None else (ts > low) & (ts <= F.col(high))
        return F.count_if(inside & (end > F.col(high)))

    rows = with_folds(panel, folds).withColumn("split", split_label())
    return rows.groupBy("fold").agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")],
        crossing(None, "train_end").alias("train_purged"),
        crossing(F.col("train_end"), "validation_end").alias("validation_purged"),
        crossing(F.col("validation_end"), "test_end").alias("test_purged"),
    )


def split_audit(assigned: DataFrame) -> DataFrame:
    """Rows, timestamps and spans of each fold's splits, purged rows left out."""
    return assigned.where("split <> 'purged'").groupBy("fold", "split").agg(
        F.count("*").alias("rows"), F.countDistinct("timestamp").alias("timestamps"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.max("label_end_timestamp").alias("last_label_end_timestamp"),
    )
