"""Readers of what earlier stages wrote: predictions and evidence tables, with the checks their use relies on."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators.checks import require_columns, require_unique, validate_predictions

PREDICTION_COLUMNS = ["model", "fold", "split", "timestamp", "symbol", "raw_target", "target", "prediction"]


def read_predictions(spark: SparkSession, path: str, models: Sequence[str] = (), folds: Sequence[int] = (), split: str | None = "test", check: bool = True) -> DataFrame:
    """Predictions of some models and folds (all by default) of one split.

    Model, fold and split are partitions, so only their files are read.  Repeated keys and values that are
    not finite are refused, as is an empty selection; ``check=False`` leaves the tests to the caller.
    """
    rows = spark.read.parquet(path)
    require_columns(rows, PREDICTION_COLUMNS, "predictions")
    for column, wanted in (("model", models), ("fold", folds), ("split", [split] if split else ())):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    if check:
        keyed = rows.withColumn("model", F.concat_ws("/", "model", "split"))
        if broken := {r["check"]: r["violations"] for r in validate_predictions(keyed).where("violations > 0").collect()}:
            raise ValueError(f"predictions refused: {broken}")
    return rows


def read_fold(spark: SparkSession, path: str, model: str, fold: int, split: str = "test") -> DataFrame:
    """One model's predictions of one fold."""
    return read_predictions(spark, path, [model], [fold], split)


def read_evidence(spark: SparkSession, path: str | Path, schema: T.StructType | str, keys: Sequence[str] = ()) -> DataFrame:
    """An evidence CSV with the columns and types of ``schema``; another header or a value of another type raises, as do repeated ``keys``."""
    wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = spark.read.schema(wanted).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(str(path))
    if keys:
        require_unique(rows, list(keys), str(path))
    return rows
