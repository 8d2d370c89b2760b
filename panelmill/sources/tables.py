"""Parquet table access.  A table is a file or a directory ``<root>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmill.session import ship_package


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of one table; column pruning and filters are left to Catalyst."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def register_views(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temp views, so that every table is reachable from ``spark.sql``."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)
