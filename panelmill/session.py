"""Session construction and the few cluster settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; everything else is left to the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", app: str = "panelmill", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks.  Clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = BASE_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application.

    Workers import the functions they run by name; they need not have the package installed or share
    the driver's working folder.
    """
    context, home = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _SHIPPED or not home.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="panelmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{home.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(archive)  # served by the driver to every executor, later ones too
    _SHIPPED.add(context.applicationId)


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a parquet table in the shared checkpoint folder: later plans start from it, and a lost executor costs no recomputation.

    The table stays until ``drop_written``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made in this process; how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("PANELMILL_CHECKPOINT_DIR")
    if not named:
        named = tempfile.mkdtemp(prefix="panelmill-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
