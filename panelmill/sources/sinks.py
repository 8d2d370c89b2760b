"""Writers: partitioned parquet, small evidence tables, manifests, configuration."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evidence tables are summaries; one that is larger than this is refused, not truncated.
EVIDENCE_ROWS = 1_000_000


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars by symbol, in time order within files, zstd.  Rows are spread by symbol and month, so one busy symbol is many tasks."""
    month = F.date_format("timestamp", "yyyy-MM")
    rows = bars.repartition("symbol", month).sortWithinPartitions("symbol", "timestamp")
    rows.write.mode(mode).option("compression", "zstd").partitionBy("symbol").parquet(path)


def write_panel(panel: DataFrame, path: str, rows_per_file: int = 2_000_000, mode: str = "overwrite") -> None:
    panel.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> dict[str, Any]:
    """Predictions by model, fold and split: later reads prune to what they need.  The record has rows per partition and one hash over the files."""
    predictions.write.mode(mode).option("compression", "zstd").partitionBy("model", "fold", "split").parquet(path)
    spark = predictions.sparkSession
    counts = spark.read.parquet(path).groupBy("model", "fold", "split").agg(F.count("*").alias("rows"))
    rows = [r.asDict() for r in counts.orderBy("model", "fold", "split").collect()]
    return {"path": path, "rows": sum(r["rows"] for r in rows), "partitions": rows, "sha256": folder_digest(spark, path)}


def folder_digest(spark: SparkSession, path: str) -> str:
    """One hash over names and contents of the parquet files under ``path``, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    lines = files.select(F.concat_ws(" ", F.sha2("content", 256), F.regexp_extract("path", "[^/]+$", 0)).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256)).first()[0]


def normalized_manifest(bars: DataFrame, interval_minutes: int, source: str | Path | None = None) -> dict[str, Any]:
    """Rows and span of each symbol's bars in symbol order, their total, and the hash of the download manifest they came from."""
    held = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).orderBy("symbol").collect()
    out = {
        "interval_minutes": interval_minutes,
        "symbols": [{"symbol": r["symbol"], "rows": r["rows"], "first_timestamp": str(r["first"]), "last_timestamp": str(r["last"])} for r in held],
        "total_rows": sum(r["rows"] for r in held),
    }
    return out | ({"source": str(source), "source_sha256": hashlib.sha256(Path(source).read_bytes()).hexdigest()} if source and Path(source).is_file() else {})


def write_evidence(df: DataFrame, path: str | Path) -> Path:
    """One CSV file with 12 significant digits, written whole or not at all."""
    rows = df.limit(EVIDENCE_ROWS + 1).toPandas()
    if len(rows) > EVIDENCE_ROWS:
        raise ValueError(f"evidence table has over {EVIDENCE_ROWS} rows")
    return _replace(path, rows.to_csv(index=False, float_format="%.12g", lineterminator="\n"))


def _replace(path: str | Path, text: str) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(text, encoding="utf-8", newline="\n")
    os.replace(part, target)
    return target


def write_manifest(payload: dict[str, Any], path: str | Path) -> Path:
    """JSON with sorted keys, two-space indent and a final newline."""
    return _replace(path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def read_manifest(path: str | Path, **expected: Any) -> dict[str, Any]:
    """The manifest, after the named fields hold the expected values."""
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    wrong = {k: payload.get(k) for k, v in expected.items() if payload.get(k) != v}
    if wrong:
        raise ValueError(f"{path}: unexpected {wrong}")
    return payload


def run_manifest(stage: str, config: str | Path | None, sources: list[str | Path], outputs: list[str | Path], **more: Any) -> dict[str, Any]:
    """What a stage read and wrote, by SHA-256."""
    digest = lambda p: hashlib.sha256(Path(p).read_bytes()).hexdigest()
    return {
        "stage": stage,
        **({"config": str(config), "config_sha256": digest(config)} if config else {}),
        "source_files": {str(p): digest(p) for p in sources},
        "records": [{"path": str(p), "sha256": digest(p)} for p in outputs],
        **more,
    }


def panel_manifest(panel: DataFrame, folds: DataFrame | None = None, sources: dict[str, str] | None = None) -> dict[str, Any]:
    """Rows, timestamps, range and rows by symbol of a panel, its fold summary, and the hash of each source folder (name -> path)."""
    whole = panel.agg(F.count("*").alias("rows"), F.countDistinct("timestamp").alias("timestamps"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    by = {r["symbol"]: r["count"] for r in panel.groupBy("symbol").count().collect()}
    out = {"row_count": whole["rows"], "timestamp_count": whole["timestamps"], "first_timestamp": str(whole["first"]), "last_timestamp": str(whole["last"]), "rows_by_symbol": by}
    if sources:
        out["source_files"] = {path: folder_digest(panel.sparkSession, path) for path in sources.values()}
    return out | ({"folds": [r.asDict() for r in folds.orderBy("fold").collect()]} if folds is not None else {})


def load_yaml(path: str | Path) -> dict[str, Any]:
    """A configuration file whose root is a mapping."""
    import yaml

    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(file)
    payload = yaml.safe_load(file.read_text(encoding="utf-8"))
    if not isinstance(payload, dict):
        raise ValueError(f"{file}: root is no mapping")
    return payload


def resolve_sources(patterns: list[str], root: str | Path, excluded: tuple[str, ...] = ()) -> list[Path]:
    """Files that the patterns match under ``root``, sorted, without names that start with an excluded prefix; each pattern must match."""
    out: set[Path] = set()
    for pattern in patterns:
        found = [p for p in Path(root).glob(pattern) if p.is_file()]
        if not found:
            raise FileNotFoundError(f"nothing matches {pattern}")
        out |= {p for p in found if not p.name.startswith(excluded)} if excluded else set(found)
    return sorted(out)
