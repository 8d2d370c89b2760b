"""Command line: ``python -m panelmill.cli COMMAND --config FILE``.  Inputs and outputs are folders of parquet and CSV.

Stages in order: ``ingest`` (archives), ``normalize`` (bars), ``panel``, ``predict`` (models), ``analyze`` (evidence),
``sequences`` (sequence audit), ``report`` and ``audit`` (release).
"""

from __future__ import annotations

import argparse
import re
from pathlib import Path

from pyspark.sql import SparkSession

from panelmill.operators import release, report
from panelmill.operators.splits import Fold
from panelmill.plans import analyses
from panelmill.session import local_session
from panelmill.sources import archives, klines, readers, sinks

#: Tables with a row per timestamp, resample or prediction: written as parquet, the rest as CSV.
LARGE = ("_distribution", "_assignments", "predictions", "_differences")


def folds_of(config: dict) -> list[Fold]:
    """Folds of a configuration: rows with fold, train_end, validation_end, test_end, each with its time zone."""
    return [Fold.parse(int(f["fold"]), str(f["train_end"]), str(f["validation_end"]), str(f["test_end"])) for f in config.get("folds", [])]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        a = sub.add_parser(name, help=text)
        a.add_argument("--config", required=True)
        return a

    a = command("ingest", "fetch, verify and extract archives from a mirror")
    a.add_argument("--symbol")
    a.add_argument("--month")
    command("normalize", "kline CSV files to validated bars")
    command("panel", "bars to features, labels and folds")
    a = command("predict", "fit models to the panel and score it")
    a.add_argument("names", nargs="*", choices=[[], *analyses.MODELS], default=[])
    a = command("analyze", "run analyses on bars and predictions")
    a.add_argument("names", nargs="*", choices=[[], *analyses.ANALYSES], default=[])
    command("sequences", "audit the panel for sequence models")
    command("report", "evidence tables to one HTML page")
    a = command("audit", "check a release")
    a.add_argument("--root", default=".")
    return p


def write_table(df, folder: str, name: str) -> None:
    """An evidence table as CSV; a large one as parquet beside it."""
    if name.endswith(LARGE):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder.rstrip('/')}/{name}")
    else:
        sinks.write_evidence(df, Path(folder) / f"{name}.csv")


def predict(spark: SparkSession, c: dict, names: list[str], minutes: int) -> None:
    panel, folds = spark.read.parquet(c["panel"]), folds_of(c)
    parts, records = [], {}
    for name in names or analyses.MODELS:
        options = dict(c.get(name, {}))
        made = analyses.baselines(panel, folds, **options) if name == "baselines" else analyses.neural(panel, folds, name, **options)
        parts.append(made.pop("predictions"))
        for table, df in made.items():
            write_table(df, c["output"], f"{name}_{table}")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    records["predictions"] = sinks.write_predictions(whole, c["predictions"])
    sinks.write_manifest({"stage": "predict", "models": list(names or analyses.MODELS), **records}, Path(c["output"]) / "predict_manifest.json")


def analyze(spark: SparkSession, c: dict, names: list[str], minutes: int) -> None:
    known = spark.read.parquet(c["predictions"]).columns
    predictions = readers.read_predictions(spark, c["predictions"]) if set(readers.PREDICTION_COLUMNS) <= set(known) else spark.read.parquet(c["predictions"])
    panel = spark.read.parquet(c["panel"]) if c.get("panel") and Path(c["panel"]).exists() else None
    study = analyses.Study(spark.read.parquet(c["bars"]), predictions, folds_of(c), minutes, int(c.get("holding", 12)), int(c.get("top", 4)), keep=True, panel=panel)
    for name in names or [n for n in analyses.ANALYSES if panel is not None or n not in analyses.WITH_PANEL]:
        options = dict(c.get(name, {}))
        if name == "ablations":
            options.setdefault("families", analyses.FAMILIES)
        for table, df in analyses.ANALYSES[name](study, **options).items():
            write_table(df, c["output"], table)
    study.release()


def write_report(spark: SparkSession, c: dict) -> None:
    folder, focus = Path(c["output"]), float(c.get("focus", 5.0))
    tables = {p.stem: spark.read.option("header", "true").option("inferSchema", "true").csv(str(p)) for p in sorted(folder.glob("*.csv"))}
    needed = ("oos_model_metrics", "break_even_model_summary", "bootstrap_prediction_summary")
    if missing := [n for n in needed if n not in tables]:
        raise ValueError(f"report lacks evidence: {missing}")
    findings = report.key_findings(*[tables[n] for n in needed], focus, tables.get("bootstrap_portfolio_summary"), tables.get("ablation_feature_summary"))
    hashed = archives.file_hashes(spark, *[str(p) for p in sorted(folder.glob("*.csv"))]).orderBy("path").collect()
    inventory = [{"path": re.sub(".*/", "", r["path"]), "bytes": r["bytes"], "sha256": r["sha256"]} for r in hashed]
    page = report.research_report(c.get("title", "Research report"), tables, findings, focus, c.get("limitations", []), inventory)
    target = Path(c["report"])
    target.parent.mkdir(parents=True, exist_ok=True)
    archives.store(page.encode(), target)


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    c = sinks.load_yaml(args.config)
    spark = local_session(c.get("cpus", "*"), "panelmill-cli", int(c.get("shuffle_partitions", 8)))
    minutes = int(c.get("interval_minutes", 5))
    if args.command == "ingest":
        plan = archives.archive_plan(spark.createDataFrame([(s,) for s in c["symbols"]], "symbol string"), c["interval"], c["start"], c["end"])
        for column, wanted in (("symbol", args.symbol), ("month", args.month)):
            plan = plan.where(plan[column] == wanted) if wanted else plan
        archives.ingest(plan, c["interval"], c["mirror"], c["raw"], c["manifest"])
    elif args.command == "normalize":
        paths = [str(p) for p in sorted(Path(c["raw"]).rglob("*.csv"))]
        klines.check_months(paths, archives.months(c["start"], c["end"]))
        sinks.write_bars(klines.normalize(spark, paths, minutes * analyses.MINUTE), c["bars"])
        if c.get("normalized_manifest"):
            sinks.write_manifest(sinks.normalized_manifest(spark.read.parquet(c["bars"]), minutes, c.get("manifest")), c["normalized_manifest"])
    elif args.command == "panel":
        expected = int(c["expected_symbols"]) if c.get("expected_symbols") else None
        tables = analyses.research_panel(spark.read.parquet(c["bars"]), folds_of(c), int(c.get("horizon", 12)), minutes, expected)
        sinks.write_panel(tables["research_panel"], c["panel"])
        panel = spark.read.parquet(c["panel"])
        sinks.write_manifest(sinks.panel_manifest(panel, tables["fold_summary"], {"bars": c["bars"]}), c["manifest"])
    elif args.command == "predict":
        predict(spark, c, args.names, minutes)
    elif args.command == "analyze":
        analyze(spark, c, args.names, minutes)
    elif args.command == "sequences":
        options = {k: c[k] for k in ("length",) if k in c}
        for table, df in analyses.sequence_audit(spark.read.parquet(c["panel"]), folds_of(c), interval_minutes=minutes, **options).items():
            write_table(df, c["output"], table)
    elif args.command == "report":
        write_report(spark, c)
    else:
        rows = release.audit(release.release_checks(spark, args.root, c.get("manifests", []), c.get("report"), c.get("evidence")))
        sinks.write_manifest({"checks": rows}, c["audit"])
        return int(any(r["status"] == "failed" for r in rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
