"""Release audit: inventories, hash references in manifests, text hygiene."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HASH = re.compile("[0-9a-f]{64}")
# The category of a path by its first folder, or its first two.
_CATEGORIES = {
    "artifacts/evidence": "evidence", "artifacts/reports": "report", "artifacts": "artifact", "src": "source", "tests": "test",
    "scripts": "script", "configs": "configuration", "docs": "documentation",
}


def classify_path(path: str) -> str:
    """Category by the first folders; whatever lies elsewhere belongs to the ``repository``."""
    parts = Path(path).parts
    if not parts:
        return "other"
    return next((_CATEGORIES[k] for k in ("/".join(parts[:2]), parts[0]) if k in _CATEGORIES), "repository")


def porcelain_paths(output: str) -> list[str]:
    """Paths in ``git status --porcelain`` output; of a rename the new one.  A line too short for a path is an error."""
    lines = [line for line in output.splitlines() if line]
    if short := [line for line in lines if len(line) < 4]:
        raise ValueError(f"no status lines: {short}")
    return sorted({line[3:].split(" -> ", 1)[-1].strip('"') for line in lines})


def inventory(root: str | Path, paths: Iterable[str]) -> list[dict[str, Any]]:
    rows = []
    for p in sorted(set(paths)):
        content = (Path(root) / p).read_bytes()
        rows.append({"path": p, "category": classify_path(p), "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
    return rows


def inventory_digest(rows: Iterable[dict[str, Any]]) -> str:
    """One hash over sorted ``path NUL sha256 newline``; the order of rows does not matter."""
    text = "".join(f"{r['path']}\0{r['sha256']}\n" for r in sorted(rows, key=lambda r: r["path"]))
    return hashlib.sha256(text.encode()).hexdigest()


def inventory_digest_column(files: DataFrame) -> DataFrame:
    """The same digest of a table of ``path`` and ``sha256``; the inventory is small enough for one row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def _is_file_name(text: Any) -> bool:
    return isinstance(text, str) and bool(text) and "://" not in text and ("/" in text or "." in text) and "\n" not in text


def hash_references(payload: Any) -> list[tuple[str, str]]:
    """Sorted distinct (path, sha256) pairs in a manifest.

    Three forms: ``x`` beside ``x_sha256``; a mapping from path to hash; a record with ``path`` (or
    ``file``, ``archive``) and ``sha256``.
    """
    found: set[tuple[str, str]] = set()

    def is_hash(v: Any) -> bool:
        return isinstance(v, str) and bool(_HASH.fullmatch(v.lower()))

    def walk(node: Any) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        if not isinstance(node, dict):
            return
        for key, value in node.items():
            if is_hash(value):
                named = node.get(key.removesuffix("_sha256")) if key.endswith("_sha256") else None
                if key == "sha256":
                    named = next((node[k] for k in ("path", "file", "archive") if k in node), None)
                for name in (named, key):
                    if _is_file_name(name) and (name != key or not key.endswith("sha256")):
                        found.add((name, value.lower()))
                        break
            walk(value)

    walk(payload)
    return sorted(found)


def revision_with_hash(root: str | Path, path: str, sha256: str) -> str | None:
    """The newest git revision in which the file has this hash."""
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True)
    for revision in git("log", "--format=%H", "--", path).stdout.decode().split():
        shown = git("show", f"{revision}:{path}")
        if shown.returncode == 0 and hashlib.sha256(shown.stdout).hexdigest() == sha256:
            return revision
    return None


def verify_manifests(manifests: Iterable[str | Path], root: str | Path) -> list[dict[str, Any]]:
    """Each reference as ``current``, ``history`` (in an earlier revision) or ``failed``."""
    rows = []
    for manifest in manifests:
        for path, want in hash_references(json.loads(Path(manifest).read_text())):
            file = Path(root) / path
            status = "current" if file.is_file() and hashlib.sha256(file.read_bytes()).hexdigest() == want else "failed"
            if status == "failed" and revision_with_hash(root, path, want):
                status = "history"
            rows.append({"manifest": str(manifest), "path": path, "sha256": want, "status": status})
    return rows


def text_audit(spark: SparkSession, *paths: str) -> DataFrame:
    """Per file: whether it is UTF-8, has only line feeds, and names a user's home folder."""
    files = spark.read.format("binaryFile").load(list(paths))
    text = F.expr("cast(content as string)")
    return files.select(
        "path",
        F.is_valid_utf8(text).alias("is_utf8"),
        (~F.contains(F.make_valid_utf8(text), F.lit("\r"))).alias("line_feeds_only"),
        F.make_valid_utf8(text).rlike(r"/(Users|home)/[A-Za-z]").alias("names_home_folder"),
    )


def audit(checks: dict[str, Any]) -> list[dict[str, str]]:
    """Run named checks (callables returning a detail, raising on failure); every one is reported."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append({"check": name, "status": "passed", "detail": str(check())})
        except Exception as e:  # noqa: BLE001
            rows.append({"check": name, "status": "failed", "detail": str(e)})
    return rows


def release_checks(spark: SparkSession, root: str | Path, manifests: Iterable[str | Path], report: str | Path | None = None, evidence: dict[str, list[str]] | None = None) -> dict[str, Any]:
    """The checks of a release for ``audit``: callables by name, each returning a detail or raising.

    ``evidence`` maps evidence files to the columns they must have.  Paths are relative to ``root``.
    """
    base, listed = Path(root), [Path(m) for m in manifests]
    git = lambda *a: subprocess.run(["git", "-C", str(base), *a], capture_output=True, text=True, check=True).stdout
    tracked = lambda: [p for p in git("ls-files").splitlines() if (base / p).is_file()]
    texts = lambda: [p for p in tracked() if Path(p).suffix in {".py", ".md", ".yaml", ".yml", ".toml", ".csv", ".json", ".html", ".txt"}]

    def holds(condition: bool, detail: Any) -> Any:
        if not condition:
            raise ValueError(str(detail))
        return detail

    def text_rows() -> list[Any]:
        return text_audit(spark, *[str(base / p) for p in texts()]).collect()

    def wrong_texts(column: str, good: bool) -> Any:
        bad = [r["path"] for r in text_rows() if r[column] is not good]
        return holds(not bad, bad or f"{len(texts())} files")

    def hashes(*statuses: str) -> Any:
        rows = verify_manifests(listed, base)
        bad = [r["path"] for r in rows if r["status"] not in statuses]
        return holds(not bad, bad or f"{len(rows)} references")

    def self_contained() -> Any:
        from panelmill.operators.report import require_self_contained

        require_self_contained((base / report).read_text(encoding="utf-8"))
        return str(report)

    def columns(path: str, wanted: list[str]) -> Any:
        with open(base / path, encoding="utf-8") as f:
            head = f.readline().strip().split(",")
        return holds(not set(wanted) - set(head), sorted(set(wanted) - set(head)) or path)

    def digest_twice() -> Any:
        rows = inventory(base, tracked())
        return holds(inventory_digest(rows) == inventory_digest(list(reversed(inventory(base, tracked())))), inventory_digest(rows))

    def parses(suffix: str, load: Any) -> Any:
        files = [p for p in tracked() if p.endswith(suffix)]
        for p in files:
            load((base / p).read_text(encoding="utf-8"))
        return f"{len(files)} files"

    def yaml_load(text: str) -> Any:
        import yaml

        return yaml.safe_load(text)

    checks: dict[str, Any] = {
        "work tree is clean": lambda: holds(not (left := porcelain_paths(git("status", "--porcelain"))), left or "clean"),
        "files are tracked": lambda: holds(bool(tracked()), f"{len(tracked())} files"),
        "inventory is reproducible": digest_twice,
        "no tracked file is empty": lambda: holds(not (empty := [p for p in tracked() if not (base / p).stat().st_size and Path(p).name != "__init__.py"]), empty or "none"),
        "no cache or build file is tracked": lambda: holds(not (bad := [p for p in tracked() if re.search(r"__pycache__|\.pyc$|\.egg-info|\.ipynb_checkpoints", p)]), bad or "none"),
        "texts are UTF-8": lambda: wrong_texts("is_utf8", True),
        "texts have line feeds only": lambda: wrong_texts("line_feeds_only", True),
        "texts name no home folder": lambda: wrong_texts("names_home_folder", False),
        "sources compile": lambda: parses(".py", lambda text: compile(text, "source", "exec")),
        "JSON files parse": lambda: parses(".json", json.loads),
        "YAML files parse": lambda: parses((".yaml", ".yml"), yaml_load),
        "manifests exist": lambda: holds(not (gone := [str(m) for m in listed if not m.is_file()]), gone or f"{len(listed)} manifests"),
        "manifests hold references": lambda: holds(not (bare := [str(m) for m in listed if not hash_references(json.loads(m.read_text()))]), bare or "all"),
        "hashes are those of files now or in history": lambda: hashes("current", "history"),
    }
    if report is not None:
        checks["report is self-contained"] = self_contained
    for path, wanted in (evidence or {}).items():
        checks[f"evidence columns: {path}"] = lambda path=path, wanted=wanted: columns(path, wanted)
    return checks
