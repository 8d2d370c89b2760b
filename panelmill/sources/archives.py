"""Archives of kline files as tables: a plan of what should be there, one pass that brings it in, what came of it.

The plan has one row per symbol and month.  ``bring_in`` maps its rows on the executors: each task reads
an archive and its checksum file (from a mirror folder or over HTTP), puts them through a table of
rules, and writes the CSV it holds to the shared raw folder.  The outcome is a table again: a row with
either the file and its hash, or the first rule that was broken.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import time
import urllib.error
import urllib.request
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.sources.sinks import write_manifest

#: Seconds and attempts for one file over HTTP.
PATIENCE, ATTEMPTS = 60, 3
OUTCOME = "symbol string, interval string, month string, archive string, bytes bigint, sha256 string, csv string, csv_lines bigint, problem string"


def months(start: str, end: str) -> list[str]:
    """``YYYY-MM`` from start to end, both included."""
    for text in (start, end):
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", text):
            raise ValueError(f"not a month: {text!r}")
    span = [str(p) for p in pd.period_range(start, end, freq="M")]
    if not span:
        raise ValueError("the last month lies before the first")
    return span


def archive_plan(symbols: DataFrame, interval: str, start: str, end: str) -> DataFrame:
    """Every (symbol, month) with the names of its archive and checksum file; ``symbols`` is any table with ``symbol``."""
    wanted = F.explode(F.array(*[F.lit(m) for m in months(start, end)]))
    rows = symbols.select("symbol").where("symbol is not null").distinct().select("symbol", wanted.alias("month"))
    name = F.concat_ws("-", "symbol", F.lit(interval), "month")
    return rows.select("symbol", "month", F.concat(name, F.lit(".zip")).alias("filename"), F.concat(name, F.lit(".zip.CHECKSUM")).alias("checksum_name"))


def fetch(location: str) -> bytes | None:
    """The bytes at a path or an HTTP address; None where there is nothing."""
    if not re.match("https?://", location):
        return Path(location).read_bytes() if os.path.isfile(location) else None
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(location, timeout=PATIENCE) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code in (403, 404, 410):
                return None
            problem: Exception = e
        except OSError as e:
            problem = e
        time.sleep(2**attempt)
    raise problem


@dataclass
class Parcel:
    """What is known of one archive while the rules are tried."""

    archive: bytes | None
    checksum: bytes | None
    sha256: str = ""
    members: list[zipfile.ZipInfo] = field(default_factory=list)
    content: bytes = b""

    def published(self) -> str:
        words = (self.checksum or b"").decode("ascii", "replace").split()
        return words[0].lower() if words else ""

    def hashed(self) -> str:
        self.sha256 = hashlib.sha256(self.archive or b"").hexdigest()
        return self.sha256

    def opened(self) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(self.archive or b"")) as z:
                self.members = [m for m in z.infolist() if not m.is_dir()]
                self.content = z.read(self.members[0]) if len(self.members) == 1 else b""  # the CRC is checked on the way
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            return False
        return True

    def leads_elsewhere(self) -> bool:
        return bool(re.search(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)|\\", self.members[0].filename))


#: The rules in the order in which they are tried; a rule is broken where its test holds.
RULES: list[tuple[str, Callable[[Parcel], bool]]] = [
    ("no archive", lambda p: p.archive is None),
    ("no checksum file", lambda p: p.checksum is None),
    ("checksum file without a SHA-256", lambda p: not re.fullmatch("[0-9a-f]{64}", p.published())),
    ("SHA-256 is not the published one", lambda p: p.hashed() != p.published()),
    ("archive is damaged", lambda p: not p.opened()),
    ("archive has not exactly one member", lambda p: len(p.members) != 1),
    ("member's path leads elsewhere", Parcel.leads_elsewhere),
    ("member is no CSV", lambda p: not p.members[0].filename.lower().endswith(".csv")),
]


def first_broken(parcel: Parcel) -> str | None:
    return next((name for name, broken in RULES if broken(parcel)), None)


def store(content: bytes, target: Path) -> None:
    """Whole or not at all; a file of the same size is the same file, brought in before."""
    if target.exists() and target.stat().st_size == len(content):
        return
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
    part.write_bytes(content)
    os.replace(part, target)


def bring_in(plan: DataFrame, interval: str, mirror: str, raw: str) -> DataFrame:
    """One row per planned archive: its CSV under ``raw`` with hash and line count, or the rule it breaks as ``problem``.

    ``mirror`` is a folder or an HTTP address that holds SYMBOL/INTERVAL/NAME; ``raw`` a folder that
    all workers share.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                where = f"{mirror.rstrip('/')}/{row.symbol}/{interval}/"
                parcel = Parcel(fetch(where + row.filename), fetch(where + row.checksum_name))
                problem, csv, n = first_broken(parcel), None, None
                if problem is None:
                    target = Path(raw) / row.symbol / row.month / Path(parcel.members[0].filename).name
                    store(parcel.content, target)
                    csv, n = str(target), parcel.content.count(b"\n") + (not parcel.content.endswith(b"\n") and bool(parcel.content))
                out.append((row.symbol, interval, row.month, where + row.filename, len(parcel.archive or b""), parcel.sha256 or None, csv, n, problem))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"csv_lines": "Int64"})

    tasks = plan.sparkSession.sparkContext.defaultParallelism
    return plan.repartition(4 * tasks, "symbol", "month").mapInPandas(run, OUTCOME)


def ingest(plan: DataFrame, interval: str, mirror: str, raw: str, manifest: str | Path) -> list[dict]:
    """Bring in what the plan asks for and write the manifest of what came; anything that did not is an error, after the manifest is written."""
    rows = [r.asDict() for r in bring_in(plan, interval, mirror, raw).orderBy("symbol", "month").collect()]
    good = [{k: v for k, v in r.items() if k != "problem"} for r in rows if r["problem"] is None]
    write_manifest({"archives": good, "count": len(good)}, manifest)
    if bad := {f"{r['symbol']} {r['month']}": r["problem"] for r in rows if r["problem"]}:
        raise ValueError(f"{len(bad)} of {len(rows)} archives were not brought in: {dict(list(bad.items())[:20])}")
    return good


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """``path``, ``bytes`` and ``sha256`` of whole files, hashed on the executors; for files of up to some hundred MB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
