import hashlib
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators import release as A
from panelmill.operators import report as H
from panelmill.sources import archives as R
from panelmill.sources import klines as K
from panelmill.sources import sinks as W
from panelmill.streaming.bars import read_stream, streaming_bars, write_bars_stream

STEP = 300_000


def lines(n=3, start=1735689600000, factor=1):
    return [f"{(start + i * STEP) * factor},1,2,.5,1.5,10,{(start + (i + 1) * STEP) * factor - 1},15,3,5,7.5,0" for i in range(n)]


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_months():
    assert list(R.months("2025-11", "2026-02")) == ["2025-11", "2025-12", "2026-01", "2026-02"]
    for bad in (("2025-13", "2026-01"), ("2026-02", "2026-01"), ("2026-2", "2026-03")):
        with pytest.raises(ValueError):
            list(R.months(*bad))


def zipped(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    path.with_name(path.name + ".CHECKSUM").write_text(f"{digest.upper()}  {path.name}\n")
    return digest


def test_archives(spark, tmp_path):
    text = "\n".join(lines()) + "\n"
    mirror = tmp_path / "mirror"
    digest = zipped(mirror / "AAA/5m/AAA-5m-2025-01.zip", {"AAA-5m-2025-01.csv": text})
    symbols = spark.createDataFrame([("AAA",), ("AAA",), (None,)], "symbol string")
    plan = R.archive_plan(symbols, "5m", "2025-01", "2025-01")
    for _ in range(2):  # a second time changes nothing
        out = R.ingest(plan, "5m", str(mirror), str(tmp_path / "raw"), tmp_path / "m.json")
        assert out[0]["csv_lines"] == 3 and out[0]["sha256"] == digest and (tmp_path / "raw/AAA/2025-01/AAA-5m-2025-01.csv").read_text() == text
    assert json.loads((tmp_path / "m.json").read_text())["count"] == 1
    cases = {
        "AAA": None, "BBB": "no archive", "CCC": "SHA-256 is not the published one", "DDD": "member's path leads elsewhere", "EEE": "archive has not exactly one member",
        "FFF": "member is no CSV", "GGG": "archive is damaged", "HHH": "no checksum file", "III": "checksum file without a SHA-256",
    }
    members = {"DDD": {"../x.csv": ""}, "EEE": {"a.csv": "", "b.csv": ""}, "FFF": {"a.txt": ""}}
    for s in list(cases)[2:]:
        path = mirror / f"{s}/5m/{s}-5m-2025-01.zip"
        zipped(path, members.get(s, {"a.csv": text}))
        side = path.with_name(path.name + ".CHECKSUM")
        if s == "CCC":
            side.write_text("0" * 64)
        elif s == "GGG":
            path.write_bytes(b"PK broken")
            side.write_text(hashlib.sha256(b"PK broken").hexdigest())
        elif s == "HHH":
            side.unlink()
        elif s == "III":
            side.write_text("nothing")
    wide = R.archive_plan(spark.createDataFrame([(s,) for s in cases], "symbol string"), "5m", "2025-01", "2025-01")
    got = {r["symbol"]: r["problem"] for r in R.bring_in(wide, "5m", str(mirror), str(tmp_path / "raw2")).collect()}
    assert got == cases and not (tmp_path / "x.csv").exists() and not list((tmp_path / "raw2").rglob("*.part"))
    with pytest.raises(ValueError, match="8 of 9"):
        R.ingest(wide, "5m", str(mirror), str(tmp_path / "raw2"), tmp_path / "m.json")
    assert json.loads((tmp_path / "m.json").read_text())["count"] == 1
    assert R.archive_plan(spark.createDataFrame([("A",), ("B",)], "symbol string"), "5m", "2025-11", "2026-01").count() == 6
    assert digest in {r["sha256"] for r in R.file_hashes(spark, str(mirror)).collect()}


def test_archives_over_http(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    zipped(tmp_path / "mirror/AAA/5m/AAA-5m-2025-01.zip", {"a.csv": "1\n2"})
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path / "mirror")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        plan = R.archive_plan(spark.createDataFrame([("AAA",)], "symbol string"), "5m", "2025-01", "2025-02")
        got = {r["month"]: (r["csv_lines"], r["problem"]) for r in R.bring_in(plan, "5m", f"http://127.0.0.1:{server.server_port}", str(tmp_path / "raw")).collect()}
    finally:
        server.shutdown()
    assert got == {"2025-01": (2, None), "2025-02": (None, "no archive")}


def test_klines(spark, tmp_path):
    a = put(tmp_path / "A-5m-2025-01.csv", ["﻿Open_Time,open,high,low,close,volume,close_time,quote_volume,trade_count,taker_buy_volume,taker_buy_quote_volume,ignore", *lines()])
    b = put(tmp_path / "B-5m-2025-01.csv", lines(4, factor=1000))
    bars = K.normalize(spark, [a, b], STEP * 1000)
    got = sorted((r["symbol"], str(r["timestamp"])) for r in bars.collect())
    assert len(got) == 7 and got[0] == ("A", "2025-01-01 00:00:00") and got[3] == ("B", "2025-01-01 00:00:00")
    W.write_bars(bars, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert back.count() == 7 and "PartitionFilters: [isnotnull(symbol" in back.where("symbol = 'A'")._jdf.queryExecution().toString()
    for name, rows in (("C", [*lines(), "invalid,row"]), ("D", [lines()[0], "open_time" + lines()[1][13:], "open_time" + lines()[2][13:]]), ("E", [x.replace(",1.5,", ",,") for x in lines()])):
        with pytest.raises(ValueError, match="unreadable"):
            K.read_klines(spark, put(tmp_path / f"bad/{name}-5m-2025-01.csv", rows))
    with pytest.raises(ValueError, match="high_too_low"):
        K.normalize(spark, [put(tmp_path / "high/F-5m-2025-01.csv", [lines()[0].replace(",2,", ",.9,"), *lines()[1:]])], STEP * 1000)
    late = [*lines()[:1], "open_time,open,high,low,close,volume,close_time,quote_volume,trade_count,taker_buy_volume,taker_buy_quote_volume,ignore", *lines()[1:]]
    with pytest.raises(ValueError, match="unreadable"):  # a header belongs on top
        K.read_klines(spark, put(tmp_path / "late/G-5m-2025-01.csv", late))
    K.check_months([a, b], ["2025-01"])
    with pytest.raises(ValueError, match="A: months missing: \\['2025-02'\\]"):
        K.check_months([a], ["2025-01", "2025-02"])
    with pytest.raises(ValueError, match="A: .*2025-02.*; B: .*2025-01"):
        K.check_months(["x/A-5m-2025-01.csv", "x/B-5m-2025-02.csv"], ["2025-01", "2025-02"])
    with pytest.raises(ValueError, match="no files"):
        K.check_months([], ["2025-01"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, "test", 1 / 3), ("n", 2, "test", float("nan"))], "model string, fold int, split string, x double")
    W.write_predictions(df, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("model = 'm' and fold = 1")
    assert plan.count() == 1
    assert W.write_evidence(df.where("fold = 1"), tmp_path / "e.csv").read_text() == "model,fold,split,x\nm,1,test,0.333333333333\n"
    (tmp_path / "c.yaml").write_text("a: 1\n")
    m = W.run_manifest("stage", tmp_path / "c.yaml", [tmp_path / "e.csv"], [tmp_path / "e.csv"], rows=1)
    W.write_manifest(m, tmp_path / "m.json")
    assert W.read_manifest(tmp_path / "m.json", stage="stage")["rows"] == 1
    with pytest.raises(ValueError):
        W.read_manifest(tmp_path / "m.json", stage="other")
    assert {r["status"] for r in A.verify_manifests([tmp_path / "m.json"], "/")} == {"current"}
    assert W.load_yaml(tmp_path / "c.yaml") == {"a": 1}
    (tmp_path / "l.yaml").write_text("- 1\n")
    for bad, error in (("l.yaml", ValueError), ("none.yaml", FileNotFoundError)):
        with pytest.raises(error):
            W.load_yaml(tmp_path / bad)
    assert [p.name for p in W.resolve_sources(["*.json", "*.csv"], tmp_path, ("m",))] == ["e.csv"]
    panel = spark.createDataFrame([("A", datetime(2025, 1, 1))], "symbol string, timestamp timestamp_ntz")
    assert W.panel_manifest(panel)["rows_by_symbol"] == {"A": 1}


def test_release(spark, tmp_path):
    h = "a" * 64
    payload = {"config": "configs/a.yaml", "config_sha256": h, "source_files": {"data/b.csv": h}, "records": [{"path": "c.json", "sha256": h}, {"path": "https://x/y", "sha256": h}], "note_sha256": "short"}
    assert A.hash_references(payload) == [("c.json", h), ("configs/a.yaml", h), ("data/b.csv", h)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.py").write_bytes(b"a\n")
    (tmp_path / "README.md").write_bytes(b"b\r\n/home/me\n")
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe")
    rows = A.inventory(tmp_path, ["src/x.py", "README.md"])
    assert [r["category"] for r in rows] == ["repository", "source"] and A.inventory_digest(rows) == A.inventory_digest(rows[::-1])
    assert A.inventory_digest_column(spark.createDataFrame([(r["path"], r["sha256"]) for r in rows], "path string, sha256 string")).first()[0] == A.inventory_digest(rows)
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in A.text_audit(spark, str(tmp_path / "src/x.py"), str(tmp_path / "README.md"), str(tmp_path / "bin.dat")).collect()}
    assert got == {"x.py": (True, True, False), "README.md": (True, False, True), "bin.dat": (False, True, False)}
    assert A.porcelain_paths(" M a.py\n?? b c.py\nR  old.py -> new.py\n") == ["a.py", "b c.py", "new.py"]
    assert [A.classify_path(p) for p in ("artifacts/evidence/a.csv", "artifacts/reports/r.html", "artifacts/x", "tests/t.py", "scripts/s.py", "configs/c.yaml", "docs/d.md", "")] == ["evidence", "report", "artifact", "test", "script", "configuration", "documentation", "other"]
    with pytest.raises(ValueError):
        A.porcelain_paths(" M\n")
    done = A.audit({"good": lambda: 1, "bad": lambda: 1 / 0})
    assert [r["status"] for r in done] == ["passed", "failed"]


def test_report(spark):
    assert [H.format_value(v) for v in (True, 12345, 1.5, float("nan"), None, "x")] == ["Yes", "12,345", "1.500000", "", "", "x"]
    oos = spark.createDataFrame([("a", 0.1), ("b<", 0.1)], "model string, mean_rank_ic double")
    be = spark.createDataFrame([("a", 1.0), ("b<", 7.0)], "model string, pooled_break_even_cost_bps double")
    bs = spark.createDataFrame([("a", 0.01), ("b<", -0.1)], "model string, confidence_lower double")
    f = H.key_findings(oos, be, bs, 5.0, references=["a"])
    assert [x["model"] for x in f] == ["a", "b<", "b<", None, "a"] and f[3]["value"] == 1
    pf = spark.createDataFrame([("a", 0.2), ("b<", 0.3)], "model string, probability_break_even_above_focus_cost double")
    ab = spark.createDataFrame([("a", "full", 0.0), ("a", "without_x", -0.2), ("b<", "without_y", None)], "model string, variant string, mean_rank_ic_delta_vs_full double")
    more = H.key_findings(oos, be, bs, 5.0, pf, ab, ["a"])
    assert len(more) == 7 and (more[5]["model"], more[6]["variant"]) == ("b<", "without_x")
    rows = H.small_rows(oos, ["model"])
    chart = H.render_bars(rows, "model", "mean_rank_ic", "IC")
    whole = lambda *extra: H.build_report("R & D", [("Executive conclusion", H.render_table(rows, ["model", "mean_rank_ic"])), ("Evidence inventory", chart), *extra])
    page = whole()
    assert "b&lt;" in page and "b<" not in page and page == whole()
    study = H.research_report("All", {"oos_model_metrics": oos}, more, 5.0, ["one < two"], [{"path": "a.csv", "bytes": 3, "sha256": "0"}])
    assert study.count("<h2>") == 12 and "<svg" in study and "one &lt; two" in study and "a.csv" in study
    assert H.best_per_group(oos.selectExpr("*", "1 as h"), ["h"], "mean_rank_ic").first()["model"] == "a"
    with pytest.raises(ValueError, match="outside"):
        whole(("y", "<a href='https://z'>"))
    with pytest.raises(ValueError, match="lacks"):
        H.build_report("x", [("y", "")])
    with pytest.raises(ValueError):
        H.render_table(rows, ["nothing"])


def test_streaming_bars_equal_batch(spark, tmp_path):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, t + timedelta(seconds=13 * i), "AB"[i % 2], float(i % 7 + 1)) for i in range(400)], "event_id long, ts timestamp_ntz, kind string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    make = lambda e: streaming_bars(e, "kind", "ts", "value", F.lit(1.0), ["ts", "event_id"], "5 minutes", "10 minutes")
    query = write_bars_stream(make(read_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "ckpt"), once=True)
    query.awaitTermination(120)
    got = sorted(map(str, spark.read.schema(make(df).schema).parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(str, make(df).collect()))
    assert set(got) <= set(want) and len(got) >= len(want) - 8  # the newest bars stay open until the watermark passes


def test_written_steps(spark):
    from pathlib import Path

    from panelmill.session import drop_written, written

    drop_written(spark)
    df = written(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "step")
    at = Path(df.inputFiles()[0].removeprefix("file://"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "a"), (2, None)] and at.exists() and "FileScan" in df._jdf.queryExecution().toString()
    assert drop_written(spark) == 1 and not at.exists()
