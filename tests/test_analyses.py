import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from panelmill import cli
from panelmill.operators.splits import Fold
from panelmill.plans import analyses as A

T0 = datetime(2025, 1, 1)
N_BARS, SYMBOLS, HOLDING = 900, "ABCDEF", 12
FOLDS = [Fold(1, T0 + timedelta(minutes=5 * 300), T0 + timedelta(minutes=5 * 400), T0 + timedelta(minutes=5 * 640)), Fold(2, T0 + timedelta(minutes=5 * 400), T0 + timedelta(minutes=5 * 640), T0 + timedelta(minutes=5 * 880))]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, s in enumerate(SYMBOLS):
        close = np.exp(np.cumsum(rng.normal(0, 2e-3, N_BARS))) * (10 + k)
        for i in range(N_BARS):
            t, c = T0 + timedelta(minutes=5 * i), float(close[i])
            rows.append((t, t + timedelta(minutes=5) - timedelta(milliseconds=1), s, c * 0.999, c * 1.002, c * 0.998, c, float(rng.random() + 1), float(rng.random() * 100 + 1), int(rng.integers(1, 50)), 0.5, 0.5))
    cols = "timestamp timestamp_ntz, available_time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"
    bars = spark.createDataFrame(rows, cols).cache()
    panel = A.research_panel(bars, FOLDS, HOLDING)["research_panel"].cache()
    base = A.baselines(panel, FOLDS, ["return_1", "return_12", "log_range"], [0.1, 10.0])
    test = base["predictions"].where("split = 'test'").cache()
    return bars, panel, base, test


@pytest.fixture(scope="module")
def study(inputs):
    bars, _, _, test = inputs
    return A.Study(bars, test, FOLDS, holding=HOLDING, top=2, keep=True)


def rows(df):
    return [r.asDict() for r in df.collect()]


def finite(df, *columns):
    out = rows(df)
    assert out and all(r[c] is None or math.isfinite(r[c]) for r in out for c in columns)
    return out


def test_baselines(inputs):
    base = inputs[2]
    assert {r["alpha"] for r in rows(base["model_selection"])} <= {0.1, 10.0}
    got = rows(base["fold_metrics"])
    assert {(r["model"], r["fold"], r["split"]) for r in got} == {(m, f, s) for m in ("momentum", "reversal", "ridge") for f in (1, 2) for s in ("train", "validation", "test")}
    mirror = {(r["model"], r["fold"], r["split"]): r["mean_rank_ic"] for r in got}
    assert mirror["momentum", 1, "test"] == pytest.approx(-mirror["reversal", 1, "test"])


def test_portfolios_and_costs(study):
    s = study
    t = A.evaluate_portfolios(s)
    assert len(rows(t["portfolio_model_comparison"])) == 3 and {r["cohort_count"] for r in rows(t["portfolio_summary"])} == {HOLDING}
    b = A.break_even_costs(s)
    assert len(rows(b["break_even_model_summary"])) == 3 and b["break_even_cost_curve"].count() == 303
    r = A.rebalance_sensitivity(s)
    assert {x["rising_steps"] for x in rows(r["cost_monotonicity"])} == {0} and r["rebalance_phase_map"].count() == 22
    full = {x["model"]: x["pooled_break_even_cost_bps"] for x in rows(b["break_even_model_summary"])}
    one = {x["model"]: x["mean_phase_break_even_cost_bps"] for x in rows(r["rebalance_cadence_summary"].where("cadence_bars = 1 and cost_bps = 0"))}
    assert one == pytest.approx(full)


def test_sensitivities(study):
    s = study
    assert {r["top_count"] for r in rows(A.breadth_sensitivity(s, [1, 2, 3, 8])["breadth_break_even"])} == {1, 2, 3}
    h = A.horizon_sensitivity(s, [3, 12])
    assert h["horizon_break_even"].count() == 6
    plain = {r["model"]: r["mean_rank_ic"] for r in rows(A.evaluate_portfolios(s)["oos_model_metrics"])}
    assert {r["model"]: r["mean_rank_ic"] for r in rows(h["horizon_model_metrics"].where("horizon_bars = 12"))} == pytest.approx(plain)
    d = A.symbol_dependence(s)
    assert d["symbol_exclusion_summary"].count() == 18 and len(rows(d["symbol_dependence_model_summary"])) == 3


def test_stability_and_regimes(study):
    s = study
    assert len(rows(A.temporal_stability(s)["stability_model_summary"])) == 3
    g = A.market_regimes(s)
    out = finite(g["regime_model_summary"], "mean_cell_rank_ic", "mean_break_even_cost_bps")
    assert len(out) == 9 and all(r["worst_cell_rank_ic"] <= r["mean_cell_rank_ic"] for r in out)


def test_nulls_and_bootstrap(study):
    s = study
    for seed in (None, 7):
        out = rows(A.null_tests(s, 6, [-2, 0, 2], seed)["null_test_summary"])
        assert len(out) == 3 and all(1 / 7 <= r["empirical_two_sided_p_value"] <= 1 for r in out)
    t = A.bootstrap_uncertainty(s, [12], [3], 50)
    assert t["bootstrap_prediction_summary"].count() == 3
    assert all(r["break_even_cost_bps_confidence_lower"] <= r["break_even_cost_bps_confidence_upper"] for r in rows(t["bootstrap_portfolio_summary"]))


def test_no_symbol_and_no_model_is_cut(spark, inputs):
    cols = "model string, fold int, timestamp timestamp_ntz, symbol string, target double, prediction double"
    many = spark.createDataFrame([("m", 1, T0, f"S{k:04}", float(k % 7), float(k % 11)) for k in range(1003)], cols)
    ic = A.symbol_dependence(A.Study(inputs[0].limit(0), many))["symbol_exclusion_prediction_metrics"]
    assert {r["excluded_symbol"] for r in ic.select("excluded_symbol").collect()} == {f"S{k:04}" for k in range(1003)}
    models = spark.createDataFrame([(f"M{k:04}", 1, T0 + timedelta(minutes=5 * t), x, float(y), float(y)) for k in range(1002) for t in range(2) for x, y in (("A", 1), ("B", 2))], cols)
    samples = A.bootstrap_uncertainty(A.Study(inputs[0].limit(0), models), [1], [1], 2)["bootstrap_prediction_distribution"]
    assert {(r["model"], r["resample"]) for r in samples.select("model", "resample").collect()} == {(f"M{k:04}", i) for k in range(1002) for i in range(2)}


def test_audit_and_ablations(inputs, study):
    bars, panel, _, _ = inputs
    a = A.label_audit(study, panel)
    assert all(r["max_label_end_error_us"] == 0 and r["max_raw_target_abs_error"] == 0 for r in rows(a["alignment_symbol_metrics"]))
    assert a["target_differences"].count() == 0
    ab = A.ablations(study, {"returns": ["return_1", "return_12"], "range": ["log_range"]}, panel, trees=2)
    want = {(m, v) for m in ("ridge", "boosted_trees") for v in ("full", "without_returns", "without_range")}
    got = {(r["model"], r["variant"]): r for r in rows(ab["ablation_model_summary"])}
    assert set(got) == want and got["ridge", "full"]["rmse_delta_vs_full"] == 0 and all(r["cohort_count"] == HOLDING for r in got.values())
    assert ab["ablation_cohort_differences"].count() == 0
    alone = A.P.portfolio_periods(A.P.rank_weights(A.X.with_execution(ab["ablation_predictions"].where("model = 'ridge' and variant = 'without_range'"), bars, HOLDING), 2, ["model"]), study.interval, HOLDING, ["model"])
    one = rows(A.C.sensitivity_break_even(A.P.cohort_metrics(alone, study.costs, study.annual), ["model"]))[0]
    assert got["ridge", "without_range"]["pooled_break_even_cost_bps"] == pytest.approx(one["pooled_break_even_cost_bps"])
    e = A.evaluate_portfolios(study)["oos_model_metrics"]
    be = A.break_even_costs(study)["break_even_model_summary"]
    fam = rows(A.family_summary(e, be, e.select("model", e.mean_rank_ic.alias("confidence_lower")), {"momentum": "rule", "reversal": "rule", "ridge": "linear"}, ["reversal"]))
    assert {r["model"]: r["rank_ic_delta_vs_reversal"] for r in fam}["reversal"] == 0


def test_boosting_and_networks_score_every_row(inputs):
    _, panel, _, _ = inputs
    features = ["return_1", "return_12", "log_range"]
    b = A.baselines(panel, FOLDS, features, [1.0], trees=2)
    assert {(r["model"], r["split"]) for r in rows(b["summary"])} >= {("boosted_trees", s) for s in ("train", "validation", "test")}
    labelled = panel.count()
    for kind, extra in (("mlp", {}), ("tcn", {"length": 8, "channels": 4}), ("transformer", {"length": 8, "dim": 8, "inner": 8, "layers": 1})):
        t = A.neural(panel, FOLDS[:1], kind, features, epochs=2, **extra)
        got = rows(t["fold_metrics"])
        assert {(r["model"], r["fold"], r["split"]) for r in got} == {(kind, 1, "validation"), (kind, 1, "test")} and t["training_history"].count() == 2
        expected = A.L.assign_folds(panel, FOLDS[:1]).where("split = 'test'").count()
        assert [r["n_rows"] for r in got if r["split"] == "test"] == [expected] and labelled > expected
        if kind != "mlp":
            assert {r["split"] for r in rows(t["endpoint_coverage"])} == {"train", "validation", "test"}
    q = A.sequence_audit(panel, FOLDS, features, 8)
    assert q["sequence_shape_violations"].where("violations > 0").count() == 0 and q["sequence_endpoint_metrics"].count() == 6


def test_analyses_that_need_the_panel_say_so(study):
    with pytest.raises(ValueError, match="panel"):
        A.label_audit(study)


def test_release_of_persisted_steps(inputs):
    bars, _, _, test = inputs
    s = A.Study(bars, test, FOLDS, holding=HOLDING, top=2, keep=True)
    assert s.joined.is_cached
    s.release()
    assert not s.joined.is_cached


def test_command_line(spark, inputs, tmp_path):
    bars, _, _, _ = inputs
    bars.write.parquet(str(tmp_path / "bars"))
    zoned = lambda t: f"{t}+00:00"
    folds = "".join(f"  - {{fold: {f.fold}, train_end: '{zoned(f.train_end)}', validation_end: '{zoned(f.validation_end)}', test_end: '{zoned(f.test_end)}'}}\n" for f in FOLDS)
    config = tmp_path / "c.yaml"
    settings = f"bars: {tmp_path}/bars\npredictions: {tmp_path}/predictions\noutput: {tmp_path}/out\npanel: {tmp_path}/panel\nmanifest: {tmp_path}/m.json\nreport: {tmp_path}/r.html\naudit: {tmp_path}/a.json\ntop: 2\nlength: 8\n"
    models = "baselines: {features: [return_1, return_12, log_range], alphas: [1.0]}\nmlp: {features: [return_1, return_12], epochs: 1}\nbootstrap_uncertainty: {lengths: [12], period_lengths: [3], resamples: 20}\n"
    families = "ablations: {families: {returns: [return_1, return_12], range: [log_range]}}\nlimitations: [synthetic bars]\nexpected_symbols: 6\n"
    config.write_text(settings + models + families + f"folds:\n{folds}")
    run = lambda *a: cli.main([a[0], "--config", str(config), *a[1:]])
    assert run("panel") == 0 and '"source_files"' in (tmp_path / "m.json").read_text()
    assert run("predict", "baselines", "mlp") == 0 and '"rows"' in (tmp_path / "out/predict_manifest.json").read_text()
    assert run("analyze", "evaluate_portfolios", "break_even_costs", "bootstrap_uncertainty", "market_regimes", "ablations", "label_audit") == 0
    assert (tmp_path / "out/portfolio_summary.csv").read_text().count("\n") == 21
    for large in ("regime_assignments", "bootstrap_prediction_distribution", "bootstrap_portfolio_distribution", "ablation_predictions"):  # none is left out
        assert spark.read.parquet(str(tmp_path / f"out/{large}")).count() > 0
    assert run("sequences") == 0 and (tmp_path / "out/sequence_endpoint_metrics.csv").exists()
    assert run("report") == 0
    page = (tmp_path / "r.html").read_text()
    assert page.count("<h2>") == 12 and "synthetic bars" in page and "largest loss of mean rank IC" in page and page.count("<svg") >= 2
    assert run("report") == 0 and (tmp_path / "r.html").read_text() == page
    import json

    root = tmp_path / "release"
    (root / "src").mkdir(parents=True)
    (root / "src/x.py").write_text("x = 1\n")
    (root / "c.json").write_text("{}\n")
    import subprocess

    for a in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(root), *a], check=True)
    assert run("audit", "--root", str(root)) == 0
    checks = {r["check"]: r for r in json.loads((tmp_path / "a.json").read_text())["checks"]}
    assert len(checks) >= 15 and checks["texts are UTF-8"]["status"] == "passed" and checks["work tree is clean"]["status"] == "passed"
    (root / "src/x.py").write_text("x = (\n")
    assert run("audit", "--root", str(root)) == 1


def test_prediction_reader(spark, inputs, tmp_path):
    from panelmill.sources import readers, sinks

    _, _, base, _ = inputs
    record = sinks.write_predictions(base["predictions"], str(tmp_path / "p"))
    assert record["rows"] == base["predictions"].count() and len(record["sha256"]) == 64
    one = readers.read_fold(spark, str(tmp_path / "p"), "ridge", 2)
    assert {(r["model"], r["fold"], r["split"]) for r in one.select("model", "fold", "split").distinct().collect()} == {("ridge", 2, "test")}
    assert "PartitionFilters: [isnotnull(model" in one._jdf.queryExecution().toString()
    base["predictions"].where("model = 'ridge'").limit(3).write.partitionBy("model", "fold", "split").mode("append").parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="duplicate_keys"):
        readers.read_predictions(spark, str(tmp_path / "p"), split=None)
    with pytest.raises(ValueError, match="empty"):
        readers.read_predictions(spark, str(tmp_path / "p"), ["none"])
    csv = sinks.write_evidence(base["summary"], tmp_path / "s.csv")
    schema = base["summary"].schema
    back = readers.read_evidence(spark, csv, schema, ["model", "split"])
    assert back.count() == base["summary"].count() and back.dtypes == base["summary"].dtypes
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_evidence(spark, csv, "model string, other string, " + ", ".join(f"c{i} double" for i in range(len(schema) - 2))).collect()
