import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import bars as B
from panelmill.operators import checks as K
from panelmill.operators import features as X
from panelmill.operators import models as M
from panelmill.operators import regimes as G
from panelmill.operators import resample as Z
from panelmill.operators import scaling as N
from panelmill.operators import sequences as E
from panelmill.operators import splits as L
from panelmill.operators import xsection as R

MIN5 = 5 * 60_000_000
T0 = datetime(2026, 1, 1)
BAR = "timestamp timestamp_ntz, available_time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"


def bar_rows(n=100, symbol="A", base=100.0, factor=lambda i: 1.0):
    out = []
    for i in range(n):
        c, k = base + 0.1 * i, factor(i)
        t = T0 + timedelta(minutes=5 * i)
        out.append((t, t + timedelta(minutes=5) - timedelta(milliseconds=1), symbol, (c - 0.02) * k, (c + 0.05) * k, (c - 0.05) * k, c * k, 100.0 + i, (100.0 + i) * c, 50 + i, 40.0, 40.0 * c))
    return out


def make(spark, rows):
    return spark.createDataFrame(rows, BAR)


def test_features_do_not_look_ahead(spark):
    a, b = (X.symbol_features(make(spark, bar_rows(factor=f))).orderBy("timestamp").collect() for f in (lambda i: 1.0, lambda i: 10.0 if i > 70 else 1.0))
    assert [r.asDict() for r in a[:71]] == [r.asDict() for r in b[:71]] and a[80]["return_12"] != b[80]["return_12"]
    assert all(r["return_48"] is None for r in a[:48]) and a[48]["return_48"] == pytest.approx(math.log(104.8 / 100))


def test_neutral_ratio_and_constant_zscore(spark):
    rows = [(*r[:7], 1.0, 0.0, 1, 0.0, 0.0) for r in bar_rows()]
    out = X.symbol_features(make(spark, rows)).collect()
    assert {r["taker_buy_ratio"] for r in out} == {0.5} and {r["volume_zscore_48"] for r in out} == {None}


def test_labels(spark):
    rows = bar_rows(80) + bar_rows(80, "B", 200.0)
    out = X.forward_targets(make(spark, rows), 12, MIN5)
    first = out.where("symbol = 'A'").orderBy("timestamp").first()
    assert first["raw_target"] == pytest.approx(math.log(101.2 / 100)) and first["label_end_timestamp"] == T0 + timedelta(hours=1)
    assert out.groupBy("timestamp").agg(F.abs(F.avg("target")).alias("m")).agg(F.max("m")).first()[0] < 1e-12
    assert out.where("raw_target is null").count() == 24
    gap = [r for r in bar_rows(40) if r[0] != T0 + timedelta(minutes=100)]
    assert X.forward_targets(make(spark, gap), 12, MIN5).where("raw_target is not null").count() == 39 - 12 - 12


def test_bar_rules_each_trigger(spark):
    good = bar_rows(5)
    B.require_valid(B.validate_bars(make(spark, good), MIN5))
    breaks = {
        "null_value": (6, None), "non_finite": (7, float("inf")), "price_not_positive": (5, -1.0), "negative_activity": (9, -1),
        "high_too_low": (4, 98.0), "low_too_high": (5, 100.04), "available_before_start": (1, T0 - timedelta(1)), "longer_than_interval": (1, T0 + timedelta(minutes=6)),
    }
    for rule, (at, value) in breaks.items():
        row = [*good[0]]
        row[at] = value
        with pytest.raises(ValueError, match=rule):
            B.require_valid(B.validate_bars(make(spark, [tuple(row), *good[1:]]), MIN5))
    with pytest.raises(ValueError, match="duplicate_rows"):
        B.require_valid(B.validate_bars(make(spark, [*good, good[2]]), MIN5))
    with pytest.raises(ValueError, match="no bars"):
        B.require_valid(B.validate_bars(make(spark, []), MIN5))
    assert B.validate_bars(make(spark, [good[0], good[3]]), MIN5).first()["missing_intervals"] == 2


def test_purge_counts(spark):
    rows = [(T0 + timedelta(minutes=5 * i), T0 + timedelta(minutes=5 * i + 60)) for i in range(48)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, label_end_timestamp timestamp_ntz")
    fold = L.Fold(1, T0 + timedelta(minutes=55 + 60), T0 + timedelta(minutes=115 + 60), T0 + timedelta(minutes=235))
    r = L.fold_summary(df, [fold]).first()
    assert (r["train_purged"], r["validation_purged"], r["test_purged"]) == (12, 12, 12)
    splits = {x["split"]: x["count"] for x in L.assign_folds(df, [fold]).groupBy("split").count().collect()}
    assert splits["purged"] == 36 and sum(splits.values()) == 48
    with pytest.raises(ValueError):
        L.Fold(1, T0, T0, T0)


def test_fold_boundaries_are_utc():
    f = L.Fold.parse(1, "2026-01-01T02:00+02:00", "2026-01-01 01:00:00+00:00", "2025-12-31T22:00:00-05:00")
    assert (f.train_end, f.validation_end, f.test_end) == (T0, T0 + timedelta(hours=1), T0 + timedelta(hours=3))
    with pytest.raises(ValueError, match="zone"):
        L.Fold.parse(1, "2026-01-01", "2026-01-02", "2026-01-03")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=5001), "b": np.repeat([1.0, 2.0], 300), "c": np.array([7.0]), "d": np.array([1.0, 2, 4])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, v double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {(r["k"], r["p"]): r["quantile"] for r in N.exact_quantiles(df, ["k"], "v", ps).collect()}
    assert len(got) == 4 * len(ps)
    for k, v in values.items():
        for p in ps:
            assert got[k, p] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)
    nameless = df.where("k in ('a', 'd')").withColumn("k", F.nullif("k", F.lit("a")))
    again = {(r["k"], r["p"]): r["quantile"] for r in N.exact_quantiles(nameless, ["k"], "v", [0.25]).collect()}
    assert again == {(None, 0.25): pytest.approx(float(np.quantile(values["a"], 0.25))), ("d", 0.25): 1.5}
    assert N.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    assert N.exact_quantiles(df, [], "v", [0.5]).first()["quantile"] == pytest.approx(float(np.median(np.concatenate([*values.values()]))))


def test_scaler_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0)], "fold int, x double, c double")
    s = N.fit_robust_scaler(df, ["x", "c"])
    assert {r["feature"]: (r["median"], r["scale"]) for r in s.collect()} == {"x": (2.0, 1.0), "c": (5.0, 1.0)}
    out = N.apply_robust_scaler(spark.createDataFrame([(1, 100.0, 5.0)], "fold int, x double, c double"), s, ["x", "c"]).first()
    assert out["x"] == 98.0 and out["c"] == 0.0


def scored(spark, flip):
    rows = [("m", T0 + timedelta(hours=h), s, float(t), float(-t if flip else t) if h or not flip else float(-t)) for h in range(3) for s, t in zip("ABC", (-1, 0, 1))]
    return spark.createDataFrame(rows, "model string, timestamp timestamp_ntz, symbol string, target double, prediction double")


def test_rank_ic(spark):
    for flip, want in ((False, 1.0), (True, -1.0)):
        r = R.summarize_predictions(scored(spark, flip)).first()
        assert r["mean_rank_ic"] == want and r["n_rows"] == 9 and r["n_timestamps"] == 3 and r["rank_ic_ir"] is None
    nameless = R.summarize_predictions(scored(spark, False).withColumn("model", F.lit(None).cast("string"))).collect()
    assert [(r["model"], r["n_rows"], r["rmse"]) for r in nameless] == [(None, 9, 0.0)]
    flat = scored(spark, False).withColumn("prediction", F.lit(1.0))
    r = R.summarize_predictions(flat).first()
    assert r["mean_rank_ic"] is None and r["n_timestamps"] == 3
    assert {x["rank_ic"] for x in R.rank_ic(flat).collect()} == {None}
    tied = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (3.0, "c"), (4.0, "d"), (None, "e")], "v double, s string")
    assert [x[0] for x in tied.select(R.average_rank("v", []), "s").orderBy("s").collect()] == [1.5, 1.5, 3.0, 4.0, None]


def test_regime_bounds_are_inclusive_below(spark):
    df = spark.createDataFrame([(v,) for v in (-2.0, -1.0, 0.0, 1.0, 2.0)], "v double")
    assert [r[0] for r in df.select(G.three_way(F.col("v"), F.lit(-1.0), F.lit(1.0))).collect()] == ["low", "low", "medium", "medium", "high"]


def test_regime_thresholds_come_from_calibration(spark):
    rows = [(T0 + timedelta(hours=i), *([float(v)] * 3)) for i, v in enumerate([0, 1, 2, 3, 4, 5, 6, 7, -50, 8, 10, 20])]
    states = spark.createDataFrame(rows, "timestamp timestamp_ntz, market_return double, market_realized_volatility double, cross_sectional_dispersion double")
    fold = [L.Fold(1, T0, T0 + timedelta(hours=7), T0 + timedelta(hours=11))]
    t = G.regime_thresholds(states, fold)
    assert t.first()["market_return_lower"] == pytest.approx(np.quantile(np.arange(8), 1 / 3))
    long = G.melt_regimes(G.assign_regimes(states, t, fold))
    assert long.count() == 12 and {r["regime"] for r in long.collect()} == {"low", "high"}
    with pytest.raises(ValueError):
        G.regime_thresholds(states, fold, 0.7, 0.3)


def test_market_state(spark):
    rows = []
    for s, ps in (("A", (100, 101, 102, 104, 108)), ("B", (100, 99, 98, 97, 96))):
        rows += [(T0 + timedelta(minutes=5 * i), s, float(p)) for i, p in enumerate(ps)]
    out = G.market_state(spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, close double"), 2).orderBy("timestamp").collect()
    assert len(out) == 3 and out[0]["timestamp"] == T0 + timedelta(minutes=10)
    assert out[0]["market_return"] == pytest.approx((math.log(1.02) + math.log(0.98)) / 2)


def test_series_shorter_than_a_block_has_no_bootstrap(spark):
    rows = [("short", i, 1.0) for i in range(4)] + [("long", i, 1.0) for i in range(7)]
    got = Z.md5_block_bootstrap(spark.createDataFrame(rows, "model string, timestamp int, v double"), "v", 6, 3, 7, ["model"]).collect()
    assert sorted((r["model"], r["resample"], r["mean_value"]) for r in got) == [("long", i, 1.0) for i in range(3)]


def test_partial_block_is_drawn(spark):
    import hashlib

    v, length, n = [float(x * x) for x in range(11)], 4, 11
    df = spark.createDataFrame([(None, T0 + timedelta(hours=i), x) for i, x in enumerate(v)], "model string, timestamp timestamp_ntz, v double")
    draw = lambda r, b: int(hashlib.md5(f"7|{r}|{b}".encode()).hexdigest()[:7], 16) % n
    want = {r: sum(v[(draw(r, b) + i) % n] for b in (0, 1) for i in range(length)) + sum(v[(draw(r, "rest") + i) % n] for i in range(3)) for r in range(5)}
    got = {r["resample"]: r["mean_value"] * n for r in Z.md5_block_bootstrap(df, "v", length, 5, 7, ["model"]).collect()}
    assert got == pytest.approx(want)


def test_seeded_permutations_follow_one_matrix(spark):
    rng = np.random.default_rng(8)
    p, t = rng.normal(size=(6, 5)), rng.normal(size=(6, 5))
    rows = [(m, 3, T0 + timedelta(hours=h), s, float(t[h, i]), float(p[h, i] * (1 if m == "m" else -1))) for m in "mn" for h in range(6) for i, s in enumerate("ABCDE")]
    df = spark.createDataFrame(rows, "model string, fold int, timestamp timestamp_ntz, symbol string, target double, prediction double")
    got = {(r["model"], r["permutation"]): r["mean_rank_ic"] for r in Z.seeded_permutation_ic(df, 4, 42).collect()}
    rank = lambda x: x.argsort(axis=1).argsort(axis=1).astype(float)
    for k in range(4):
        order = np.argsort(np.random.default_rng(np.random.SeedSequence([42, k, 3])).random((6, 5)), axis=1, kind="stable")
        mixed = np.take_along_axis(rank(t), order, axis=1)
        want = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(rank(p), mixed)])
        assert got["m", k] == pytest.approx(want) and got["n", k] == pytest.approx(-want)
    short = Z.seeded_permutation_ic(df.where("not (symbol = 'A' and timestamp = '2026-01-01 00:00:00')"), 1, 42).first()
    assert short["n_timestamps"] == 5


def test_bootstrap():
    assert np.allclose(Z.bootstrap_means(np.full((24, 1), 3.5), 50, 6, 1), 3.5)
    x = np.arange(30.0)
    a, b = (Z.bootstrap_means(np.stack([x, 2 * x], 1), 300, 7, 11) for _ in range(2))
    assert np.array_equal(a, b) and np.allclose(a[:, 1], 2 * a[:, 0])
    assert Z.block_sums(x[:, None], 3)[-1, 0] == 29 + 0 + 1
    with pytest.raises(ValueError):
        Z.bootstrap_means(x[:, None], 1, 31, 0)


def test_bootstrap_skips_undefined(spark):
    rows = [("m", T0 + timedelta(hours=i), 2.0 if i % 3 else None, 5) for i in range(24)]
    out = Z.seeded_block_bootstrap(spark.createDataFrame(rows, "model string, timestamp timestamp_ntz, ic double, seed int"), ["ic"], 4, 40, "seed", ["model"]).collect()
    assert len(out) == 40 and {r["ic"] for r in out} == {2.0}


def test_p_value(spark):
    nulls = spark.createDataFrame([("m", x) for x in (-0.2, -0.1, 0.0, 0.1, 0.2)], "model string, mean_rank_ic double")
    r = Z.null_summary(nulls, spark.createDataFrame([("m", 0.15)], "model string, observed_mean_rank_ic double")).first()
    assert r["empirical_two_sided_p_value"] == pytest.approx(3 / 6)


def test_permutation_keeps_the_targets(spark):
    out = Z.permuted_ic(scored(spark, False), 8).collect()
    assert len(out) == 8 and all(-1 <= r["mean_rank_ic"] <= 1 for r in out) and {r["n_timestamps"] for r in out} == {3}


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(x, y)], "fold int, a double, b double, c double, target double")
    got = M.fit_ridge(df, ["a", "b", "c"], [10.0])[1, 10.0]
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ (y - y.mean()))
    assert [got[k] for k in "abc"] == pytest.approx(list(want)) and got["1"] == pytest.approx(y.mean() - x.mean(0) @ want)
    assert M.score_by_fold(df, {(1, 10.0): got}).first()["prediction"] == pytest.approx(float(got["1"] + x[0] @ want))
    with pytest.raises(ValueError):
        M.fit_ridge(df, ["a"], [0.0])


def test_boosted_trees_stop_early(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(a > 0)) for a in rng.normal(size=120)], "a double, target double")
    model = M.fit_boosted_trees(df, df, ["a"], iterations=5, depth=2)
    assert model.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2))).first()[0] < 0.05


def test_families():
    fam = {"first": ["a", "b"], "second": ["c", "d"]}
    assert M.leave_one_family_out("abcd", fam) == {"full": list("abcd"), "without_first": ["c", "d"], "without_second": ["a", "b"]}
    for features, families, word in (("aab", {"x": "ab"}, "duplicate"), ("ab", {"x": "abz"}, "unknown"), ("ab", {"x": "ab", "y": "b"}, "multiple"), ("abc", {"x": "ab"}, "no family")):
        with pytest.raises(ValueError, match=word):
            M.check_families(features, families)


def test_first_best_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(1, 0.1, 0.5), (1, 1.0, 0.5), (1, 10.0, None)], "fold int, alpha double, m double")
    assert M.first_best(df, "m", ["fold"]).first()["alpha"] == 0.1


def test_first_best_sees_no_order_of_summation(spark):
    means = [0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1]  # differ in the last digit
    assert means[0] != means[1]
    rows = [(1, 0.1, min(means)), (1, 1.0, max(means)), (1, 10.0, None), (2, 0.1, 0.5), (2, 1.0, 0.5 + 1e-9), (3, 1.0, None), (3, 0.1, None), (4, 0.1, float("nan")), (4, 1.0, -0.2)]
    got = M.first_best(spark.createDataFrame(rows, "fold int, alpha double, m double"), "m", ["fold"])
    assert got.columns == ["fold", "alpha", "m"] and {r["fold"]: r["alpha"] for r in got.collect()} == {1: 0.1, 2: 1.0, 3: 0.1, 4: 1.0}


def test_sequences(spark):
    rows = [(T0 + timedelta(minutes=5 * t), s, 0.0, float(10 * t + i), float(100 * t + i), "test" if t != 5 or s == "A" else "purged") for t in range(8) for i, s in enumerate("AB")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, target double, f1 double, f2 double, split string")
    ends = E.sequence_endpoints(df, 3)
    assert [r["position"] for r in ends.orderBy("timestamp").collect()] == [2, 3, 4, 5, 6, 7]
    assert [r["position"] for r in E.sequence_endpoints(df, 3, "test").orderBy("timestamp").collect()] == [2, 3, 4, 6, 7]
    w = E.sequence_windows(df, ["f1", "f2"], 3, E.subsample_endpoints(ends, 2)).orderBy("timestamp", "symbol").collect()
    assert len(w) == 6 and w[1]["window"] == [[1.0, 1.0], [11.0, 101.0], [21.0, 201.0]]


def test_positions_across_months(spark):
    stamps = [T0 + timedelta(days=9 * i) for i in range(12)]
    df = spark.createDataFrame([(t,) for t in stamps] * 2, "timestamp timestamp_ntz")
    assert [r["position"] for r in E.timestamp_positions(df).orderBy("timestamp").collect()] == list(range(12))


def test_panel_gates(spark):
    rows = [(T0 + timedelta(minutes=5 * t), T0 + timedelta(minutes=5 * t + 5), T0 + timedelta(minutes=5 * t + 10), T0 + timedelta(minutes=5 * t + 15), s, float(t), float(i), i - 0.5, "train") for t in range(4) for i, s in enumerate("AB")]
    cols = "timestamp timestamp_ntz, available_time timestamp_ntz, label_end_timestamp timestamp_ntz, label_end_time timestamp_ntz, symbol string, f double, raw_target double, target double, split string"
    good = spark.createDataFrame(rows, cols)
    assert X.finalize_panel(good, ["f"], 2).count() == 8 and X.finalize_panel(good, ["f"], 2).schema["f"].dataType.simpleString() == "float"
    first = F.col("timestamp") == F.lit(str(T0)).cast("timestamp_ntz")
    for name, bad in {
        "repeated_keys": good.union(good.limit(1)), "features_not_finite": good.withColumn("f", F.when(first, float("inf")).otherwise(F.col("f"))), "incomplete_cross_sections": good.where(~(first & (F.col("symbol") == "A"))),
        "targets_not_centred": good.withColumn("target", F.col("target") + F.when(first, 1e-9).otherwise(0.0)), "available_after_label_end": good.withColumn("available_time", F.col("label_end_time") + F.expr("interval 1 second")), "empty": good.limit(0),
        "targets_not_finite": good.withColumn("raw_target", F.when(first, float("inf")).otherwise(F.col("raw_target"))),
    }.items():
        with pytest.raises(ValueError, match=name):
            X.finalize_panel(bad, ["f"], 2)
    shape = lambda d: {r["check"] for r in E.panel_shape_violations(d, ["f"], MIN5).where("violations > 0").collect()}
    assert shape(good) == set() and shape(good.where(~first | (F.col("symbol") == "B"))) == {"incomplete_sections"} and shape(good.limit(0)) == {"empty"}
    assert shape(good.where(~(F.col("f") == 2))) == {"off_grid"}
    cover = {r["split"]: r for r in E.endpoint_coverage(good, 2).collect()}
    assert cover["train"]["endpoints"] == 3 and cover["train"]["excluded_for_history"] == 1 and cover["train"]["first_endpoint"] == T0 + timedelta(minutes=5)


def test_no_prediction_is_lost_in_the_join(spark):
    bars = make(spark, bar_rows(30))
    scores = lambda i: spark.createDataFrame([(T0 + timedelta(minutes=5 * i), "A", 1.0)], "timestamp timestamp_ntz, symbol string, prediction double")
    assert X.with_execution(scores(3), bars, 12).first()["execution_return"] is not None
    with pytest.raises(Exception, match="no execution return"):
        X.with_execution(scores(25), bars, 12).collect()


def test_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5)], "k int, v double")
    K.require_reproduced(K.reproduction_error(a, a, ["k"], ["v"]), 1e-12)
    with pytest.raises(ValueError, match="not reproduced"):
        K.require_reproduced(K.reproduction_error(a, b, ["k"], ["v"]), 1e-12)
    with pytest.raises(ValueError, match="keys differ"):
        K.require_reproduced(K.reproduction_error(a, b.where("k = 1"), ["k"], ["v"]), 1.0)
    with pytest.raises(ValueError, match="duplicate keys"):
        K.safe_join(a, b.union(b), ["k"])
    with pytest.raises(ValueError, match="lacks columns"):
        K.require_columns(a, ["z"])
    assert [(r["k"], r["side"]) for r in K.key_differences(a, b.where("k = 1"), ["k"]).collect()] == [(2, "missing")]
    bad = scored(spark, False).union(scored(spark, False).limit(1)).withColumn("prediction", F.when(F.col("symbol") == "A", F.lit(float("nan"))).otherwise(F.col("prediction")))
    got = {r["check"]: r["violations"] for r in K.validate_predictions(bad).collect()}
    assert got["empty"] == 0 and got["not_finite"] >= 3 and got["duplicate_keys"] == 1


def test_positive_distinct():
    assert K.positive_distinct([12, 3, 3]) == [3, 12]
    for bad in ([], [0], [-1, 2], [1.5], [True]):
        with pytest.raises(ValueError):
            K.positive_distinct(bad)


def test_cohort_and_coverage_violations(spark):
    rows = [("m", c, 10, 1e-4, 1.0) for c in (0, 1, 1, 5)] + [("m", 2, 0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "model string, cohort int, period_count bigint, gross_mean_return double, mean_turnover double")
    assert K.cohort_violations(df, 4).first()[1:] == (1, 1, 1, 1)
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = K.coverage_violations(spark.createDataFrame([(1,), (1,), (2,)], "k int"), keys, ["k"], 2).collect()
    assert sorted((r["k"], r["assigned_rows"]) for r in got) == [(2, 1), (3, 0)]


def test_flagship_plan_stays_in_the_jvm(spark):
    from panelmill.plans import flagship

    plan = flagship.evaluate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") <= 10


def test_scans_prune_columns(spark):
    from panelmill.plans import study

    plan = study.bars(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan.split("ReadSchema")[1]
