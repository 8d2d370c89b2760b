"""The analyses of a study on any inputs: prediction and bar tables in, named result tables out.

Each takes a ``Study`` and returns lazy DataFrames by name; nothing runs until one is written.  The
expensive shared steps (predictions joined with execution returns, portfolio periods) are built once per
``Study``; with ``keep`` they are persisted across the tables of an analysis until ``release``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import bars as B
from panelmill.operators import checks as K
from panelmill.operators import costs as C
from panelmill.operators import features as X
from panelmill.operators import models as M
from panelmill.operators import networks as W
from panelmill.operators import portfolio as P
from panelmill.operators import rebalance as Y
from panelmill.operators import regimes as G
from panelmill.operators import resample as Z
from panelmill.operators import scaling as N
from panelmill.operators import sensitivity as S
from panelmill.operators import sequences as E
from panelmill.operators import splits as L
from panelmill.operators import stability as T
from panelmill.operators import xsection as R

MINUTE = 60_000_000
Tables = dict[str, DataFrame]


@dataclass
class Study:
    """Inputs and settings of an evaluation.

    ``bars``: timestamp, symbol, open, close (more for panels); ``predictions``: model, fold, timestamp,
    symbol, target, prediction (test rows).  ``panel`` (features, labels) is for the audits and models.
    """

    bars: DataFrame
    predictions: DataFrame
    folds: Sequence[L.Fold] = ()
    interval_minutes: int = 5
    holding: int = 12
    top: int = 4
    costs: list[float] = field(default_factory=lambda: [0.0, 1.0, 2.0, 5.0, 10.0])
    focus: float = 5.0
    keep: bool = False
    panel: DataFrame | None = None
    _held: list[DataFrame] = field(default_factory=list)

    @property
    def interval(self) -> int:
        return self.interval_minutes * MINUTE

    @property
    def annual(self) -> float:
        return S.annual_periods(self.interval_minutes, self.holding)

    def persisted(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        """Let go of what was persisted."""
        while self._held:
            self._held.pop().unpersist()

    @cached_property
    def joined(self) -> DataFrame:
        return self.persisted(X.with_execution(self.predictions, self.bars, self.holding))

    @cached_property
    def weighted(self) -> DataFrame:
        return P.rank_weights(self.joined, self.top, ["model"])

    @cached_property
    def periods(self) -> DataFrame:
        return self.persisted(P.portfolio_periods(self.weighted, self.interval, self.holding, ["model"]))

    @cached_property
    def metrics(self) -> DataFrame:
        return P.cohort_metrics(self.periods, self.costs, self.annual)

    @cached_property
    def cohorts(self) -> DataFrame:
        return C.break_even_cohorts(self.metrics, self.annual)

    @cached_property
    def dated(self) -> DataFrame:
        when = self.predictions.select("timestamp", "fold").distinct()
        return self.periods.join(when, "timestamp").withColumn("month", T.month())


def evaluate_portfolios(s: Study) -> Tables:
    oos, summary = R.summarize_predictions(s.predictions), P.portfolio_summary(s.metrics)
    return {"oos_model_metrics": oos, "portfolio_cohort_metrics": s.metrics, "portfolio_summary": summary, "portfolio_model_comparison": P.model_comparison(oos, summary, [0.0, s.focus])}


def null_tests(s: Study, permutations: int = 50, shifts: Sequence[int] = (-48, -24, -12, -6, 0, 6, 12, 24, 48), seed: int | None = None) -> Tables:
    """Permutations from md5 draws, or from NumPy's stream when a seed is given."""
    observed = R.summarize_predictions(s.predictions).select("model", F.col("mean_rank_ic").alias("observed_mean_rank_ic"))
    if seed is None:
        nulls = Z.permuted_ic(s.predictions, permutations)
    else:
        by_fold = Z.seeded_permutation_ic(s.predictions, permutations, seed)
        weight = F.col("mean_rank_ic") * F.col("n_timestamps")
        nulls = by_fold.groupBy("model", "permutation").agg((F.sum(weight) / F.sum("n_timestamps")).alias("mean_rank_ic"), F.sum("n_timestamps").alias("n_timestamps"))
    by_shift = R.shift_summary(R.shifted_rank_ic(s.predictions, list(shifts)))
    return {"null_permutation_metrics": nulls, "null_test_summary": Z.null_summary(nulls, observed), "null_time_shift_metrics": by_shift, "identity": K.identity_error(s.predictions)}


def _panel(s: Study) -> DataFrame:
    if s.panel is None:
        raise ValueError("this analysis needs the panel")
    return s.panel


def label_audit(s: Study, panel: DataFrame | None = None) -> Tables:
    """Labels against a reference rebuilt from bars, split coverage, and the targets that predictions were scored on."""
    panel = panel if panel is not None else _panel(s)
    reference = S.horizon_reference(s.bars, [s.holding], s.interval)
    rows = L.split_audit(L.assign_folds(panel, s.folds))
    execution = K.execution_alignment(s.predictions, reference) if {"raw_target", "label_end_timestamp"} <= set(s.predictions.columns) else None
    return {"alignment_symbol_metrics": K.alignment_audit(panel, reference), "alignment_split_metrics": rows, "model_alignment": K.model_alignment(s.predictions), "target_differences": K.target_differences(s.predictions, panel)} | ({"alignment_execution_metrics": execution} if execution is not None else {})


def break_even_costs(s: Study, start: float = 0.0, end: float = 10.0, step: float = 0.1) -> Tables:
    return {
        "break_even_cohort_metrics": s.cohorts,
        "break_even_model_summary": C.break_even_summary(s.cohorts, s.annual, s.costs),
        "break_even_cost_curve": C.cost_curve(s.cohorts, C.cost_grid(start, end, step), s.annual),
    }


def rebalance_sensitivity(s: Study, cadences: Sequence[int] = (1, 3, 6, 12)) -> Tables:
    phases = Y.phase_metrics(s.cohorts, list(cadences), s.costs, s.holding, s.annual)
    spark = s.bars.sparkSession
    return {
        "rebalance_phase_map": Y.phase_map(spark, list(cadences), s.holding, s.interval_minutes),
        "rebalance_phase_metrics": phases,
        "rebalance_cadence_summary": Y.cadence_summary(phases),
        "cost_monotonicity": K.cost_monotonicity(phases, ["model", "cadence_bars", "phase"]),
    }


def breadth_sensitivity(s: Study, tops: Sequence[int] = (1, 2, 3, 4, 5, 6, 8, 10)) -> Tables:
    keys = ["model", "top_count"]
    metrics = P.cohort_metrics(S.breadth_periods(s.joined, list(tops), s.interval, s.holding), s.costs, s.annual, keys)
    return {"breadth_cohort_metrics": metrics, "breadth_summary": P.portfolio_summary(metrics, keys), "breadth_break_even": C.sensitivity_break_even(metrics, keys)}


def horizon_sensitivity(s: Study, horizons: Sequence[int] = (3, 6, 12, 24)) -> Tables:
    """A horizon is its own holding period, so each has its own cohorts and annualisation; the reference is built once."""
    keys = ["model", "horizon_bars"]
    reference = S.horizon_targets(S.horizon_reference(s.bars, list(horizons), s.interval))
    scores = s.predictions.select("model", "fold", "timestamp", "symbol", "prediction")
    ends = F.coalesce(*[F.when(F.col("fold") == f.fold, F.lit(f.test_end.isoformat(sep=" ")).cast("timestamp_ntz")) for f in s.folds]) if s.folds else F.lit(None).cast("timestamp_ntz")
    rows = scores.join(reference, ["timestamp", "symbol"]).where(F.coalesce(F.col("label_end_timestamp") <= ends, F.lit(not s.folds)))
    metrics = None
    for h in horizons:
        own = P.rank_weights(rows.where(F.col("horizon_bars") == h), s.top, keys)
        part = P.cohort_metrics(P.portfolio_periods(own, s.interval, h, keys), s.costs, S.annual_periods(s.interval_minutes, h), keys)
        metrics = part if metrics is None else metrics.unionByName(part)
    return {
        "horizon_model_metrics": R.summarize_predictions(rows, keys),
        "horizon_fold_metrics": R.summarize_predictions(rows, [*keys, "fold"]),
        "horizon_portfolio_summary": P.portfolio_summary(metrics, keys),
        "horizon_break_even": C.sensitivity_break_even(metrics, keys),
    }


def temporal_stability(s: Study) -> Tables:
    levels = [0.0, s.focus]
    by_month = s.predictions.withColumn("month", T.month())
    ic_fold, ic_month = R.summarize_predictions(s.predictions, ["model", "fold"]), R.summarize_predictions(by_month, ["model", "fold", "month"])
    fold, month = T.temporal_groups(s.dated, ["model", "fold"], levels, s.annual), T.temporal_groups(s.dated, ["model", "fold", "month"], levels, s.annual)
    return {
        "stability_fold_prediction_metrics": ic_fold, "stability_month_prediction_metrics": ic_month, "stability_fold_portfolio_metrics": fold,
        "stability_month_portfolio_metrics": month, "stability_model_summary": T.stability_summary(ic_fold, ic_month, fold, month, s.focus),
    }


def symbol_dependence(s: Study, symbols: Sequence[str] | None = None) -> Tables:
    """All leave-one-out portfolios in one plan; without a list, every symbol of the predictions is left out once."""
    names = list(symbols) if symbols is not None else s.predictions.select("symbol").distinct()
    keys = ["model", "excluded_symbol"]
    full_ic = R.summarize_predictions(s.predictions).select("model", F.col("mean_rank_ic").alias("full_mean_rank_ic"))
    ic = S.leave_one_out_summary(s.predictions, names).join(full_ic, "model").withColumn("rank_ic_delta", F.col("mean_rank_ic") - F.col("full_mean_rank_ic"))
    metrics = P.cohort_metrics(S.leave_one_out_periods(s.joined, names, s.top, s.interval, s.holding), s.costs, s.annual, keys)
    full = C.sensitivity_break_even(s.metrics, ["model"]).select("model", F.col("pooled_break_even_cost_bps").alias("full_break_even_cost_bps"))
    summary = C.sensitivity_break_even(metrics, keys).join(C.focus_cost_returns(metrics, s.focus, s.annual, keys), keys).join(full, "model")
    held = S.symbol_contributions(s.weighted)
    narrow = summary.select(*keys, "pooled_break_even_cost_bps", "full_break_even_cost_bps", "positive_cohort_fraction_at_focus_cost")
    return {
        "symbol_exclusion_prediction_metrics": ic, "symbol_exclusion_portfolio_cohort_metrics": metrics, "symbol_exclusion_summary": summary,
        "symbol_contribution_metrics": held, "symbol_dependence_model_summary": S.dependence_summary(ic.select(*keys, "mean_rank_ic", "full_mean_rank_ic"), narrow, held),
    }


def market_regimes(s: Study, window: int = 48) -> Tables:
    states = G.market_state(s.bars, window)
    thresholds = G.regime_thresholds(states, s.folds)
    assigned = G.melt_regimes(G.assign_regimes(states, thresholds, s.folds))
    keys = ["model", "fold", "regime_dimension", "regime"]
    cells = R.summarize_predictions(s.predictions.join(assigned, ["fold", "timestamp"]), keys)
    portfolio = T.temporal_groups(s.dated.join(assigned, ["fold", "timestamp"]), keys, [0.0, s.focus], s.annual)
    return {"regime_thresholds": thresholds, "regime_assignments": assigned, "regime_prediction_metrics": cells, "regime_portfolio_metrics": portfolio, "regime_model_summary": G.regime_summary(cells, portfolio, s.focus)}


def bootstrap_uncertainty(
    s: Study, lengths: Sequence[int] = (12, 24, 48), period_lengths: Sequence[int] = (24, 72, 168), resamples: int = 1000, seed: int = 42, level: float = 0.95, models: Sequence[str] = ()
) -> Tables:
    """Block bootstraps of the rank IC timeline and of the portfolio, with NumPy's stream.

    The seed of a prediction series is seed + 100,000 x model index + length, a portfolio's adds 50,000
    and 100,003 per cohort; the index is the place in ``models``.
    """
    order = list(models) or [r[0] for r in s.predictions.select("model").distinct().orderBy("model").collect()]
    index = F.nullif(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")), F.lit(0)) - 1
    ic = R.rank_ic(s.predictions, ["model"]).withColumn("index", index)
    samples, books = None, None
    for n in lengths:
        part = Z.seeded_block_bootstrap(ic.withColumn("seed", F.lit(seed + n) + F.col("index") * 100_000), ["rank_ic"], n, resamples, "seed", ["model"]).withColumn("block_length", F.lit(n))
        samples = part if samples is None else samples.unionByName(part)
    periods = s.periods.withColumn("index", index)
    for n in period_lengths:
        seeded = periods.withColumn("seed", F.lit(seed + n + 50_000) + F.col("index") * 100_000 + F.col("cohort") * 100_003)
        part = Z.seeded_block_bootstrap(seeded, ["gross_return", "turnover"], n, resamples, "seed", ["model", "cohort"])
        books = part.withColumn("block_length", F.lit(n)) if books is None else books.unionByName(part.withColumn("block_length", F.lit(n)))
    by = ["model", "block_length"]
    portfolio = Z.portfolio_distribution(books, s.focus, s.annual, by)
    prediction = Z.bootstrap_summary(samples, "rank_ic", level, by)
    parts = [Z.bootstrap_summary(portfolio, c, level, by).select(*by, *[F.col(x).alias(f"{c}_{x}") for x in ("bootstrap_mean", "bootstrap_std", "confidence_lower", "confidence_upper", "probability_positive")]) for c in ("gross_annualized_return", "net_annualized_return", "break_even_cost_bps", "mean_turnover")]
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.join(p, by)
    above = portfolio.groupBy(*by).agg(F.avg((F.col("break_even_cost_bps") > s.focus).cast("double")).alias("probability_break_even_above_focus_cost"))
    return {"bootstrap_prediction_distribution": samples, "bootstrap_prediction_summary": prediction, "bootstrap_portfolio_distribution": portfolio, "bootstrap_portfolio_summary": summary.join(above, by)}


def research_panel(bars: DataFrame, folds: Sequence[L.Fold], horizon: int = 12, interval_minutes: int = 5, symbols: int | None = None) -> Tables:
    labelled = X.forward_targets(X.symbol_features(bars), horizon, interval_minutes * MINUTE)
    panel = X.finalize_panel(labelled, X.FEATURES, symbols)
    return {"research_panel": panel, "fold_summary": L.fold_summary(panel, folds), "bar_validation": B.validate_bars(bars, interval_minutes * MINUTE)}


PREDICTED = ["model", "fold", "split", "timestamp", "label_end_timestamp", "symbol", "raw_target", "target", "prediction"]


def _tables_of(predictions: DataFrame) -> Tables:
    metrics = R.summarize_predictions(predictions, ["model", "fold", "split"])
    return {"predictions": predictions, "fold_metrics": metrics, "summary": R.fold_summary_of_metrics(metrics, ["model", "split"])}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _boosted(rows: DataFrame, fold: int, features: list[str], seed: int, iterations: int) -> DataFrame:
    """The rows of a fold scored by trees fitted to its training rows, stopped by its validation rows."""
    own = rows.where(F.col("fold") == fold)
    model = M.fit_boosted_trees(own.where("split = 'train'"), own.where("split = 'validation'"), features, seed=seed, iterations=iterations)
    return model.transform(own).drop("__x")


def baselines(
    panel: DataFrame, folds: Sequence[L.Fold], features: Sequence[str] = tuple(X.FEATURES), alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0), trees: int = 0, seed: int = 42
) -> Tables:
    """Momentum, reversal and ridge (the penalty chosen by validation rank IC) on every split; one Gram pass fits all folds and penalties.

    ``trees`` > 0 adds gradient-boosted trees of up to so many iterations, fitted per fold on the executors.
    """
    rows = L.assign_folds(panel, folds).where("split <> 'purged'")
    names = list(features)
    scaled = N.apply_robust_scaler(rows, N.fit_robust_scaler(rows.where("split = 'train'"), names), names)
    fitted = M.fit_ridge(scaled.where("split = 'train'"), names, list(alphas))
    chosen = M.first_best(R.summarize_predictions(M.score_by_fold(scaled.where("split = 'validation'"), fitted), ["fold", "alpha"]), "mean_rank_ic", ["fold"])
    best = {r["fold"]: r["alpha"] for r in chosen.collect()}
    ridge = M.score_by_fold(scaled, {(f, 0.0): fitted[f, a] for f, a in best.items()}).withColumn("model", F.lit("ridge"))
    parts = [M.reference_scores(rows).select(*PREDICTED), ridge.select(*PREDICTED)]
    if trees:
        parts += [_boosted(rows, f.fold, names, seed, trees).withColumn("model", F.lit("boosted_trees")).select(*PREDICTED) for f in folds]
    return _tables_of(_union(parts)) | {"model_selection": chosen}


def neural(
    panel: DataFrame, folds: Sequence[L.Fold], kind: str, features: Sequence[str] = tuple(X.FEATURES), length: int = 128, stride: int = 6, seed: int = 42,
    epochs: int = 8, patience: int = 2, batch: int | None = None, rate: float | None = None, drop_rate: float = 0.1, **shape: Any,
) -> Tables:
    """Scores of an ``mlp``, ``tcn`` or ``transformer`` on validation and test rows, one network per fold.

    Features are scaled by the fold's training rows.  Networks are fitted on the driver to at most
    TRAINING_ROWS rows (TRAINING_WINDOWS windows, from every ``stride``-th endpoint) of the training
    split, and score all rows on the executors.  ``shape`` goes to the network's initial weights.
    """
    names = list(features)
    keep = ["fold", "split", "timestamp", "label_end_timestamp", "symbol", "raw_target", "target"]
    scored, history, coverage = [], [], []
    for fold in folds:
        rows = L.assign_folds(panel, [fold])
        scaled = N.apply_robust_scaler(rows, N.fit_robust_scaler(rows.where("split = 'train'"), names), names, float_first=kind != "mlp")
        if kind == "mlp":
            parts = {k: scaled.where(F.col("split") == k).select(*keep, *names) for k in ("train", "validation", "test")}
            inputs, bound, start = names, W.TRAINING_ROWS, W.mlp_init(len(names), seed=seed + fold.fold, **shape)
        else:
            ends = {k: E.sequence_endpoints(scaled, length, k) for k in ("train", "validation", "test")}
            ends["train"] = E.subsample_endpoints(ends["train"], stride)
            carried = tuple(c for c in keep if c not in ("timestamp", "symbol", "target"))
            parts = {k: E.sequence_windows(scaled, names, length, e, carried).select(*keep, "window") for k, e in ends.items()}
            inputs, bound = "window", W.TRAINING_WINDOWS
            if kind == "tcn":
                start = W.tcn_init(len(names), seed=seed + fold.fold, **({"blocks": max(1, (length - 1).bit_length())} | shape))
            else:
                patch = shape.get("patch", 4)
                if length % patch:
                    raise ValueError("the sequence length must hold whole patches")
                start = W.transformer_init(len(names), seed=seed + fold.fold, **({"patches": length // patch} | shape))
            coverage.append(E.endpoint_coverage(scaled, length).withColumn("fold", F.lit(fold.fold)))
        x, y, _ = W.driver_sample(parts["train"], inputs, ["timestamp", "symbol"], rows=bound)
        validation = W.driver_sample(parts["validation"], inputs, ["timestamp", "symbol"], rows=bound)
        size, step = (batch or 8192, rate or 1e-3) if kind == "mlp" else (batch or 640, rate or 3e-4)
        weights, trace = W.train(kind, start, (x, y), validation, epochs, patience, size, step, drop_rate, seed + fold.fold)
        history += [{"model": kind, "fold": fold.fold, "training_rows": len(x), **t} for t in trace]
        scored.append(W.score(parts["validation"].unionByName(parts["test"]), kind, weights, inputs, keep).withColumn("model", F.lit(kind)).select(*PREDICTED))
    log = panel.sparkSession.createDataFrame(history, "model string, fold int, training_rows bigint, epoch int, train_loss double, validation_loss double, validation_mean_rank_ic double")
    return _tables_of(_union(scored)) | {"training_history": log} | ({"endpoint_coverage": _union(coverage)} if coverage else {})


def sequence_audit(panel: DataFrame, folds: Sequence[L.Fold], features: Sequence[str] = tuple(X.FEATURES), length: int = 128, interval_minutes: int = 5) -> Tables:
    """Whether the panel is a full block for windows, and what endpoints each fold and split has."""
    names = list(features)
    parts = [E.endpoint_coverage(L.assign_folds(panel, [f]), length).withColumn("fold", F.lit(f.fold)) for f in folds]
    return {"sequence_shape_violations": E.panel_shape_violations(panel, names, interval_minutes * MINUTE), "sequence_endpoint_metrics": _union(parts)}


def ridge_ablations(panel: DataFrame, folds: Sequence[L.Fold], families: dict[str, Sequence[str]], alpha: float = 1.0) -> DataFrame:
    """Test scores of ridge without each feature family: all variants from one Gram matrix per fold."""
    features = [f for members in families.values() for f in members]
    sets = M.leave_one_family_out(features, families)
    rows = L.assign_folds(panel, folds)
    grams: dict[int, dict[tuple[str, str], float]] = {}
    for r in M.gram_matrix(rows.where("split = 'train'"), features).collect():
        grams.setdefault(r["fold"], {})[r["a"], r["b"]] = r["value"]
    test = rows.where("split = 'test'")
    parts = []
    for variant, members in sets.items():
        fitted = {(fold, alpha): M.solve_ridge(g, members, alpha) for fold, g in grams.items()}
        parts.append(M.score_by_fold(test, fitted).withColumn("variant", F.lit(variant)).withColumn("model", F.lit("ridge")))
    return _union(parts)


def ablations(s: Study, families: dict[str, Sequence[str]], panel: DataFrame | None = None, alpha: float = 1.0, trees: int = 0, seed: int = 42) -> Tables:
    """Ridge (and boosted trees, if ``trees`` > 0) without each feature family: prediction and portfolio side by (model, variant)."""
    panel = panel if panel is not None else _panel(s)
    keys, columns = ["model", "variant"], ["model", "variant", "fold", "timestamp", "symbol", "raw_target", "target", "prediction"]
    parts = [ridge_ablations(panel, s.folds, families, alpha).select(*columns)]
    if trees:
        rows = L.assign_folds(panel, s.folds).where("split <> 'purged'")
        features = [f for members in families.values() for f in members]
        for variant, members in M.leave_one_family_out(features, families).items():
            for f in s.folds:
                scored = _boosted(rows, f.fold, members, seed, trees).where("split = 'test'")
                parts.append(scored.withColumn("variant", F.lit(variant)).withColumn("model", F.lit("boosted_trees")).select(*columns))
    scored = s.persisted(_union(parts))
    metrics = R.summarize_predictions(scored, keys)
    weighted = P.rank_weights(X.with_execution(scored, s.bars, s.holding), s.top, keys)
    cohorts = P.cohort_metrics(P.portfolio_periods(weighted, s.interval, s.holding, keys), s.costs, s.annual, keys)
    summary = C.sensitivity_break_even(cohorts, keys).join(C.focus_cost_returns(cohorts, s.focus, s.annual, keys), keys)
    both = M.delta_vs_full(metrics, ["mean_rank_ic", "rmse"]).join(summary.withColumnRenamed("mean_turnover", "portfolio_mean_turnover"), keys)
    return {
        "ablation_predictions": scored, "ablation_feature_summary": M.delta_vs_full(metrics, ["mean_rank_ic", "rmse"]), "ablation_fold_metrics": R.summarize_predictions(scored, [*keys, "fold"]),
        "ablation_portfolio_cohort_metrics": cohorts, "ablation_portfolio_summary": summary, "ablation_model_summary": both,
        "ablation_cohort_differences": K.cohort_set_differences(cohorts, keys, 0.0, s.focus),
    }


def family_summary(oos: DataFrame, break_even: DataFrame, bootstrap: DataFrame, families: dict[str, str], references: Sequence[str] = ("reversal", "mlp")) -> DataFrame:
    """Models with their family, intervals and differences from reference models, by joins on the model."""
    family = F.coalesce(*[F.when(F.col("model") == m, F.lit(f)) for m, f in families.items()])
    out = oos.join(break_even.select("model", "pooled_break_even_cost_bps"), "model").join(bootstrap, "model").withColumn("model_family", family)
    for name in references:
        one = out.where(F.col("model") == name).agg(F.max("mean_rank_ic").alias("__ic"), F.max("pooled_break_even_cost_bps").alias("__be"))
        out = out.crossJoin(F.broadcast(one)).withColumns({f"rank_ic_delta_vs_{name}": F.col("mean_rank_ic") - F.col("__ic"), f"break_even_delta_vs_{name}_bps": F.col("pooled_break_even_cost_bps") - F.col("__be")}).drop("__ic", "__be")
    return out


ANALYSES = {
    f.__name__: f
    for f in (evaluate_portfolios, null_tests, break_even_costs, rebalance_sensitivity, breadth_sensitivity, horizon_sensitivity, temporal_stability, symbol_dependence, market_regimes, bootstrap_uncertainty, label_audit, ablations)
}
#: Analyses that read the panel.
WITH_PANEL = {"label_audit", "ablations"}
#: Analyses that make predictions from the panel.
MODELS = ("baselines", "mlp", "tcn", "transformer")
# The feature families that ablations leave out.
FAMILIES = {
    "returns": ["return_1", "return_3", "return_12", "return_48"],
    "range_volatility": ["log_range", "close_open_return", "realized_vol_12", "realized_vol_48"],
    "activity_flow": ["log_quote_volume", "volume_zscore_48", "trade_count_zscore_48", "taker_buy_ratio"],
    "calendar": ["time_of_day_sin", "time_of_day_cos", "weekday_sin", "weekday_cos"],
}
