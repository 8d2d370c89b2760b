"""Queries of the reference operators, one per operator family, with SQL twins.

Doubles that come out of sums or logarithms are rounded on both sides alike, so that the order of
summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.scalar import is_finite
from panelmill.operators import bars as B
from panelmill.operators import checks as K
from panelmill.operators import costs as C
from panelmill.operators import features as X
from panelmill.operators import models as M
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
from panelmill.operators.release import inventory_digest_column
from panelmill.operators.report import best_per_group
from panelmill.plans import study
from panelmill.plans.analyses import family_summary
from panelmill.plans.study_sql import FEATURE_LIST, ask, avg_rank, cohort_metrics, corr, ic, periods, portfolio_summary, sensitivity, summary, temporal, weights
from panelmill.session import written
from panelmill.sources.archives import archive_plan, file_hashes
from panelmill.sources.tables import table
from panelmill.streaming.bars import streaming_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FIVE_MINUTES = 5 * study.MINUTE


def add(name: str, fn: Query, sql: str | None, doubles: str = "", digits: int = 9) -> None:
    names = doubles.split()

    def run(spark: SparkSession, d: str) -> DataFrame:
        return fn(spark, d).withColumns({c: F.round(c, digits) for c in names})

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names)}) FROM ({sql})" if names else sql


_IC = "mean_rank_ic median_rank_ic rank_ic_std rank_ic_ir positive_timestamp_fraction rmse mae"
_TS = '"timestamp"'
_BE = "equal_weighted_break_even_cost_bps pooled_break_even_cost_bps mean_individual_break_even_cost_bps median_individual_break_even_cost_bps worst_individual_break_even_cost_bps best_individual_break_even_cost_bps"

# Bars, features, labels
_SUMMED = ["quote_volume", "taker_buy_quote_volume"]
add(
    "ohlcv_bars",
    lambda s, d: study.bars(s, d).withColumns({c: F.round(c, 3) for c in _SUMMED}),
    ask(f"""SELECT make_timestamp(us) AS "timestamp", make_timestamp(us + {study.WEEK} - 1000) AS available_time, symbol, open, high, low, close, volume, trade_count, taker_buy_volume,
      {', '.join(f'round({c}, 3) AS {c}' for c in _SUMMED)} FROM pb"""),
    "open high low close", 8,
)

_RULES = {
    "null_value": " OR ".join(f'"{c}" IS NULL' for c in B.BAR_COLUMNS),
    "non_finite": " OR ".join(f"NOT isfinite({c})" for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")),
    "price_not_positive": " OR ".join(f"{c} <= 0" for c in ("open", "high", "low", "close")),
    "negative_activity": " OR ".join(f"{c} < 0" for c in ("volume", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")),
    "high_too_low": "CASE WHEN open IS NULL AND close IS NULL AND low IS NULL THEN NULL ELSE high < greatest(open, close, low) END",
    "low_too_high": "CASE WHEN open IS NULL AND close IS NULL AND high IS NULL THEN NULL ELSE low > least(open, close, high) END",
    "available_before_start": 'available_time < "timestamp"',
    "longer_than_interval": f'epoch_us(available_time) - epoch_us("timestamp") > {FIVE_MINUTES}',
}
add(
    "bar_validation",
    lambda s, d: B.validate_bars(table(s, d, "bars"), FIVE_MINUTES),
    f"""SELECT symbol, count(*) AS row_count, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _RULES.items())}, count(*) FILTER (WHERE step = 0) AS duplicate_rows,
      count(*) FILTER (WHERE step % {FIVE_MINUTES} <> 0) AS off_grid_steps, sum(CASE WHEN step > 0 THEN step // {FIVE_MINUTES} - 1 ELSE 0 END)::BIGINT AS missing_intervals
      FROM (SELECT *, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY symbol ORDER BY "timestamp") AS step FROM bars) GROUP BY symbol""",
)
add("symbol_features", lambda s, d: study.features(s, d).select("symbol", "timestamp", *X.FEATURES), ask(f'SELECT symbol, "timestamp", {FEATURE_LIST} FROM feat'), " ".join(X.FEATURES))
add("log_returns", lambda s, d: study.features(s, d).select("symbol", "timestamp", "return_1", "return_3", "return_12", "return_48"), ask('SELECT symbol, "timestamp", return_1, return_3, return_12, return_48 FROM feat'), "return_1 return_3 return_12 return_48")
add(
    "taker_ratio_default",
    lambda s, d: table(s, d, "bars").select("bar_id", X.taker_ratio().alias("ratio")),
    "SELECT bar_id, coalesce(CASE WHEN quote_volume > 0 THEN taker_buy_quote_volume / quote_volume END, 0.5) AS ratio FROM bars",
    "ratio",
)
add("forward_label", lambda s, d: study.labelled(s, d).select("symbol", "timestamp", "label_end_timestamp", "raw_target", "target"), ask('SELECT symbol, "timestamp", label_end_timestamp, raw_target, target FROM lab'), "raw_target target")
_USABLE = f"SELECT *, count(*) OVER (PARTITION BY us) AS n FROM lab WHERE {' AND '.join(f'{f} IS NOT NULL' for f in X.FEATURES)} AND raw_target IS NOT NULL"
_PANEL = f", usable AS ({_USABLE}), panel AS (SELECT * FROM usable WHERE n = (SELECT max(n) FROM usable))"
add(
    "research_panel",
    lambda s, d: study.panel(s, d).select("symbol", "timestamp", "raw_target", "target", F.col("return_12").cast("double").alias("return_12")),
    ask('SELECT symbol, "timestamp", raw_target, raw_target - avg(raw_target) OVER (PARTITION BY us) AS target, return_12::FLOAT::DOUBLE AS return_12 FROM panel', _PANEL),
    "raw_target target return_12",
)
add(
    "complete_cross_sections",
    lambda s, d: B.complete_cross_sections(study.bars(s, d)).groupBy("timestamp").agg(F.count("*").alias("symbols"), F.max("close").alias("highest_close")),
    ask('SELECT make_timestamp(us) AS "timestamp", count(*) AS symbols, max(close) AS highest_close FROM pb GROUP BY us HAVING count(DISTINCT symbol) = (SELECT max(n) FROM (SELECT count(DISTINCT symbol) AS n FROM pb GROUP BY us))'),
    "highest_close",
)
# Folds and scaling
add("purged_folds", lambda s, d: study.split_panel(s, d).select("fold", "symbol", "timestamp", "split"), ask('SELECT fold, symbol, "timestamp", split FROM split'))
_CROSS = "count(*) FILTER (WHERE period = '{p}' AND split = 'purged') AS {p}_purged"
add(
    "fold_summary",
    lambda s, d: L.fold_summary(study.labelled(s, d).where("label_end_timestamp is not null and return_12 is not null"), study.FOLDS),
    ask(f"SELECT fold, {', '.join(f'''count(*) FILTER (WHERE split = '{p}') AS {p}_rows''' for p in ('train', 'validation', 'test'))}, {', '.join(_CROSS.format(p=p) for p in ('train', 'validation', 'test'))} FROM split GROUP BY fold"),
)
_SCALED = X.FEATURES
_TRAIN = "(SELECT * FROM split WHERE split = 'train')"
_SCALER = " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, quantile_cont({f}, 0.5) AS median, CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) > 1e-12 THEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) ELSE 1 END AS scale FROM {_TRAIN} GROUP BY fold" for f in _SCALED)


def _scaler(s: SparkSession, d: str) -> DataFrame:
    return N.fit_robust_scaler(study.split_panel(s, d).where("split = 'train'"), _SCALED)


add("robust_scaler_fit", _scaler, ask(f"SELECT * FROM ({_SCALER})"), "median scale")
add(
    "robust_scaled_panel",
    lambda s, d: N.apply_robust_scaler(study.split_panel(s, d).where("split = 'test'"), _scaler(s, d), _SCALED).select("fold", "symbol", "timestamp", *[F.col(f).cast("double").alias(f) for f in _SCALED]),
    ask(f"""SELECT fold, symbol, "timestamp", {', '.join(f"((s.{f} - max(q.median) FILTER (WHERE feature = '{f}')) / max(q.scale) FILTER (WHERE feature = '{f}'))::FLOAT::DOUBLE AS {f}" for f in _SCALED)}
      FROM split s JOIN ({_SCALER}) q USING (fold) WHERE split = 'test' GROUP BY fold, symbol, "timestamp", {', '.join('s.' + f for f in _SCALED)}"""),
    " ".join(_SCALED), 5,
)
add(
    "exact_quantiles",
    lambda s, d: N.exact_quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99]),
    "SELECT l_returnflag, p, quantile FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, quantile_cont(l_extendedprice, {p}) AS quantile FROM lineitem GROUP BY 1" for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + ")",
    "quantile", 6,
)
# Ranks and rank correlation
add(
    "average_tie_rank",
    lambda s, d: table(s, d, "part").select("p_partkey", R.average_rank("p_size", ["p_brand"]).alias("average_rank")),
    "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS average_rank FROM part",
)
add("rank_ic_timeline", study.ic_timeline, ask(f'SELECT model, fold, make_timestamp(us) AS "timestamp", rank_ic, symbols FROM icfold'), "rank_ic")
add("prediction_summary", lambda s, d: R.summarize_predictions(study.predictions(s, d)), ask(summary("pred", "model")), _IC)
add("grouped_prediction_summary", lambda s, d: R.summarize_predictions(study.predictions(s, d).withColumn("month", T.month()), ["model", "fold", "month"]), ask(summary("(SELECT *, strftime(timestamp, '%Y-%m') AS \"month\" FROM pred)", 'model, fold, "month"')), _IC)
add(
    "fold_metric_summary",
    lambda s, d: R.fold_summary_of_metrics(R.summarize_predictions(study.predictions(s, d), ["model", "fold"])),
    ask(f"""SELECT model, avg(mean_rank_ic) AS mean_fold_rank_ic, min(mean_rank_ic) AS worst_fold_rank_ic, max(mean_rank_ic) AS best_fold_rank_ic, avg(rank_ic_ir) AS mean_rank_ic_ir,
      avg(positive_timestamp_fraction) AS mean_positive_timestamp_fraction, avg(rmse) AS mean_rmse, avg(mae) AS mean_mae, sum(n_rows)::BIGINT AS total_rows FROM ({summary('pred', 'model, fold')}) GROUP BY model"""),
    "mean_fold_rank_ic worst_fold_rank_ic best_fold_rank_ic mean_rank_ic_ir mean_positive_timestamp_fraction mean_rmse mean_mae",
)
_SHIFTS = [-2, -1, 0, 1, 2, 4, 8]
_SHIFTED = ask(
    "SELECT model, fold, shift_bars, avg(rank_ic) AS mean_rank_ic, count(rank_ic) AS n_timestamps FROM ("
    + " UNION ALL ".join(f"SELECT model, fold, us, {k} AS shift_bars, {corr('pr', 't')} AS rank_ic FROM (SELECT *, {'lead' if k >= 0 else 'lag'}(tr, {abs(k)}) OVER (PARTITION BY model, fold, symbol ORDER BY us) AS t FROM ranked) WHERE t IS NOT NULL GROUP BY model, fold, us" for k in _SHIFTS)
    + ") GROUP BY model, fold, shift_bars",
    f", ranked AS (SELECT *, {avg_rank('prediction', 'model, fold, us')} AS pr, {avg_rank('target', 'model, fold, us')} AS tr FROM pred)",
)
add(
    "shifted_rank_ic",
    lambda s, d: R.shifted_rank_ic(study.predictions(s, d), _SHIFTS),
    _SHIFTED,
    "mean_rank_ic",
)
# Portfolio
add("execution_return", lambda s, d: X.execution_returns(study.bars(s, d), study.HOLDING), ask(f'SELECT make_timestamp(us) AS "timestamp", symbol, execution_return FROM execr'), "execution_return")
add("rank_weights", lambda s, d: study.weighted(s, d).select("model", "timestamp", "symbol", "weight"), ask('SELECT model, "timestamp", symbol, weight FROM wts'))
add("cohort_assignment", lambda s, d: study.bars(s, d).select("timestamp", "symbol", P.cohort(study.WEEK, study.HOLDING).alias("cohort")), ask(f'SELECT make_timestamp(us) AS "timestamp", symbol, ((us // {study.WEEK}) % {study.HOLDING})::INT AS cohort FROM pb'))
add("portfolio_periods", study.periods, ask('SELECT model, cohort, make_timestamp(us) AS "timestamp", gross_return, turnover FROM per'), "gross_return turnover")
add(
    "cost_adjusted_periods",
    lambda s, d: P.with_costs(study.periods(s, d), study.COSTS).select("model", "cohort", "timestamp", "cost_bps", "cost", "net_return"),
    ask(f"SELECT model, cohort, make_timestamp(us) AS \"timestamp\", cost_bps, turnover * cost_bps / 10000 AS cost, gross_return - turnover * cost_bps / 10000 AS net_return FROM (SELECT *, unnest([0.0::DOUBLE, 1, 2, 5, 10]) AS cost_bps FROM per)"),
    "cost net_return",
)
_COH = "mean_net_return annualized_net_return annualized_volatility annualized_sharpe positive_fraction mean_turnover cumulative_net_log_return"
_SUM = "mean_cohort_sharpe median_cohort_sharpe worst_cohort_sharpe best_cohort_sharpe mean_annualized_net_return median_annualized_net_return worst_annualized_net_return best_annualized_net_return mean_annualized_volatility mean_positive_fraction mean_turnover mean_cumulative_net_log_return"
add("cohort_metrics", study.metrics, ask("SELECT * FROM coh"), _COH)
add("portfolio_model_summary", lambda s, d: P.portfolio_summary(study.metrics(s, d)), ask(portfolio_summary("coh", "model")), _SUM)
_SHOWN = ["mean_cohort_sharpe", "worst_cohort_sharpe", "mean_annualized_net_return", "worst_annualized_net_return", "mean_turnover"]
add(
    "model_comparison",
    lambda s, d: P.model_comparison(R.summarize_predictions(study.predictions(s, d)), P.portfolio_summary(study.metrics(s, d)), [0.0, 5.0]),
    ask(f"SELECT p.*, {', '.join(f'q{c}.{m} AS {m}_{c}bps' for c in (0, 5) for m in _SHOWN)} FROM ({summary('pred', 'model')}) p LEFT JOIN (SELECT * FROM ps WHERE cost_bps = 0) q0 USING (model) LEFT JOIN (SELECT * FROM ps WHERE cost_bps = 5) q5 USING (model)", f", ps AS ({portfolio_summary('coh', 'model')})"),
    _IC + " " + " ".join(f"{m}_{c}bps" for c in (0, 5) for m in _SHOWN),
)
# Costs and cadence
add("break_even_cohorts", study.break_even, ask("SELECT * FROM becoh"), "gross_mean_return mean_turnover gross_cumulative_log_return gross_annualized_return total_turnover break_even_cost_bps", 8)
_LABEL = {0.0: "0", 1.0: "1", 2.0: "2", 5.0: "5", 10.0: "10"}
add(
    "break_even_model",
    lambda s, d: C.break_even_summary(study.break_even(s, d), study.ANNUAL, study.COSTS),
    ask(f"""SELECT model, count(*) AS cohort_count, sum(period_count)::BIGINT AS total_periods, avg(gross_mean_return) AS equal_weighted_gross_mean_return, avg(gross_mean_return) * {study.ANNUAL} AS equal_weighted_gross_annualized_return,
      sum(gross_cumulative_log_return) / sum(period_count) AS pooled_gross_mean_return, sum(gross_cumulative_log_return) / sum(period_count) * {study.ANNUAL} AS pooled_gross_annualized_return,
      avg(mean_turnover) AS equal_weighted_mean_turnover, sum(total_turnover) / sum(period_count) AS pooled_mean_turnover, avg(gross_mean_return) / avg(mean_turnover) * 10000 AS equal_weighted_break_even_cost_bps,
      sum(gross_cumulative_log_return) / sum(total_turnover) * 10000 AS pooled_break_even_cost_bps, avg(break_even_cost_bps) AS mean_individual_break_even_cost_bps, quantile_cont(break_even_cost_bps, 0.5) AS median_individual_break_even_cost_bps,
      min(break_even_cost_bps) AS worst_individual_break_even_cost_bps, max(break_even_cost_bps) AS best_individual_break_even_cost_bps,
      {', '.join(f'avg((gross_mean_return - mean_turnover * {c} / 10000 > 0)::INT) AS positive_cohort_fraction_at_{n}bps' for c, n in _LABEL.items())} FROM becoh GROUP BY model"""),
    "equal_weighted_gross_mean_return equal_weighted_gross_annualized_return pooled_gross_mean_return pooled_gross_annualized_return equal_weighted_mean_turnover pooled_mean_turnover " + _BE + " " + " ".join(f"positive_cohort_fraction_at_{n}bps" for n in _LABEL.values()),
    8,
)
_GRID = C.cost_grid(0.0, 10.0, 0.1)
add(
    "cost_curve",
    lambda s, d: C.cost_curve(study.break_even(s, d), _GRID, study.ANNUAL).withColumn("cost_bps", F.round("cost_bps", 6)),
    ask(f"""SELECT model, cost_bps, count(*) AS cohort_count, sum(period_count)::BIGINT AS total_periods, {', '.join(f'{a} AS {n}_cohort_net_return, {a} * {study.ANNUAL} AS {n}_cohort_annualized_net_return' for n, a in (('mean', 'avg(net)'), ('median', 'quantile_cont(net, 0.5)'), ('worst', 'min(net)'), ('best', 'max(net)')))},
      avg((net > 0)::INT) AS positive_cohort_fraction, sum(net * period_count) / sum(period_count) AS pooled_mean_net_return, sum(net * period_count) / sum(period_count) * {study.ANNUAL} AS pooled_annualized_net_return, sum(net * period_count) AS pooled_cumulative_net_log_return
      FROM (SELECT *, gross_mean_return - mean_turnover * cost_bps / 10000 AS net FROM (SELECT *, unnest(list_transform(generate_series(0, 100), lambda i: round(i / 10.0, 6)::DOUBLE)) AS cost_bps FROM becoh)) GROUP BY model, cost_bps"""),
    " ".join(f"{n}_cohort_{k}net_return" for n in ("mean", "median", "worst", "best") for k in ("", "annualized_")) + " positive_cohort_fraction pooled_mean_net_return pooled_annualized_net_return pooled_cumulative_net_log_return",
)
_CADENCES = [1, 3, 6, 12]
_PHASES = "unnest([" + ", ".join(f"{{'c': {c}, 'p': {p}}}" for c in _CADENCES for p in range(c)) + "])"
add(
    "rebalance_phase_map",
    lambda s, d: Y.phase_map(s, _CADENCES, study.HOLDING, 5),
    f"""SELECT c AS cadence_bars, c * 5 AS cadence_minutes, p AS phase, p * 5 AS phase_offset_minutes, ({study.HOLDING} // c)::INT AS sleeve_count, c / {study.HOLDING}::DOUBLE AS capital_fraction_per_sleeve,
      array_to_string(list_transform(generate_series(p, {study.HOLDING - 1}, c), lambda x: x::VARCHAR), ',') AS selected_cohorts FROM (SELECT x.c::INT AS c, x.p::INT AS p FROM (SELECT {_PHASES} AS x))""",
    "capital_fraction_per_sleeve",
)
_PHASE_SQL = f"""SELECT *, (total_gross_log_return - total_turnover * cost_bps / 10000) / total_periods AS pooled_net_mean_return, equal_weighted_gross_mean_return - equal_weighted_mean_turnover * cost_bps / 10000 AS equal_weighted_net_mean_return,
      (total_gross_log_return - total_turnover * cost_bps / 10000) / total_periods * {study.ANNUAL} AS pooled_annualized_net_return, (equal_weighted_gross_mean_return - equal_weighted_mean_turnover * cost_bps / 10000) * {study.ANNUAL} AS equal_weighted_annualized_net_return,
      positive_sleeve_fraction = 1 AS all_sleeves_positive FROM (
      SELECT model, x.c::INT AS cadence_bars, x.p::INT AS phase, cost_bps, count(*) AS sleeve_count, sum(period_count)::BIGINT AS total_periods, sum(gross_cumulative_log_return) AS total_gross_log_return, sum(total_turnover) AS total_turnover,
      sum(gross_cumulative_log_return) / nullif(sum(total_turnover), 0) * 10000 AS break_even_cost_bps, avg(gross_mean_return) AS equal_weighted_gross_mean_return, avg(mean_turnover) AS equal_weighted_mean_turnover, sum(total_turnover) / sum(period_count) AS pooled_mean_turnover,
      string_agg(cohort, ',' ORDER BY cohort) AS selected_cohorts, avg((gross_mean_return - mean_turnover * cost_bps / 10000 > 0)::INT) AS positive_sleeve_fraction
      FROM (SELECT *, unnest([0.0::DOUBLE, 1, 2, 5, 10]) AS cost_bps FROM (SELECT *, {_PHASES} AS x FROM becoh)) WHERE cohort % x.c = x.p GROUP BY model, x, cost_bps)"""


def _phases(s: SparkSession, d: str) -> DataFrame:
    return Y.phase_metrics(study.break_even(s, d), _CADENCES, study.COSTS, study.HOLDING, study.ANNUAL)


add("rebalance_phase_metrics", _phases, ask(_PHASE_SQL), "total_gross_log_return total_turnover break_even_cost_bps equal_weighted_gross_mean_return equal_weighted_mean_turnover pooled_mean_turnover positive_sleeve_fraction pooled_net_mean_return equal_weighted_net_mean_return pooled_annualized_net_return equal_weighted_annualized_net_return", 8)
_FOUR = [("mean", "avg"), ("median", "median"), ("worst", "min"), ("best", "max")]
add(
    "rebalance_cadence_summary",
    lambda s, d: Y.cadence_summary(_phases(s, d)),
    ask(f"""SELECT model, cadence_bars, cost_bps, count(*) AS phase_count, max(sleeve_count) AS sleeve_count, {', '.join(f'{a}(break_even_cost_bps) AS {n}_phase_break_even_cost_bps, {a}(pooled_annualized_net_return) AS {n}_pooled_annualized_net_return' for n, a in _FOUR)},
      avg((pooled_net_mean_return > 0)::INT) AS positive_phase_fraction, avg(positive_sleeve_fraction) AS mean_positive_sleeve_fraction, avg(pooled_mean_turnover) AS mean_pooled_turnover FROM ({_PHASE_SQL}) GROUP BY model, cadence_bars, cost_bps"""),
    " ".join(f"{n}_phase_break_even_cost_bps {n}_pooled_annualized_net_return" for n, _ in _FOUR) + " positive_phase_fraction mean_positive_sleeve_fraction mean_pooled_turnover",
    8,
)
add(
    "cost_monotonicity_gate",
    lambda s, d: K.cost_monotonicity(_phases(s, d), ["model", "cadence_bars", "phase"]),
    ask(f"SELECT model, cadence_bars, phase, count(step) AS steps, count(*) FILTER (WHERE step > 1e-15) AS rising_steps FROM (SELECT *, pooled_net_mean_return - lag(pooled_net_mean_return) OVER (PARTITION BY model, cadence_bars, phase ORDER BY cost_bps) AS step FROM ({_PHASE_SQL})) GROUP BY model, cadence_bars, phase"),
)
# Breadth and horizon
_SENS = _BE + " mean_gross_annualized_return mean_zero_cost_sharpe mean_turnover positive_cohort_fraction"
add("breadth_summary", lambda s, d: P.portfolio_summary(study.breadth_metrics(s, d), ["model", "top_count"]), ask(portfolio_summary("bcoh", "model, top_count")), _SUM)
add("breadth_break_even", lambda s, d: C.sensitivity_break_even(study.breadth_metrics(s, d), ["model", "top_count"]), ask(sensitivity("bcoh", "model, top_count")), _SENS, 8)
add("horizon_reference", lambda s, d: S.horizon_targets(S.horizon_reference(study.bars(s, d), study.HORIZONS, study.WEEK)), ask('SELECT symbol, make_timestamp(us) AS "timestamp", horizon_bars, make_timestamp(end_us) AS label_end_timestamp, raw_target, execution_return, target FROM htar'), "raw_target execution_return target")
add("horizon_prediction_summary", lambda s, d: R.summarize_predictions(study.horizon_joined(s, d), ["model", "horizon_bars"]), ask(summary("hjoin", "model, horizon_bars")), _IC)
add("horizon_portfolio_summary", lambda s, d: P.portfolio_summary(study.horizon_metrics(s, d), ["model", "horizon_bars"]), ask(portfolio_summary("hcoh", "model, horizon_bars")), _SUM)
add("horizon_break_even", lambda s, d: C.sensitivity_break_even(study.horizon_metrics(s, d), ["model", "horizon_bars"]), ask(sensitivity("hcoh", "model, horizon_bars")), _SENS, 8)
# Stability
_TMP = "total_gross_log_return total_turnover mean_turnover break_even_cost_bps pooled_gross_mean_return pooled_net_mean_return equal_weighted_net_mean_return pooled_annualized_net_return equal_weighted_annualized_net_return worst_cohort_annualized_net_return best_cohort_annualized_net_return positive_cohort_fraction"
_TWO = f"[0.0::DOUBLE, {study.FOCUS}]"


def _temporal(s: SparkSession, d: str, keys: list[str]) -> DataFrame:
    return T.temporal_groups(study.dated_periods(s, d), ["model", *keys], [0.0, study.FOCUS], study.ANNUAL)


add("temporal_group_metrics", lambda s, d: _temporal(s, d, ["fold", "month"]), ask(temporal("dated", 'model, fold, "month"', _TWO)), _TMP, 8)
_IC_MONTH = summary("(SELECT *, strftime(timestamp, '%Y-%m') AS \"month\" FROM pred)", 'model, fold, "month"')


def _stability_sql() -> str:
    parts = []
    for kind, src, n, share in (("fold", "icf", "fold_count", "positive_fold_fraction"), ("month", "icm", "month_segment_count", "positive_month_rank_ic_fraction")):
        parts.append(f"(SELECT model, count(*) AS {n}, avg(mean_rank_ic) AS mean_{kind}_rank_ic, stddev_samp(mean_rank_ic) AS {kind}_rank_ic_std, min(mean_rank_ic) AS worst_{kind}_rank_ic, max(mean_rank_ic) AS best_{kind}_rank_ic, avg((mean_rank_ic > 0)::INT) AS {share} FROM {src} GROUP BY model)")
    for kind, src in (("fold", "tf"), ("month", "tm")):
        extra = ", avg((break_even_cost_bps > 0)::INT) AS positive_month_break_even_fraction" if kind == "month" else ""
        parts.append(f"(SELECT model, avg(break_even_cost_bps) AS mean_{kind}_break_even_cost_bps, min(break_even_cost_bps) AS worst_{kind}_break_even_cost_bps{extra} FROM {src} WHERE cost_bps = 0 GROUP BY model)")
        parts.append(f"(SELECT model, avg(pooled_annualized_net_return) AS mean_{kind}_annualized_net_return_at_focus_cost, min(pooled_annualized_net_return) AS worst_{kind}_annualized_net_return_at_focus_cost, avg((pooled_annualized_net_return > 0)::INT) AS positive_{kind}_fraction_at_focus_cost FROM {src} WHERE cost_bps = {study.FOCUS} GROUP BY model)")
    joined = parts[0] + "".join(f" JOIN {p} USING (model)" for p in parts[1:])
    return ask(
        f"SELECT *, {study.FOCUS}::DOUBLE AS focus_cost_bps FROM {joined}",
        f", icf AS ({summary('pred', 'model, fold')}), icm AS ({_IC_MONTH}), tf AS ({temporal('dated', 'model, fold', _TWO)}), tm AS ({temporal('dated', 'model, fold, \"month\"', _TWO)})",
    )


_STAB = " ".join(f"mean_{k}_rank_ic {k}_rank_ic_std worst_{k}_rank_ic best_{k}_rank_ic mean_{k}_break_even_cost_bps worst_{k}_break_even_cost_bps mean_{k}_annualized_net_return_at_focus_cost worst_{k}_annualized_net_return_at_focus_cost positive_{k}_fraction_at_focus_cost" for k in ("fold", "month"))
add(
    "stability_summary",
    study.stability,
    _stability_sql(), _STAB + " positive_fold_fraction positive_month_rank_ic_fraction positive_month_break_even_fraction", 8,
)
# Symbols
add("leave_one_symbol_out_ic", study.exclusion_ic, ask("SELECT * FROM xic"), _IC + " full_mean_rank_ic")
add("leave_one_symbol_out_portfolio", lambda s, d: C.sensitivity_break_even(study.exclusion_metrics(s, d), ["model", "excluded_symbol"]), ask(sensitivity("xcoh", "model, excluded_symbol")), _SENS, 8)
add("symbol_contribution", study.contributions, ask("SELECT * FROM contrib"), "long_selection_fraction short_selection_fraction active_selection_fraction mean_absolute_weight mean_gross_return_contribution cumulative_gross_log_return_contribution absolute_cumulative_contribution absolute_contribution_share portfolio_gross_cumulative_log_return")
add(
    "symbol_dependence",
    study.dependence,
    ask(f"""SELECT e.*, largest_absolute_contribution_symbol, largest_absolute_contribution_share, top_three_absolute_contribution_share, absolute_contribution_hhi FROM (
      SELECT model, count(*) AS excluded_symbol_count, max(full_mean_rank_ic) AS full_mean_rank_ic, avg(mean_rank_ic) AS mean_exclusion_rank_ic, min(mean_rank_ic) AS worst_exclusion_rank_ic, max(mean_rank_ic) AS best_exclusion_rank_ic,
        avg((mean_rank_ic > 0)::INT) AS positive_exclusion_rank_ic_fraction, max(abs(mean_rank_ic - full_mean_rank_ic)) AS maximum_absolute_rank_ic_delta,
        first(excluded_symbol ORDER BY round(abs(mean_rank_ic - full_mean_rank_ic), 12) DESC, excluded_symbol) AS most_influential_prediction_symbol, max(fb) AS full_break_even_cost_bps,
        avg(b) AS mean_exclusion_break_even_cost_bps, min(b) AS worst_exclusion_break_even_cost_bps, max(b) AS best_exclusion_break_even_cost_bps, avg((b > 0)::INT) AS positive_exclusion_break_even_fraction, max(abs(b - fb)) AS maximum_absolute_break_even_delta_bps,
        first(excluded_symbol ORDER BY round(abs(b - fb), 12) DESC, excluded_symbol) AS most_influential_economic_symbol, avg((pf > 0.5)::INT) AS positive_exclusion_fraction_at_focus_cost
      FROM xic JOIN (SELECT model, excluded_symbol, pooled_break_even_cost_bps AS b FROM ({sensitivity('xcoh', 'model, excluded_symbol')})) USING (model, excluded_symbol)
        JOIN (SELECT model, pooled_break_even_cost_bps AS fb FROM ({sensitivity('coh', 'model')})) USING (model)
        JOIN (SELECT model, excluded_symbol, avg((mean_net_return > 0)::INT) AS pf FROM xcoh WHERE cost_bps = {study.FOCUS} GROUP BY 1, 2) USING (model, excluded_symbol) GROUP BY model) e
      JOIN (SELECT model, first(symbol ORDER BY round(absolute_contribution_share, 12) DESC, symbol) AS largest_absolute_contribution_symbol, max(absolute_contribution_share) AS largest_absolute_contribution_share,
        list_sum(list_slice(list(absolute_contribution_share ORDER BY absolute_contribution_share DESC), 1, 3)) AS top_three_absolute_contribution_share, sum(absolute_contribution_share ** 2) AS absolute_contribution_hhi FROM contrib GROUP BY model) USING (model)"""),
    "full_mean_rank_ic mean_exclusion_rank_ic worst_exclusion_rank_ic best_exclusion_rank_ic positive_exclusion_rank_ic_fraction maximum_absolute_rank_ic_delta full_break_even_cost_bps mean_exclusion_break_even_cost_bps worst_exclusion_break_even_cost_bps best_exclusion_break_even_cost_bps positive_exclusion_break_even_fraction maximum_absolute_break_even_delta_bps positive_exclusion_fraction_at_focus_cost largest_absolute_contribution_share top_three_absolute_contribution_share absolute_contribution_hhi",
    8,
)
# Regimes
_ST = "market_return market_realized_volatility cross_sectional_dispersion"
add("market_state", study.states, ask(f'SELECT "timestamp", {_ST.replace(" ", ", ")} FROM states'), _ST)
add("regime_thresholds", study.thresholds, ask("SELECT * FROM thr"), " ".join(f"{x}_{n}" for x in _ST.split() for n in ("lower", "upper")))
add("regime_assignment", study.regimes, ask('SELECT fold, "timestamp", regime_dimension, regime FROM reg'))
add("regime_cells", study.regime_cells, ask("SELECT * FROM cells"), _IC)
add("regime_portfolio", study.regime_portfolio, ask("SELECT * FROM rport"), _TMP, 8)
_WORST = "first({c} ORDER BY round({v}, 12), fold, regime)"
add(
    "regime_summary",
    study.regime_summary,
    ask(f"""SELECT *, {study.FOCUS}::DOUBLE AS focus_cost_bps FROM (SELECT model, regime_dimension, count(*) AS regime_cell_count, avg(mean_rank_ic) AS mean_cell_rank_ic, min(mean_rank_ic) AS worst_cell_rank_ic, max(mean_rank_ic) AS best_cell_rank_ic,
        avg((mean_rank_ic > 0)::INT) AS positive_rank_ic_cell_fraction, {_WORST.format(c='fold', v='mean_rank_ic')} AS worst_rank_ic_fold, {_WORST.format(c='regime', v='mean_rank_ic')} AS worst_rank_ic_regime FROM cells GROUP BY 1, 2)
      JOIN (SELECT model, regime_dimension, avg(break_even_cost_bps) AS mean_break_even_cost_bps, min(break_even_cost_bps) AS worst_break_even_cost_bps, max(break_even_cost_bps) AS best_break_even_cost_bps,
        avg((break_even_cost_bps > 0)::INT) AS positive_break_even_cell_fraction, {_WORST.format(c='fold', v='break_even_cost_bps')} AS worst_break_even_fold, {_WORST.format(c='regime', v='break_even_cost_bps')} AS worst_break_even_regime FROM rport WHERE cost_bps = 0 GROUP BY 1, 2) USING (model, regime_dimension)
      JOIN (SELECT model, regime_dimension, avg(pooled_annualized_net_return) AS mean_annualized_net_return_at_focus_cost, min(pooled_annualized_net_return) AS worst_annualized_net_return_at_focus_cost,
        avg((pooled_annualized_net_return > 0)::INT) AS positive_cell_fraction_at_focus_cost FROM rport WHERE cost_bps = {study.FOCUS} GROUP BY 1, 2) USING (model, regime_dimension)"""),
    "mean_cell_rank_ic worst_cell_rank_ic best_cell_rank_ic positive_rank_ic_cell_fraction mean_break_even_cost_bps worst_break_even_cost_bps best_break_even_cost_bps positive_break_even_cell_fraction mean_annualized_net_return_at_focus_cost worst_annualized_net_return_at_focus_cost positive_cell_fraction_at_focus_cost",
    8,
)
# Resampling
_PERM = 50
_NULLS = f"""SELECT model, permutation, avg(x) AS mean_rank_ic, count(x) AS n_timestamps FROM (SELECT model, permutation, us, {corr('p', 't')} AS x FROM
    (SELECT l.model, l.permutation, l.us, l.pr AS p, r.tr AS t FROM drawn l JOIN drawn r ON l.model = r.model AND l.permutation = r.permutation AND l.us = r.us AND l.i = r.j) GROUP BY model, permutation, us) GROUP BY model, permutation"""
_DRAWN = f""", ranked AS (SELECT *, {avg_rank('prediction', 'model, us')} AS pr, {avg_rank('target', 'model, us')} AS tr FROM pred),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY model, permutation, us ORDER BY symbol) AS i, row_number() OVER (PARTITION BY model, permutation, us ORDER BY md5(concat_ws('|', permutation, us, symbol))) AS j
    FROM (SELECT model, us, symbol, pr, tr, unnest(generate_series(0, {_PERM - 1})) AS permutation FROM ranked))"""
add("permutation_null", lambda s, d: Z.permuted_ic(study.predictions(s, d), _PERM), ask(_NULLS, _DRAWN), "mean_rank_ic")


def _observed(s: SparkSession, d: str) -> DataFrame:
    return R.summarize_predictions(study.predictions(s, d)).select("model", F.col("mean_rank_ic").alias("observed_mean_rank_ic"))


add(
    "empirical_p_value",
    lambda s, d: Z.null_summary(Z.permuted_ic(study.predictions(s, d), _PERM), _observed(s, d)),
    ask(f"""SELECT model, max(o) AS observed_mean_rank_ic, avg(mean_rank_ic) AS null_mean_rank_ic, stddev_samp(mean_rank_ic) AS null_rank_ic_std, min(mean_rank_ic) AS null_min_rank_ic, max(mean_rank_ic) AS null_max_rank_ic,
      (max(o) - avg(mean_rank_ic)) / nullif(stddev_samp(mean_rank_ic), 0) AS observed_null_zscore, (count(*) FILTER (WHERE abs(mean_rank_ic) >= abs(o)) + 1) / (count(*) + 1) AS empirical_two_sided_p_value, count(*) AS permutations
      FROM ({_NULLS}) JOIN (SELECT model, mean_rank_ic AS o FROM ({summary('pred', 'model')})) USING (model) GROUP BY model""", _DRAWN),
    "observed_mean_rank_ic null_mean_rank_ic null_rank_ic_std null_min_rank_ic null_max_rank_ic observed_null_zscore empirical_two_sided_p_value",
)
_BLOCK = 6
_SUMS = f""", icm AS ({ic('pred', 'model')}),
  placed_ic AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY us) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n, coalesce(rank_ic, 0) AS v FROM icm),
  twice AS (SELECT * FROM placed_ic UNION ALL SELECT model, pos + n, n, v FROM placed_ic WHERE pos < {_BLOCK - 1}),
  sums AS (SELECT * FROM (SELECT model, pos, n, sum(v) OVER (PARTITION BY model ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_BLOCK - 1} FOLLOWING) AS block_sum FROM twice) WHERE pos < n)"""


def _ic_series(s: SparkSession, d: str) -> DataFrame:
    return R.rank_ic(study.predictions(s, d), ["model"]).withColumn("rank_ic", F.coalesce("rank_ic", F.lit(0.0)))


add("circular_block_sums", lambda s, d: Z.circular_block_sums(_ic_series(s, d), "rank_ic", _BLOCK, ["model"]), ask("SELECT model, pos AS \"at\", n, block_sum FROM sums", _SUMS), "block_sum")
_RES = 1000
_INDEX = "('0x' || substr(md5(concat_ws('|', 7, resample, {})), 1, 7))::BIGINT % n"
_BOOT = f"""SELECT model, resample, sum(v) / max(n) AS mean_value FROM (
    SELECT d.model, resample, d.n, s.block_sum AS v FROM (SELECT model, n, resample, {_INDEX.format("block")} AS pos FROM (SELECT *, unnest(generate_series(0, n // {_BLOCK} - 1)) AS block FROM draws)) d JOIN sums s USING (model, pos)
    UNION ALL SELECT d.model, resample, d.n, p.v FROM (SELECT model, n, resample, (first + step) % n AS pos FROM (
      SELECT model, n, resample, {_INDEX.format("'rest'")} AS first, unnest(generate_series(0, n % {_BLOCK} - 1)) AS step FROM draws)) d JOIN placed_ic p USING (model, pos)) GROUP BY model, resample"""
_SUMS_DRAWS = _SUMS + f""", draws AS (SELECT model, n, unnest(generate_series(0, {_RES - 1})) AS resample FROM (SELECT model, max(n) AS n FROM sums GROUP BY model))"""


def _boot(s: SparkSession, d: str) -> DataFrame:
    return Z.md5_block_bootstrap(_ic_series(s, d), "rank_ic", _BLOCK, _RES, 7, ["model"])


add("block_bootstrap_means", _boot, ask(_BOOT, _SUMS_DRAWS), "mean_value")
add(
    "bootstrap_summary",
    lambda s, d: Z.bootstrap_summary(_boot(s, d), "mean_value", 0.95, ["model"]),
    ask(f"SELECT model, count(*) AS resamples, avg(mean_value) AS bootstrap_mean, stddev_samp(mean_value) AS bootstrap_std, quantile_cont(mean_value, {(1 - 0.95) / 2}) AS confidence_lower, quantile_cont(mean_value, {1 - (1 - 0.95) / 2}) AS confidence_upper, avg((mean_value > 0)::INT) AS probability_positive FROM ({_BOOT}) GROUP BY model", _SUMS_DRAWS),
    "bootstrap_mean bootstrap_std confidence_lower confidence_upper probability_positive",
)
add("seeded_block_bootstrap", lambda s, d: Z.seeded_block_bootstrap(R.rank_ic(study.predictions(s, d), ["model"]).withColumn("seed", F.lit(11)), ["rank_ic"], 12, _RES, "seed", ["model"]), None)
add("seeded_portfolio_bootstrap", lambda s, d: Z.seeded_block_bootstrap(study.periods(s, d).withColumn("seed", F.lit(50_011) + F.col("cohort") * 100_003), ["gross_return", "turnover"], 3, _RES, "seed", ["model", "cohort"]).groupBy("model", "resample").agg(F.avg("gross_return").alias("gross_return"), F.avg("turnover").alias("turnover")), None)
add("seeded_permutation_null", lambda s, d: Z.seeded_permutation_ic(study.predictions(s, d), _PERM, 42), None)
# Models
_RIDGE = X.FEATURES
_WHOLE = " AND ".join(f"{f} IS NOT NULL" for f in _RIDGE)
_TERMS = ["1", *_RIDGE, "target"]
_GRAM_SUMS = [(a, b) for i, a in enumerate(_TERMS) for b in _TERMS[i:]]
_GRAM = f"""SELECT fold, x.a AS a, x.b AS b, x.value AS value FROM (SELECT fold, unnest([{', '.join(f"{{'a': '{a}', 'b': '{b}', 'value': sum({'1.0::DOUBLE' if a == '1' else a} * {'1.0::DOUBLE' if b == '1' else b})}}" for a, b in _GRAM_SUMS)}]) AS x
    FROM split WHERE split = 'train' AND {_WHOLE} GROUP BY fold)"""


def _whole_rows(s: SparkSession, d: str) -> DataFrame:
    return study.split_panel(s, d).dropna(subset=_RIDGE)


add("ridge_gram_matrix", lambda s, d: M.gram_matrix(_whole_rows(s, d).where("split = 'train'"), _RIDGE), ask(_GRAM), "value", 6)
_ALPHAS = [0.1, 1.0, 10.0, 100.0]


def _ridge_sql() -> str:
    """Subqueries that solve the normal equations of each fold and penalty by elimination, unrolled, and score the validation rows."""
    k = range(len(_RIDGE))
    sums = [f"sum({_RIDGE[i]} * {_RIDGE[j]}) - sum({_RIDGE[i]}) * avg({_RIDGE[j]}) AS x{i}_{j}" for i in k for j in k if j >= i]
    sums += [f"sum({_RIDGE[i]} * target) - sum({_RIDGE[i]}) * avg(target) AS y{i}, avg({_RIDGE[i]}) AS m{i}" for i in k]
    out = f", normal AS (SELECT fold, avg(target) AS my, {', '.join(sums)} FROM split WHERE split = 'train' AND {_WHOLE} GROUP BY fold)"
    out += f", e0 AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'x{i}_{i} + alpha AS x{i}_{i}' for i in k)}) FROM (SELECT *, unnest({[float(a) for a in _ALPHAS]}::DOUBLE[]) AS alpha FROM normal))"
    for p in k[:-1]:
        rows = [f"x{i}_{j} - x{p}_{i} * x{p}_{j} / x{p}_{p} AS x{i}_{j}" for i in k if i > p for j in k if j >= i] + [f"y{i} - x{p}_{i} * y{p} / x{p}_{p} AS y{i}" for i in k if i > p]
        out += f", e{p + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(rows)}) FROM e{p})"
    last = f"e{len(_RIDGE) - 1}"
    for i in reversed(k):
        solved = f"(y{i}{''.join(f' - x{i}_{j} * b{j}' for j in k if j > i)}) / x{i}_{i} AS b{i}"
        out += f", s{i} AS MATERIALIZED (SELECT *, {solved} FROM {last})"
        last = f"s{i}"
    score = "my" + "".join(f" + b{i} * ({f} - m{i})" for i, f in enumerate(_RIDGE))
    return out + f", ridge AS (SELECT fold, alpha, us, \"timestamp\", symbol, target, {score} AS prediction FROM split JOIN {last} USING (fold) WHERE split = 'validation' AND {_WHOLE})"


def _ridge_validation(s: SparkSession, d: str) -> DataFrame:
    rows = _whole_rows(s, d)
    fitted = M.fit_ridge(rows.where("split = 'train'"), _RIDGE, _ALPHAS)
    return M.score_by_fold(rows.where("split = 'validation'"), fitted)


add(
    "ridge_alpha_selection",
    lambda s, d: M.first_best(R.summarize_predictions(_ridge_validation(s, d), ["fold", "alpha"]), "mean_rank_ic", ["fold"]),
    ask(f"SELECT fold, first(alpha ORDER BY mean_rank_ic DESC NULLS LAST, alpha) AS alpha, max(mean_rank_ic) AS mean_rank_ic FROM ({summary('ridge', 'fold, alpha')}) GROUP BY fold", _ridge_sql()),
    "mean_rank_ic", 6,
)
add(
    "ridge_predictions",
    lambda s, d: _ridge_validation(s, d).select("fold", "alpha", "timestamp", "symbol", "target", "prediction"),
    ask('SELECT fold, alpha, "timestamp", symbol, target, prediction FROM ridge', _ridge_sql()),
    "target prediction", 6,
)
add(
    "momentum_reversal_identity",
    lambda s, d: K.identity_error(study.predictions(s, d)),
    ask("SELECT count(*) FILTER (WHERE n = 2) AS paired_rows, max(abs(s)) AS max_sum FROM (SELECT fold, us, symbol, sum(prediction) AS s, count(*) AS n FROM pred GROUP BY 1, 2, 3)"),
    "max_sum",
)
_LATEST = "(SELECT * FROM predictions WHERE isfinite(prediction) AND isfinite(target) QUALIFY row_number() OVER (PARTITION BY model, variant, fold, \"timestamp\", symbol, member ORDER BY loaded_at DESC NULLS LAST, pred_id DESC) = 1)"


def _variant_errors(s: SparkSession, d: str) -> DataFrame:
    keys = ["model", "variant", "fold", "timestamp", "symbol", "member"]
    rows = table(s, d, "predictions").where(is_finite(F.col("prediction")) & is_finite(F.col("target")))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("prediction", "target"), F.struct("loaded_at", "pred_id")).alias("x")).select(*keys, "x.*")
    e = F.col("prediction") - F.col("target")
    return last.groupBy("model", "variant").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_rows"))


add(
    "delta_vs_full_variant",
    lambda s, d: M.delta_vs_full(_variant_errors(s, d), ["rmse", "mae"]),
    f"""WITH v AS (SELECT model, variant, sqrt(avg((prediction - target) ** 2)) AS rmse, avg(abs(prediction - target)) AS mae, count(*) AS n_rows FROM {_LATEST} GROUP BY 1, 2)
      SELECT v.*, f.rmse AS full_rmse, f.mae AS full_mae, v.rmse - f.rmse AS rmse_delta_vs_full, v.mae - f.mae AS mae_delta_vs_full FROM v LEFT JOIN (SELECT * FROM v WHERE variant = 'full') f USING (model)""",
    "rmse mae full_rmse full_mae rmse_delta_vs_full mae_delta_vs_full",
)
# Sequences
_LEN = 128
add("sequence_endpoints", lambda s, d: E.sequence_endpoints(study.bars(s, d), _LEN), ask(f'SELECT make_timestamp(us) AS "timestamp", pos AS position FROM (SELECT us, row_number() OVER (ORDER BY us) - 1 AS pos FROM (SELECT DISTINCT us FROM pb)) WHERE pos >= {_LEN - 1}'))
add("endpoint_subsample", lambda s, d: E.subsample_endpoints(E.sequence_endpoints(study.bars(s, d), _LEN), 6), ask(f'SELECT make_timestamp(us) AS "timestamp", pos AS position FROM (SELECT us, row_number() OVER (ORDER BY us) - 1 AS pos FROM (SELECT DISTINCT us FROM pb)) WHERE pos >= {_LEN - 1} AND (pos - {_LEN - 1}) % 6 = 0'))


def _windows(s: SparkSession, d: str) -> DataFrame:
    rows = study.labelled(s, d).where("return_1 is not null and target is not null")
    return E.sequence_windows(rows, ["return_1", "log_range"], _LEN)


add(
    "sequence_windows",
    lambda s, d: _windows(s, d).select("timestamp", "symbol", F.size("window").alias("length"), F.get(F.get("window", F.lit(0)), F.lit(0)).cast("double").alias("oldest_return"), F.get(F.get("window", F.lit(_LEN - 1)), F.lit(0)).cast("double").alias("newest_return")),
    ask(f"""SELECT "timestamp", symbol, {_LEN} AS length, o::FLOAT::DOUBLE AS oldest_return, return_1::FLOAT::DOUBLE AS newest_return FROM (SELECT *, lag(return_1, {_LEN - 1}) OVER (PARTITION BY symbol ORDER BY us) AS o,
      row_number() OVER (PARTITION BY symbol ORDER BY us) AS n FROM lab WHERE return_1 IS NOT NULL AND target IS NOT NULL) WHERE n >= {_LEN}"""),
    "oldest_return newest_return", 6,
)
# Checks
add(
    "reproduction_gate",
    lambda s, d: K.reproduction_error(C.at_cost(study.metrics(s, d), 0.0), C.at_cost(C.at_cost(study.breadth_metrics(s, d), 0.0).where("top_count = 1"), 0.0), ["model", "cohort"], ["mean_net_return", "mean_turnover"]),
    ask("SELECT count(a.model) AS source_rows, count(b.model) AS reproduced_rows, count(a.model) FILTER (WHERE b.model IS NOT NULL) AS matched_rows, max(abs(a.mean_net_return - b.mean_net_return)) AS max_mean_net_return_error, max(abs(a.mean_turnover - b.mean_turnover)) AS max_mean_turnover_error FROM (SELECT * FROM coh WHERE cost_bps = 0) a FULL JOIN (SELECT * FROM bcoh WHERE cost_bps = 0 AND top_count = 1) b ON a.model = b.model AND a.cohort = b.cohort"),
    "max_mean_net_return_error max_mean_turnover_error",
)
add(
    "key_alignment",
    lambda s, d: K.key_differences(table(s, d, "contracts"), table(s, d, "market_bars"), ["symbol"]),
    "SELECT symbol, 'missing' AS side FROM (SELECT DISTINCT symbol FROM contracts) ANTI JOIN market_bars USING (symbol) UNION ALL SELECT symbol, 'unexpected' FROM (SELECT DISTINCT symbol FROM market_bars) ANTI JOIN contracts USING (symbol)",
)
add("model_alignment", lambda s, d: K.model_alignment(study.predictions(s, d)), ask('SELECT m AS model_count, count(*) AS key_count, max(dd) AS max_target_difference FROM (SELECT us, symbol, count(DISTINCT model) AS m, max(target) - min(target) AS dd FROM pred GROUP BY 1, 2) GROUP BY m'), "max_target_difference")
add("prediction_validation", lambda s, d: K.validate_predictions(study.predictions(s, d)), ask("SELECT unnest(['empty', 'not_finite', 'duplicate_keys']) AS \"check\", unnest([(count(*) = 0)::BIGINT, count(*) FILTER (WHERE NOT isfinite(prediction) OR NOT isfinite(target)), (SELECT count(*) FROM (SELECT 1 FROM pred GROUP BY model, fold, us, symbol HAVING count(*) > 1))]) AS violations FROM pred"))
add(
    "label_execution_audit",
    lambda s, d: K.alignment_audit(
        study.panel(s, d).select("symbol", "timestamp", "label_end_timestamp", "raw_target"),
        S.horizon_reference(study.bars(s, d), [study.HOLDING], study.WEEK),
    ),
    ask(f"""SELECT p.symbol, count(*) AS panel_rows, min(p."timestamp") AS first_panel_timestamp, max(p."timestamp") AS last_panel_timestamp, max(abs(p.end_us - h.end_us)) AS max_label_end_error_us, max(abs(p.raw_target - h.raw_target)) AS max_raw_target_abs_error,
      avg(p.raw_target) AS mean_raw_target, avg(h.execution_return) AS mean_execution_return, avg(h.execution_return - p.raw_target) AS mean_execution_minus_label, avg(abs(h.execution_return - p.raw_target)) AS mean_abs_execution_minus_label
      FROM panel p LEFT JOIN (SELECT * FROM href WHERE horizon_bars = 12) h USING (symbol, us) GROUP BY p.symbol""", _PANEL),
    "max_raw_target_abs_error mean_raw_target mean_execution_return mean_execution_minus_label mean_abs_execution_minus_label",
)
add(
    "evidence_star_join",
    lambda s, d: R.summarize_predictions(study.predictions(s, d)).select("model", "mean_rank_ic")
    .join(C.break_even_summary(study.break_even(s, d), study.ANNUAL, [0.0]).select("model", "pooled_break_even_cost_bps"), "model")
    .join(Z.bootstrap_summary(_boot(s, d), "mean_value", 0.95, ["model"]).select("model", "confidence_lower", "confidence_upper"), "model"),
    ask(f"""SELECT * FROM (SELECT model, mean_rank_ic FROM ({summary('pred', 'model')})) JOIN (SELECT model, sum(gross_cumulative_log_return) / sum(total_turnover) * 10000 AS pooled_break_even_cost_bps FROM becoh GROUP BY 1) USING (model)
      JOIN (SELECT model, quantile_cont(mean_value, {(1 - 0.95) / 2}) AS confidence_lower, quantile_cont(mean_value, {1 - (1 - 0.95) / 2}) AS confidence_upper FROM ({_BOOT}) GROUP BY model) USING (model)""", _SUMS_DRAWS),
    "mean_rank_ic pooled_break_even_cost_bps confidence_lower confidence_upper", 8,
)
add(
    "cohort_validation",
    lambda s, d: K.cohort_violations(study.break_even(s, d), study.HOLDING),
    ask(f"""SELECT model, {study.HOLDING} - count(DISTINCT cohort) FILTER (WHERE cohort BETWEEN 0 AND {study.HOLDING - 1}) AS missing_cohorts, count(*) FILTER (WHERE cohort NOT BETWEEN 0 AND {study.HOLDING - 1}) AS unexpected_cohorts,
      count(*) - count(DISTINCT cohort) AS repeated_cohorts, count(*) FILTER (WHERE NOT isfinite(gross_mean_return) OR NOT isfinite(mean_turnover) OR NOT isfinite(gross_cumulative_log_return) OR period_count <= 0 OR mean_turnover <= 0) AS unusable_rows
      FROM becoh GROUP BY model"""),
)
#: Labels that the coverage gate must find missing: one dimension in every March.
_GAP = "regime_dimension = 'market_return' AND month(timestamp) = 3"
add(
    "regime_coverage_gate",
    lambda s, d: K.coverage_violations(study.regimes(s, d).where(f"NOT ({_GAP})"), study.predictions(s, d), ["fold", "timestamp"], 3),
    ask(f'SELECT * FROM (SELECT e.fold, e."timestamp", count(r.regime) AS assigned_rows FROM (SELECT DISTINCT fold, "timestamp" FROM pred) e LEFT JOIN (SELECT * FROM reg WHERE NOT ({_GAP})) r USING (fold, "timestamp") GROUP BY 1, 2) WHERE assigned_rows <> 3'),
)
_PANEL_CHECKS = {
    "empty": "(count(*) = 0)::BIGINT", "repeated_keys": "sum(n - held)", "features_not_finite": "sum(f)", "targets_not_finite": "sum(t)", "incomplete_cross_sections": "count(*) FILTER (WHERE held <> 20)",
    "targets_not_centred": "count(*) FILTER (WHERE abs(m) > 1e-12)", "available_after_label_end": "sum(late)",
}
add(
    "panel_gate",
    lambda s, d: X.panel_violations(study.labelled(s, d).dropna(subset=[*X.FEATURES, "raw_target", "label_end_time"]).withColumn("target", F.col("target") + F.when(F.month("timestamp") == 5, 1e-6).otherwise(0.0)), X.FEATURES, 20),
    ask(f"""SELECT unnest({list(_PANEL_CHECKS)}) AS "check", unnest([{', '.join(f'coalesce({v}, 0)::BIGINT' for v in _PANEL_CHECKS.values())}]) AS violations FROM (
      SELECT us, count(*) AS n, count(DISTINCT symbol) AS held, count(*) FILTER (WHERE {' OR '.join(f'NOT isfinite({f})' for f in X.FEATURES)}) AS f, count(*) FILTER (WHERE NOT isfinite(raw_target) OR NOT isfinite(target)) AS t,
        avg(target + CASE WHEN month("timestamp") = 5 THEN 1e-6 ELSE 0 END) AS m, count(*) FILTER (WHERE us + {study.WEEK} - 1000 > end_us + {study.WEEK} - 1000) AS late FROM lab WHERE {_WHOLE} AND raw_target IS NOT NULL GROUP BY us)"""),
)
add(
    "endpoint_coverage",
    lambda s, d: E.endpoint_coverage(study.split_panel(s, d).where("fold = 2"), _LEN),
    ask(f"""SELECT split, count(*) AS timestamps, count(*) FILTER (WHERE pos >= {_LEN - 1}) AS endpoints, count(*) FILTER (WHERE pos < {_LEN - 1}) AS excluded_for_history,
      min(make_timestamp(us)) FILTER (WHERE pos >= {_LEN - 1}) AS first_endpoint, max(make_timestamp(us)) FILTER (WHERE pos >= {_LEN - 1}) AS last_endpoint
      FROM (SELECT us, min(split) AS split, count(DISTINCT split) AS k, row_number() OVER (ORDER BY us) - 1 AS pos FROM split WHERE fold = 2 GROUP BY us) WHERE k = 1 AND split <> 'purged' GROUP BY split"""),
)
add(
    "panel_shape_gate",
    lambda s, d: E.panel_shape_violations(study.labelled(s, d).dropna(subset=["return_12", "target"]), ["return_1", "return_12"], study.WEEK),
    ask(f"""SELECT unnest(['empty', 'repeated_keys', 'incomplete_sections', 'not_finite', 'off_grid']) AS "check", unnest([(count(*) = 0)::BIGINT, count(*) FILTER (WHERE n <> held), count(*) FILTER (WHERE held <> width),
      coalesce(sum(bad), 0)::BIGINT, count(*) FILTER (WHERE us <> start + pos * {study.WEEK})]) AS violations FROM (SELECT *, row_number() OVER (ORDER BY us) - 1 AS pos, min(us) OVER () AS start FROM (
        SELECT us, count(*) AS n, count(DISTINCT symbol) AS held, count(*) FILTER (WHERE NOT isfinite(return_1) OR NOT isfinite(return_12) OR NOT isfinite(target)) AS bad FROM lab WHERE return_12 IS NOT NULL AND target IS NOT NULL GROUP BY us)),
      (SELECT count(DISTINCT symbol) AS width FROM lab WHERE return_12 IS NOT NULL AND target IS NOT NULL)"""),
)
add(
    "best_model_per_horizon",
    lambda s, d: best_per_group(R.summarize_predictions(study.horizon_joined(s, d), ["model", "horizon_bars"]), ["horizon_bars"], "mean_rank_ic"),
    ask(f"SELECT horizon_bars, first(model ORDER BY mean_rank_ic DESC, model) AS model, max(mean_rank_ic) AS mean_rank_ic FROM ({summary('hjoin', 'model, horizon_bars')}) GROUP BY horizon_bars"),
    "mean_rank_ic",
)
# Sources and streaming
add(
    "archive_plan",
    lambda s, d: archive_plan(table(s, d, "contracts"), "5m", "2025-01", "2025-12"),
    """SELECT symbol, strftime(m, '%Y-%m') AS "month", symbol || '-5m-' || strftime(m, '%Y-%m') || '.zip' AS filename, symbol || '-5m-' || strftime(m, '%Y-%m') || '.zip.CHECKSUM' AS checksum_name
      FROM (SELECT DISTINCT symbol FROM contracts), (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-01', INTERVAL 1 MONTH)) AS m)""",
)
add(
    "file_inventory",
    lambda s, d: file_hashes(s, d).where("path LIKE '%.parquet'").withColumn("path", F.regexp_extract("path", "[^/]+$", 0)),
    # A view cannot name its files, so this one is for the scale at which results are compared.
    "SELECT parse_filename(filename) AS path, size AS bytes, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/*.parquet')",
)
_ORDER = "[epoch_us(ts), event_id]"
add(
    "streaming_bars_on_a_table",
    lambda s, d: streaming_bars(table(s, d, "events"), "event_type", "ts", "value", F.lit(1.0), ["ts", "event_id"], "1 hour", "1 hour").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")),
    f"""SELECT date_trunc('hour', ts) AS "timestamp", event_type AS symbol, arg_min(value, {_ORDER}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {_ORDER}) AS close,
      count(*)::DOUBLE AS volume, sum(value) AS quote_volume, count(*) AS trade_count FROM events GROUP BY 1, 2""",
    "quote_volume", 6,
)
# Audits and gates over whole steps
add("shift_summary", lambda s, d: R.shift_summary(R.shifted_rank_ic(study.predictions(s, d), _SHIFTS)), f"""SELECT model, shift_bars, sum(mean_rank_ic * n_timestamps) / sum(n_timestamps) FILTER (WHERE mean_rank_ic IS NOT NULL) AS mean_rank_ic, avg(mean_rank_ic) AS mean_fold_rank_ic,
  min(mean_rank_ic) AS worst_fold_rank_ic, max(mean_rank_ic) AS best_fold_rank_ic, sum(n_timestamps)::BIGINT AS n_timestamps FROM ({_SHIFTED}) GROUP BY model, shift_bars""", "mean_rank_ic mean_fold_rank_ic worst_fold_rank_ic best_fold_rank_ic")
add(
    "split_audit",
    lambda s, d: L.split_audit(study.split_panel(s, d)),
    ask("""SELECT fold, split, count(*) AS rows, count(DISTINCT us) AS timestamps, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp, max(label_end_timestamp) AS last_label_end_timestamp
      FROM split WHERE split <> 'purged' GROUP BY fold, split"""),
)
add(
    "contiguous_bars",
    lambda s, d: study.bars(s, d).withColumn("follows", B.contiguous(study.bars(s, d), study.WEEK)).groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(~F.col("follows")).alias("gaps")),
    ask(f"SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE step <> {study.WEEK}) AS gaps FROM (SELECT symbol, us - lag(us) OVER (PARTITION BY symbol ORDER BY us) AS step FROM pb) GROUP BY symbol"),
)
_FLOATS = [f for f in _SCALED if not f.startswith(("time_of_day", "weekday"))]
_FLOAT_STATS = "max({c}) FILTER (WHERE feature = '{f}')::FLOAT"
add(
    "float_scaled_panel",
    lambda s, d: N.apply_robust_scaler(study.split_panel(s, d).where("split = 'test'"), _scaler(s, d), _SCALED, float_first=True).select("fold", "symbol", "timestamp", *[F.col(f).cast("double").alias(f) for f in _FLOATS]),
    ask(f"""SELECT fold, symbol, "timestamp", {', '.join(f"((s.{f}::FLOAT - {_FLOAT_STATS.format(c='q.median', f=f)})::FLOAT / {_FLOAT_STATS.format(c='q.scale', f=f)})::DOUBLE AS {f}" for f in _FLOATS)}
      FROM split s JOIN ({_SCALER}) q USING (fold) WHERE split = 'test' GROUP BY fold, symbol, "timestamp", {', '.join('s.' + f for f in _FLOATS)}"""),
    " ".join(_FLOATS), 4,
)
add(
    "inventory_digest",
    lambda s, d: inventory_digest_column(file_hashes(s, d).where("path LIKE '%.parquet'").withColumn("path", F.regexp_extract("path", "[^/]+$", 0))),
    "SELECT sha256(string_agg(path || chr(0) || h || chr(10), '' ORDER BY path)) AS digest FROM (SELECT parse_filename(filename) AS path, sha256(content) AS h FROM read_blob('/root/testdata/sf0.01/*.parquet'))",
)
add(
    "execution_alignment",
    lambda s, d: K.execution_alignment(study.predictions(s, d), S.horizon_reference(study.bars(s, d), [study.HOLDING], study.WEEK)),
    ask(f"""SELECT fold, count(*) AS rows, count(*) FILTER (WHERE execution_return IS NULL) AS without_execution, count(*) FILTER (WHERE make_timestamp(end_us) IS DISTINCT FROM label_end_timestamp) AS other_label_end,
      avg(execution_return - raw_target) AS mean_execution_minus_label, avg(abs(execution_return - raw_target)) AS mean_abs_execution_minus_label
      FROM pred LEFT JOIN (SELECT symbol, us, end_us, execution_return FROM href WHERE horizon_bars = {study.HOLDING}) USING (symbol, us) GROUP BY fold"""),
    "mean_execution_minus_label mean_abs_execution_minus_label",
)
#: Cohorts that the gates must find missing.
_LOST = f"cost_bps = {study.FOCUS} AND cohort = 7"
add(
    "cohort_set_gate",
    lambda s, d: K.cohort_set_differences(study.metrics(s, d).where(f"NOT ({_LOST})"), ["model"], 0.0, study.FOCUS),
    ask(f"SELECT model, cohort, 'missing' AS side FROM coh WHERE cost_bps = 0 AND (model, cohort) NOT IN (SELECT (model, cohort) FROM coh WHERE cost_bps = {study.FOCUS} AND NOT ({_LOST}))"),
)
add(
    "horizon_gate",
    lambda s, d: S.horizon_violations(S.horizon_targets(S.horizon_reference(study.bars(s, d), study.HORIZONS, study.WEEK)), 20),
    ask("""SELECT horizon_bars, count(*) AS timestamps, count(*) FILTER (WHERE n <> 20) AS incomplete_cross_sections, count(*) FILTER (WHERE abs(m) > 1e-12) AS targets_not_centred
      FROM (SELECT horizon_bars, us, count(DISTINCT symbol) AS n, avg(target) AS m FROM htar GROUP BY 1, 2) GROUP BY horizon_bars"""),
)
add(
    "month_coverage_gate",
    lambda s, d: K.key_differences(
        study.predictions(s, d).withColumn("month", T.month()), study.dated_periods(s, d).where("NOT (fold = 2 AND month LIKE '%-03')"), ["model", "fold", "month"]
    ),
    ask("""SELECT DISTINCT model, fold, strftime("timestamp", '%Y-%m') AS "month", 'missing' AS side FROM pred
      WHERE (model, fold, strftime("timestamp", '%Y-%m')) NOT IN (SELECT (model, fold, "month") FROM dated WHERE NOT (fold = 2 AND "month" LIKE '%-03'))"""),
)
_FAMILY = {"momentum": "trend", "reversal": "contrarian"}


def _families(s: SparkSession, d: str) -> DataFrame:
    steps = study.Steps(s, d, settle=True)
    intervals = Z.bootstrap_summary(Z.md5_block_bootstrap(R.rank_ic(steps.predictions, ["model"]).withColumn("rank_ic", F.coalesce("rank_ic", F.lit(0.0))), "rank_ic", _BLOCK, _RES, 7, ["model"]), "mean_value", 0.95, ["model"])
    oos = R.summarize_predictions(steps.predictions).select("model", "mean_rank_ic")
    costs = C.break_even_summary(steps.break_even, study.ANNUAL, [0.0])
    return family_summary(oos, costs, intervals.select("model", "confidence_lower", "confidence_upper"), _FAMILY, ["reversal"])


add(
    "family_summary",
    _families,
    ask(f"""SELECT *, CASE model {' '.join(f"WHEN '{m}' THEN '{f}'" for m, f in _FAMILY.items())} END AS model_family, mean_rank_ic - max(mean_rank_ic) FILTER (WHERE model = 'reversal') OVER () AS rank_ic_delta_vs_reversal,
        pooled_break_even_cost_bps - max(pooled_break_even_cost_bps) FILTER (WHERE model = 'reversal') OVER () AS break_even_delta_vs_reversal_bps
      FROM (SELECT model, mean_rank_ic FROM ({summary('pred', 'model')})) JOIN (SELECT model, sum(gross_cumulative_log_return) / sum(total_turnover) * 10000 AS pooled_break_even_cost_bps FROM becoh GROUP BY 1) USING (model)
      JOIN (SELECT model, quantile_cont(mean_value, {(1 - 0.95) / 2}) AS confidence_lower, quantile_cont(mean_value, {1 - (1 - 0.95) / 2}) AS confidence_upper FROM ({_BOOT}) GROUP BY model) USING (model)""", _SUMS_DRAWS),
    "mean_rank_ic pooled_break_even_cost_bps confidence_lower confidence_upper rank_ic_delta_vs_reversal break_even_delta_vs_reversal_bps", 8,
)
# The ablation scores: every (model, variant) of the predictions table as a portfolio of two symbols a side
_VARIANT_KEYS, _VARIANT_TOP, _VARIANT_ANNUAL = ["model", "variant"], 2, 8760.0


def _variant_scores(s: SparkSession, d: str) -> DataFrame:
    """The latest finite scores, members averaged; the raw target stands for the execution return."""
    keys = ["model", "variant", "fold", "timestamp", "symbol"]
    rows = table(s, d, "predictions").where(is_finite(F.col("prediction")) & is_finite(F.col("target")) & is_finite(F.col("raw_target")) & F.col("timestamp").isNotNull())
    last = rows.groupBy(*keys, "member").agg(F.max_by(F.struct("prediction", "target", "raw_target"), F.struct("loaded_at", "pred_id")).alias("x")).select(*keys, "x.*")
    return last.groupBy(*keys).agg(F.round(F.avg("prediction"), 9).alias("prediction"), F.round(F.avg("target"), 9).alias("target"), F.round(F.avg("raw_target"), 9).alias("execution_return"))


def _variants(s: SparkSession, d: str) -> DataFrame:
    rows = written(_variant_scores(s, d), "variants")
    held = P.rank_weights(rows, _VARIANT_TOP, [*_VARIANT_KEYS, "fold"], short="skip")
    cohorts = P.cohort_metrics(P.portfolio_periods(held, FIVE_MINUTES, study.HOLDING, _VARIANT_KEYS), [0.0], _VARIANT_ANNUAL, _VARIANT_KEYS)
    portfolio = C.sensitivity_break_even(cohorts, _VARIANT_KEYS).withColumnRenamed("mean_turnover", "portfolio_mean_turnover")
    return M.delta_vs_full(R.summarize_predictions(rows, [*_VARIANT_KEYS]).select(*_VARIANT_KEYS, "mean_rank_ic", "n_rows"), ["mean_rank_ic"]).join(portfolio, _VARIANT_KEYS)


_VARIANT_ROWS = """vlast AS (SELECT * FROM predictions WHERE isfinite(prediction) AND isfinite(target) AND isfinite(raw_target) AND "timestamp" IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY model, variant, fold, "timestamp", symbol, member ORDER BY loaded_at DESC NULLS LAST, pred_id DESC) = 1),
  vs AS (SELECT model, variant, fold, symbol, epoch_us("timestamp") AS us, round(avg(prediction), 9) AS prediction, round(avg(target), 9) AS target, round(avg(raw_target), 9) AS execution_return FROM vlast GROUP BY ALL)"""
add(
    "variant_portfolio_summary",
    _variants,
    f"""WITH {_VARIANT_ROWS}, vw AS ({weights('vs', 'model, variant, fold', str(_VARIANT_TOP))}), vp AS ({periods('vw', 'model, variant', study.HOLDING, FIVE_MINUTES)}),
      vc AS ({cohort_metrics('vp', 'model, variant', '[0.0::DOUBLE]').replace(f'* {study.ANNUAL}', f'* {_VARIANT_ANNUAL}').replace(f'sqrt({study.ANNUAL})', f'sqrt({_VARIANT_ANNUAL})')}),
      vi AS (SELECT model, variant, mean_rank_ic, n_rows FROM ({summary('vs', 'model, variant')}))
      SELECT vi.*, f.mean_rank_ic AS full_mean_rank_ic, vi.mean_rank_ic - f.mean_rank_ic AS mean_rank_ic_delta_vs_full, s.* EXCLUDE (model, variant, mean_turnover), s.mean_turnover AS portfolio_mean_turnover
      FROM vi LEFT JOIN (SELECT model, mean_rank_ic FROM vi WHERE variant = 'full') f USING (model) JOIN ({sensitivity('vc', 'model, variant')}) s USING (model, variant)""",
    "mean_rank_ic full_mean_rank_ic mean_rank_ic_delta_vs_full portfolio_mean_turnover " + _BE + " mean_gross_annualized_return mean_zero_cost_sharpe positive_cohort_fraction",
)
