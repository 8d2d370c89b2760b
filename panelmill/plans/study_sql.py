"""The steps of ``study`` in SQL, as named subqueries that later ones build on."""

from __future__ import annotations

from panelmill.operators.features import FEATURES
from panelmill.plans import study

_W, _M = study.WEEK, study.MONDAY
_H, _A = study.HOLDING, study.ANNUAL
_COSTS = "[" + ", ".join(f"{c}::DOUBLE" for c in study.COSTS) + "]"


def _full(n: int, agg: str, x: str) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def _z(x: str, n: int) -> str:
    return f"({x} - {_full(n, 'avg', x)}) / nullif({_full(n, 'stddev_pop', x)}, 0)"


def avg_rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def corr(a: str, b: str) -> str:
    va, vb = (f"(count({x}) * sum({x} * {x}) - sum({x}) ** 2)" for x in (a, b))
    return f"CASE WHEN {va} > 0 AND {vb} > 0 THEN (count({a}) * sum({a} * {b}) - sum({a}) * sum({b})) / sqrt({va} * {vb}) END"


def ic(source: str, keys: str) -> str:
    """Rank IC per keys and timestamp."""
    return f"""SELECT {keys}, us, {corr('pr', 'tr')} AS rank_ic, count(*) AS symbols
      FROM (SELECT *, {avg_rank('prediction', keys + ', us')} AS pr, {avg_rank('target', keys + ', us')} AS tr FROM {source}) GROUP BY {keys}, us"""


def summary(source: str, keys: str) -> str:
    """Prediction summary per keys."""
    return f"""SELECT * FROM (SELECT {keys}, avg(rank_ic) AS mean_rank_ic, quantile_cont(rank_ic, 0.5) AS median_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
        CASE WHEN stddev_samp(rank_ic) > 1e-12 THEN avg(rank_ic) / stddev_samp(rank_ic) END AS rank_ic_ir, avg(CASE WHEN rank_ic IS NOT NULL THEN (rank_ic > 0)::INT END) AS positive_timestamp_fraction,
        count(*) AS n_timestamps FROM ({ic(source, keys)}) GROUP BY {keys})
      JOIN (SELECT {keys}, sqrt(avg((prediction - target) ** 2)) AS rmse, avg(abs(prediction - target)) AS mae, count(*) AS n_rows FROM {source} GROUP BY {keys}) USING ({keys})"""


def weights(source: str, keys: str, k: str) -> str:
    return f"""SELECT *, (CASE WHEN place <= {k} THEN -0.5 WHEN place > n - {k} THEN 0.5 ELSE 0 END) / {k} AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys}, us ORDER BY prediction, symbol) AS place, count(*) OVER (PARTITION BY {keys}, us) AS n FROM {source}) WHERE n >= 2 * {k}"""


def periods(source: str, keys: str, holding: int, width: int = _W) -> str:
    """A period's own weights and, with the other sign, those of the period before it."""
    own = f"(SELECT *, ((us // {width}) % {holding})::INT AS cohort FROM {source})"
    return f"""SELECT {keys}, cohort, us, sum(gain) AS gross_return, sum(abs(change)) AS turnover FROM (
      SELECT {keys}, cohort, us, symbol, sum(gain) AS gain, sum(weight) AS change FROM (
        SELECT {keys}, cohort, us, symbol, weight * execution_return AS gain, weight FROM {own}
        UNION ALL SELECT {keys}, cohort, us + {holding * width}, symbol, 0, -weight FROM {own}) GROUP BY ALL)
      SEMI JOIN {own} USING ({keys}, cohort, us) GROUP BY {keys}, cohort, us"""


def cohort_metrics(source: str, keys: str, costs: str = _COSTS) -> str:
    return f"""SELECT {keys}, cost_bps, cohort, count(*) AS period_count, avg(net) AS mean_net_return, avg(net) * {_A} AS annualized_net_return,
      stddev_samp(net) * sqrt({_A}) AS annualized_volatility, avg(net) / nullif(stddev_samp(net), 0) * sqrt({_A}) AS annualized_sharpe,
      avg((net > 0)::INT) AS positive_fraction, avg(turnover) AS mean_turnover, sum(net) AS cumulative_net_log_return
      FROM (SELECT *, gross_return - turnover * cost_bps / 10000 AS net FROM (SELECT *, unnest({costs}) AS cost_bps FROM {source})) GROUP BY {keys}, cost_bps, cohort"""


def portfolio_summary(source: str, keys: str) -> str:
    return f"""SELECT {keys}, cost_bps, count(DISTINCT cohort) AS cohort_count, sum(period_count)::BIGINT AS total_periods, avg(annualized_sharpe) AS mean_cohort_sharpe,
      quantile_cont(annualized_sharpe, 0.5) AS median_cohort_sharpe, min(annualized_sharpe) AS worst_cohort_sharpe, max(annualized_sharpe) AS best_cohort_sharpe,
      avg(annualized_net_return) AS mean_annualized_net_return, quantile_cont(annualized_net_return, 0.5) AS median_annualized_net_return,
      min(annualized_net_return) AS worst_annualized_net_return, max(annualized_net_return) AS best_annualized_net_return,
      avg(annualized_volatility) AS mean_annualized_volatility, avg(positive_fraction) AS mean_positive_fraction, avg(mean_turnover) AS mean_turnover,
      avg(cumulative_net_log_return) AS mean_cumulative_net_log_return FROM {source} GROUP BY {keys}, cost_bps"""


def sensitivity(source: str, keys: str) -> str:
    own = "mean_net_return / nullif(mean_turnover, 0) * 10000"
    return f"""SELECT {keys}, count(*) AS cohort_count, sum(period_count)::BIGINT AS total_periods,
      avg(mean_net_return) / nullif(avg(mean_turnover), 0) * 10000 AS equal_weighted_break_even_cost_bps,
      sum(cumulative_net_log_return) / nullif(sum(mean_turnover * period_count), 0) * 10000 AS pooled_break_even_cost_bps,
      avg({own}) AS mean_individual_break_even_cost_bps, quantile_cont({own}, 0.5) AS median_individual_break_even_cost_bps,
      min({own}) AS worst_individual_break_even_cost_bps, max({own}) AS best_individual_break_even_cost_bps,
      avg(annualized_net_return) AS mean_gross_annualized_return, avg(annualized_sharpe) AS mean_zero_cost_sharpe, avg(mean_turnover) AS mean_turnover,
      avg((mean_net_return > 0)::INT) AS positive_cohort_fraction FROM {source} WHERE cost_bps = 0 GROUP BY {keys}"""


def temporal(source: str, keys: str, costs: str) -> str:
    return f"""SELECT {keys}, cost_bps, sum(n)::BIGINT AS period_count, count(*) AS cohort_count, sum(g) AS total_gross_log_return, sum(t) AS total_turnover, sum(t) / sum(n) AS mean_turnover,
      sum(g) / nullif(sum(t), 0) * 10000 AS break_even_cost_bps, sum(g) / sum(n) AS pooled_gross_mean_return, sum(net) / sum(n) AS pooled_net_mean_return,
      avg(m) AS equal_weighted_net_mean_return, sum(net) / sum(n) * {_A} AS pooled_annualized_net_return, avg(m) * {_A} AS equal_weighted_annualized_net_return,
      min(m) * {_A} AS worst_cohort_annualized_net_return, max(m) * {_A} AS best_cohort_annualized_net_return, avg((m > 0)::INT) AS positive_cohort_fraction
      FROM (SELECT {keys}, cost_bps, cohort, count(*) AS n, sum(gross_return) AS g, sum(turnover) AS t, sum(net) AS net, avg(net) AS m
        FROM (SELECT *, gross_return - turnover * cost_bps / 10000 AS net FROM (SELECT *, unnest({costs}) AS cost_bps FROM {source})) GROUP BY {keys}, cost_bps, cohort)
      GROUP BY {keys}, cost_bps"""


_FOLD_ROWS = ", ".join(f"({f.fold}, TIMESTAMP '{f.train_end}', TIMESTAMP '{f.validation_end}', TIMESTAMP '{f.test_end}')" for f in study.FOLDS)
_TOPS = ", ".join(f"({k})" for k in study.BREADTHS)
_STATE_COLS = ["market_return", "market_realized_volatility", "cross_sectional_dispersion"]

#: The chain; unused members cost nothing.
STEPS = f"""
  ticks AS (SELECT 'S' || lpad((l_suppkey // {study.SUPPLIERS})::VARCHAR, 7, '0') AS symbol, epoch_us(l_shipdate) AS tick_us, l_extendedprice / l_quantity AS p, l_quantity AS q, l_discount < 0.05 AS taker,
    [epoch_us(l_shipdate)::DOUBLE, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice] AS o FROM lineitem),
  pb AS (SELECT symbol, tick_us - (tick_us - {_M}) % {_W} AS us, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q) AS volume, sum(p * q) AS quote_volume,
    count(*) AS trade_count, coalesce(sum(q) FILTER (WHERE taker), 0) AS taker_buy_volume, coalesce(sum(p * q) FILTER (WHERE taker), 0) AS taker_buy_quote_volume FROM ticks GROUP BY 1, 2),
  f0 AS (SELECT *, make_timestamp(us) AS "timestamp", make_timestamp(us + {_W} - 1000) AS available_time,
    {', '.join(f"ln(close / lag(close, {k}) OVER w) AS return_{k}" for k in (1, 3, 12, 48))}, ln(high / low) AS log_range, ln(close / open) AS close_open_return,
    ln(1 + quote_volume) AS log_quote_volume, ln(1 + volume) AS lv, ln(1 + trade_count) AS lt, coalesce(CASE WHEN quote_volume > 0 THEN taker_buy_quote_volume / quote_volume END, 0.5) AS taker_buy_ratio
    FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY us)),
  feat AS (SELECT *, {_full(12, 'stddev_pop', 'return_1')} * sqrt(12.0) AS realized_vol_12, {_full(48, 'stddev_pop', 'return_1')} * sqrt(48.0) AS realized_vol_48,
    {_z('lv', 48)} AS volume_zscore_48, {_z('lt', 48)} AS trade_count_zscore_48,
    sin(2 * pi() * (hour("timestamp") * 60 + minute("timestamp")) / 1440) AS time_of_day_sin, cos(2 * pi() * (hour("timestamp") * 60 + minute("timestamp")) / 1440) AS time_of_day_cos,
    sin(2 * pi() * (isodow("timestamp") - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow("timestamp") - 1) / 7) AS weekday_cos FROM f0),
  lab0 AS (SELECT *, CASE WHEN lead(us, {_H}) OVER w - us = {_H * _W} THEN lead(us, {_H}) OVER w END AS end_us,
    CASE WHEN lead(us, {_H}) OVER w - us = {_H * _W} THEN ln(lead(close, {_H}) OVER w / close) END AS raw_target FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY us)),
  lab AS (SELECT *, make_timestamp(end_us) AS label_end_timestamp, raw_target - avg(raw_target) OVER (PARTITION BY us) AS target FROM lab0),
  folds(fold, train_end, validation_end, test_end) AS (VALUES {_FOLD_ROWS}),
  placed AS (SELECT *, CASE WHEN "timestamp" <= train_end THEN train_end WHEN "timestamp" <= validation_end THEN validation_end WHEN "timestamp" <= test_end THEN test_end END AS bound,
    CASE WHEN "timestamp" <= train_end THEN 'train' WHEN "timestamp" <= validation_end THEN 'validation' WHEN "timestamp" <= test_end THEN 'test' END AS period
    FROM lab, folds WHERE end_us IS NOT NULL AND return_12 IS NOT NULL),
  split AS (SELECT *, CASE WHEN label_end_timestamp <= bound THEN period ELSE 'purged' END AS split FROM placed WHERE period IS NOT NULL),
  pred AS (SELECT fold, us, "timestamp", label_end_timestamp, symbol, raw_target, target, m.model, m.s * return_12 AS prediction
    FROM split, (VALUES ('momentum', 1.0), ('reversal', -1.0)) m(model, s) WHERE split = 'test'),
  execr AS (SELECT * FROM (SELECT symbol, us, ln(lead(close, {_H}) OVER w / lead(open, 1) OVER w) AS execution_return FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY us)) WHERE execution_return IS NOT NULL),
  joined AS (SELECT * FROM pred JOIN execr USING (symbol, us)),
  wts AS ({weights('joined', 'model', str(study.TOP))}),
  per AS ({periods('wts', 'model', _H)}),
  coh AS ({cohort_metrics('per', 'model')}),
  becoh AS (SELECT model, cohort, period_count, mean_net_return AS gross_mean_return, mean_turnover, cumulative_net_log_return AS gross_cumulative_log_return,
    mean_net_return * {_A} AS gross_annualized_return, mean_turnover * period_count AS total_turnover,
    cumulative_net_log_return / nullif(mean_turnover * period_count, 0) * 10000 AS break_even_cost_bps, cumulative_net_log_return > 0 AS positive_at_zero_cost FROM coh WHERE cost_bps = 0),
  dated AS (SELECT per.*, fold, strftime(make_timestamp(us), '%Y-%m') AS "month" FROM per JOIN (SELECT DISTINCT us, fold FROM pred) USING (us)),
  bwts AS ({weights(f'(SELECT * FROM joined, (VALUES {_TOPS}) b(top_count))', 'model, top_count', 'top_count')}),
  bcoh AS ({cohort_metrics('(' + periods('bwts', 'model, top_count', _H) + ')', 'model, top_count')}),
  href AS (SELECT * FROM ({' UNION ALL '.join(f'''SELECT symbol, us, {h} AS horizon_bars, lead(us, {h}) OVER w AS end_us, ln(lead(close, {h}) OVER w / close) AS raw_target,
      ln(lead(close, {h}) OVER w / lead(open, 1) OVER w) AS execution_return FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY us)''' for h in study.HORIZONS)}) WHERE end_us - us = horizon_bars * {_W}),
  htar AS (SELECT *, raw_target - avg(raw_target) OVER (PARTITION BY horizon_bars, us) AS target FROM href),
  hjoin AS (SELECT p.model, p.fold, p.us, p.symbol, p.prediction, h.horizon_bars, h.raw_target, h.target, h.execution_return
    FROM pred p JOIN htar h USING (symbol, us) JOIN folds USING (fold) WHERE make_timestamp(h.end_us) <= test_end),
  hper AS ({' UNION ALL '.join('SELECT * FROM (' + periods('(' + weights(f'(SELECT * FROM hjoin WHERE horizon_bars = {h})', 'model, horizon_bars', str(study.TOP)) + ')', 'model, horizon_bars', h) + ')' for h in study.HORIZONS)}),
  hcoh AS ({cohort_metrics('hper', 'model, horizon_bars')}),
  syms AS (SELECT DISTINCT symbol AS excluded_symbol FROM pb),
  xjoin AS (SELECT * FROM joined, syms WHERE symbol <> excluded_symbol),
  xpred AS (SELECT * FROM pred, syms WHERE symbol <> excluded_symbol),
  xcoh AS ({cohort_metrics('(' + periods('(' + weights('xjoin', 'model, excluded_symbol', str(study.TOP)) + ')', 'model, excluded_symbol', _H) + ')', 'model, excluded_symbol')}),
  xic AS (SELECT * FROM ({summary('xpred', 'model, excluded_symbol')}) JOIN (SELECT model, mean_rank_ic AS full_mean_rank_ic FROM ({summary('pred', 'model')})) USING (model)),
  contrib0 AS (SELECT model, symbol, count(*) AS timestamp_count, count(*) FILTER (WHERE weight > 0) AS long_selection_count, count(*) FILTER (WHERE weight < 0) AS short_selection_count,
    count(*) FILTER (WHERE weight <> 0) AS active_selection_count, avg((weight > 0)::INT) AS long_selection_fraction, avg((weight < 0)::INT) AS short_selection_fraction,
    avg((weight <> 0)::INT) AS active_selection_fraction, avg(abs(weight)) AS mean_absolute_weight, avg(weight * execution_return) AS mean_gross_return_contribution,
    sum(weight * execution_return) AS cumulative_gross_log_return_contribution FROM wts GROUP BY model, symbol),
  contrib AS (SELECT *, abs(cumulative_gross_log_return_contribution) AS absolute_cumulative_contribution,
    abs(cumulative_gross_log_return_contribution) / sum(abs(cumulative_gross_log_return_contribution)) OVER (PARTITION BY model) AS absolute_contribution_share,
    sum(cumulative_gross_log_return_contribution) OVER (PARTITION BY model) AS portfolio_gross_cumulative_log_return,
    rank() OVER (PARTITION BY model ORDER BY abs(cumulative_gross_log_return_contribution) DESC) AS absolute_contribution_rank FROM contrib0),
  st0 AS (SELECT symbol, us, ln(close / lag(close) OVER w) AS r, ln(close / lag(close, {study.STATE_WINDOW}) OVER w) AS t FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY us)),
  st1 AS (SELECT *, sqrt({_full(study.STATE_WINDOW, 'sum', 'r2')}) AS v FROM (SELECT *, r * r AS r2 FROM st0)),
  states AS (SELECT us, make_timestamp(us) AS "timestamp", avg(t) AS market_return, avg(v) AS market_realized_volatility, stddev_pop(t) AS cross_sectional_dispersion
    FROM st1 GROUP BY us HAVING count(*) FILTER (WHERE t IS NULL OR v IS NULL) = 0),
  thr AS (SELECT fold, count(*) AS calibration_timestamp_count, max("timestamp") AS calibration_end_timestamp,
    {', '.join(f"quantile_cont({s}, {q}) AS {s}_{n}" for s in _STATE_COLS for n, q in (("lower", 1 / 3), ("upper", 2 / 3)))} FROM states, folds WHERE "timestamp" <= validation_end GROUP BY fold),
  regw AS (SELECT fold, us, "timestamp", {', '.join(f"CASE WHEN {s} <= {s}_lower THEN 'low' WHEN {s} > {s}_upper THEN 'high' ELSE 'medium' END AS {s}" for s in _STATE_COLS)}
    FROM states, folds JOIN thr USING (fold) WHERE "timestamp" > validation_end AND "timestamp" <= test_end),
  reg AS ({' UNION ALL '.join(f"SELECT fold, us, timestamp, '{s}' AS regime_dimension, {s} AS regime FROM regw" for s in _STATE_COLS)}),
  cells AS ({summary('(SELECT pred.*, regime_dimension, regime FROM pred JOIN reg USING (fold, us))', 'model, fold, regime_dimension, regime')}),
  rport AS ({temporal('(SELECT dated.*, regime_dimension, regime FROM dated JOIN reg USING (fold, us))', 'model, fold, regime_dimension, regime', f'[0.0::DOUBLE, {study.FOCUS}]')}),
  icfold AS ({ic('pred', 'model, fold')})
"""
FEATURE_LIST = ", ".join(FEATURES)


def ask(select: str, more: str = "") -> str:
    return f"WITH {STEPS}{more} {select}"
