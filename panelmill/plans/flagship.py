"""The flagship: daily event bars to the cost ladder of a reversal portfolio, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import features as X
from panelmill.operators import portfolio as P
from panelmill.operators.bars import by_symbol
from panelmill.plans import study

DAY = study.WEEK // 7
HORIZON, LOOKBACK, TOP, ANNUAL = 2, 3, 1, 182.0


def evaluate(spark: SparkSession, d: str) -> DataFrame:
    bars = study.event_bars(spark, d)
    scored = bars.select("timestamp", "symbol", (-X.log_return(LOOKBACK, by_symbol())).alias("prediction")).where("prediction is not null")
    rows = scored.join(X.execution_returns(bars, HORIZON), ["timestamp", "symbol"]).withColumn("model", F.lit("reversal"))
    periods = P.portfolio_periods(P.rank_weights(rows, TOP, ["model"], short="skip"), DAY, HORIZON, ["model"])
    return P.portfolio_summary(P.cohort_metrics(periods, [0.0, 1.0, 2.0, 5.0, 10.0], ANNUAL))


_SUM = "mean_cohort_sharpe median_cohort_sharpe worst_cohort_sharpe best_cohort_sharpe mean_annualized_net_return median_annualized_net_return worst_annualized_net_return best_annualized_net_return mean_annualized_volatility mean_positive_fraction mean_turnover mean_cumulative_net_log_return".split()


def flagship_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(spark, d).withColumns({c: F.round(c, 9) for c in _SUM})


def _sql() -> str:
    from panelmill.plans import study_sql as Q

    w = "WINDOW w AS (PARTITION BY symbol ORDER BY us)"
    periods = Q.periods("wts", "model", HORIZON, DAY)
    metrics = Q.cohort_metrics("per", "model").replace(f"* {Q._A}", f"* {ANNUAL}").replace(f"sqrt({Q._A})", f"sqrt({ANNUAL})")
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in _SUM)
    return f"""WITH eb AS (SELECT event_type AS symbol, epoch_us(ts) - epoch_us(ts) % {DAY} AS us, arg_min(price, [epoch_us(ts), event_id]) AS open, arg_max(price, [epoch_us(ts), event_id]) AS close
        FROM (SELECT *, greatest(coalesce(value, 0), 0) + 1 AS price FROM events) GROUP BY 1, 2),
      scored AS (SELECT symbol, us, -ln(close / lag(close, {LOOKBACK}) OVER w) AS prediction, ln(lead(close, {HORIZON}) OVER w / lead(open, 1) OVER w) AS execution_return, 'reversal' AS model FROM eb {w}),
      joined AS (SELECT * FROM scored WHERE prediction IS NOT NULL AND execution_return IS NOT NULL), wts AS ({Q.weights('joined', 'model', str(TOP))}), per AS ({periods}), coh AS ({metrics})
      SELECT * REPLACE ({rounded}) FROM ({Q.portfolio_summary('coh', 'model')})"""


QUERIES = {"flagship_portfolio": flagship_portfolio}
ORACLE = {"flagship_portfolio": _sql()}
