"""The reference study on weekly bars of the order lines, each step as a DataFrame.

A symbol is five suppliers, so symbols and bars grow with the data; a bar is a week from Monday.  Steps
are lazy and built from the operators; the SQL twins in ``study_sql`` state the same steps independently.
Analyses that read a step several times settle it first: ``Steps(..., settle=True)`` writes bars and
joined predictions once to the shared checkpoint folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import bars as B
from panelmill.operators import costs as C
from panelmill.operators import features as X
from panelmill.operators import models as M
from panelmill.operators import portfolio as P
from panelmill.operators import regimes as G
from panelmill.operators import sensitivity as S
from panelmill.operators import splits as L
from panelmill.operators import stability as T
from panelmill.operators import xsection as R
from panelmill.session import written
from panelmill.sources.tables import table

MINUTE = 60_000_000
WEEK = 7 * 24 * 60 * MINUTE
MONDAY = 4 * 24 * 60 * MINUTE  # 1970-01-05
SUPPLIERS = 5  # of a symbol
HOLDING, TOP, ANNUAL, STATE_WINDOW = 12, 4, 52.0, 12
BREADTHS, HORIZONS = [1, 2, 4, 8], [3, 6, 12]
COSTS = [0.0, 1.0, 2.0, 5.0, 10.0]
FOCUS = 5.0
FOLDS = [
    L.Fold.parse(1, "1997-01-06T00:00Z", "1997-07-07T00:00Z", "1998-07-06T00:00Z"),
    L.Fold.parse(2, "1998-01-05T00:00Z", "1998-07-06T00:00Z", "1999-07-05T00:00Z"),
    L.Fold.parse(3, "1999-01-04T00:00Z", "1999-07-05T00:00Z", "2001-01-01T00:00Z"),
]


def event_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of the event values by event type: complete at every scale.  A price is one more than the value, nothing and less counting as nothing."""
    price = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)) + 1.0
    return B.ohlcv_bars(
        table(spark, d, "events"), F.col("event_type"), F.col("ts"), price, F.lit(1.0), [F.col("ts"), F.col("event_id")], WEEK // 7, taker=F.col("event_id") % 2 == 0
    )


class Steps:
    """The study over the tables of ``d``; ``settle`` writes bars and joined predictions before they are read."""

    def __init__(self, spark: SparkSession, d: str, settle: bool = False):
        self.spark, self.d, self.settle = spark, d, settle

    def _settled(self, df: DataFrame, label: str) -> DataFrame:
        return written(df, label) if self.settle else df

    @cached_property
    def bars(self) -> DataFrame:
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        rows = B.ohlcv_bars(
            table(self.spark, self.d, "lineitem"),
            symbol=F.concat(F.lit("S"), F.lpad(F.expr(f"l_suppkey div {SUPPLIERS}").cast("string"), 7, "0")),
            timestamp=F.col("l_shipdate"),
            price=F.col("l_extendedprice") / F.col("l_quantity"),
            quantity=F.col("l_quantity"),
            order=[F.col(c) for c in order],
            width=WEEK,
            origin=MONDAY,
            taker=F.col("l_discount") < 0.05,
        )
        return self._settled(rows, "bars")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.bars.select("symbol").distinct()

    @cached_property
    def features(self) -> DataFrame:
        return X.symbol_features(self.bars)

    @cached_property
    def labelled(self) -> DataFrame:
        return X.forward_targets(self.features, HOLDING, WEEK)

    @cached_property
    def panel(self) -> DataFrame:
        return X.finalize_panel(self.labelled, X.FEATURES)

    @cached_property
    def split_panel(self) -> DataFrame:
        return L.assign_folds(self.labelled.where("label_end_timestamp is not null and return_12 is not null"), FOLDS)

    @cached_property
    def predictions(self) -> DataFrame:
        """Both reference models on the test periods."""
        if self.settle:
            return self.joined.drop("execution_return")
        return self._scored

    @property
    def _scored(self) -> DataFrame:
        test = self.split_panel.where("split = 'test'").select("fold", "timestamp", "label_end_timestamp", "symbol", "raw_target", "target", "return_12")
        return M.reference_scores(test).drop("return_12")

    @cached_property
    def joined(self) -> DataFrame:
        return self._settled(X.with_execution(self._scored, self.bars, HOLDING), "joined")

    @cached_property
    def weighted(self) -> DataFrame:
        return P.rank_weights(self.joined, TOP, ["model"], short="skip")

    @cached_property
    def periods(self) -> DataFrame:
        return P.portfolio_periods(self.weighted, WEEK, HOLDING, ["model"])

    @cached_property
    def metrics(self) -> DataFrame:
        return P.cohort_metrics(self.periods, COSTS, ANNUAL)

    @cached_property
    def break_even(self) -> DataFrame:
        return C.break_even_cohorts(self.metrics, ANNUAL)

    @cached_property
    def fold_timestamps(self) -> DataFrame:
        return self.predictions.select("timestamp", "fold").distinct()

    @cached_property
    def dated_periods(self) -> DataFrame:
        """Periods with the fold and month of their timestamp; turnover stays as it was."""
        return self._settled(self.periods.join(self.fold_timestamps, "timestamp").withColumn("month", T.month()), "periods")

    @cached_property
    def stability(self) -> DataFrame:
        dated = self.predictions.withColumn("month", T.month())
        by_fold, by_month = ["model", "fold"], ["model", "fold", "month"]
        portfolio = [T.temporal_groups(self.dated_periods, by, [0.0, FOCUS], ANNUAL) for by in (by_fold, by_month)]
        return T.stability_summary(R.summarize_predictions(dated, by_fold), R.summarize_predictions(dated, by_month), *portfolio, FOCUS)

    @cached_property
    def breadth_metrics(self) -> DataFrame:
        return P.cohort_metrics(S.breadth_periods(self.joined, BREADTHS, WEEK, HOLDING), COSTS, ANNUAL, ["model", "top_count"])

    @cached_property
    def horizon_joined(self) -> DataFrame:
        reference = S.horizon_targets(S.horizon_reference(self.bars, HORIZONS, WEEK))
        scores = self.predictions.select("model", "fold", "timestamp", "symbol", "prediction")
        ends = F.coalesce(*[F.when(F.col("fold") == f.fold, F.lit(f.test_end.isoformat(sep=" ")).cast("timestamp_ntz")) for f in FOLDS])
        return scores.join(reference, ["timestamp", "symbol"]).where(F.col("label_end_timestamp") <= ends)

    @cached_property
    def horizon_metrics(self) -> DataFrame:
        parts = []
        for h in HORIZONS:  # a horizon is also the number of sleeves, so each has its own cohorts
            w = P.rank_weights(self.horizon_joined.where(F.col("horizon_bars") == h), TOP, ["model", "horizon_bars"], short="skip")
            parts.append(P.portfolio_periods(w, WEEK, h, ["model", "horizon_bars"]))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return P.cohort_metrics(every, COSTS, ANNUAL, ["model", "horizon_bars"])

    @cached_property
    def exclusion_metrics(self) -> DataFrame:
        return P.cohort_metrics(S.leave_one_out_periods(self.joined, self.symbols, TOP, WEEK, HOLDING), COSTS, ANNUAL, ["model", "excluded_symbol"])

    @cached_property
    def exclusion_ic(self) -> DataFrame:
        full = R.summarize_predictions(self.predictions).select("model", F.col("mean_rank_ic").alias("full_mean_rank_ic"))
        return S.leave_one_out_summary(self.predictions, self.symbols).join(full, "model")

    @cached_property
    def contributions(self) -> DataFrame:
        return S.symbol_contributions(self.weighted)

    @cached_property
    def dependence(self) -> DataFrame:
        keys = ["model", "excluded_symbol"]
        m = self._settled(self.exclusion_metrics, "exclusions")
        full = C.sensitivity_break_even(self.metrics, ["model"]).select("model", F.col("pooled_break_even_cost_bps").alias("full_break_even_cost_bps"))
        portfolio = C.sensitivity_break_even(m, keys).join(C.focus_cost_returns(m, FOCUS, ANNUAL, keys), keys).join(full, "model")
        return S.dependence_summary(
            self.exclusion_ic.select(*keys, "mean_rank_ic", "full_mean_rank_ic"),
            portfolio.select(*keys, "pooled_break_even_cost_bps", "full_break_even_cost_bps", "positive_cohort_fraction_at_focus_cost"),
            self.contributions,
        )

    @cached_property
    def states(self) -> DataFrame:
        return G.market_state(self.bars, STATE_WINDOW)

    @cached_property
    def thresholds(self) -> DataFrame:
        return G.regime_thresholds(self.states, FOLDS)

    @cached_property
    def regimes(self) -> DataFrame:
        return self._settled(G.melt_regimes(G.assign_regimes(self.states, self.thresholds, FOLDS)), "regimes")

    @cached_property
    def regime_cells(self) -> DataFrame:
        rows = self.predictions.join(self.regimes, ["fold", "timestamp"])
        return R.summarize_predictions(rows, ["model", "fold", "regime_dimension", "regime"])

    @cached_property
    def regime_portfolio(self) -> DataFrame:
        rows = self.dated_periods.join(self.regimes, ["fold", "timestamp"])
        return self._settled(T.temporal_groups(rows, ["model", "fold", "regime_dimension", "regime"], [0.0, FOCUS], ANNUAL), "regime-portfolio")

    @cached_property
    def regime_summary(self) -> DataFrame:
        return G.regime_summary(self._settled(self.regime_cells, "regime-cells"), self.regime_portfolio, FOCUS)

    @cached_property
    def ic_timeline(self) -> DataFrame:
        return R.rank_ic(self.predictions, ["model", "fold"])


def step(name: str, settle: bool = False):
    """A step as a query of (spark, folder)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(Steps(spark, d, settle), name)

    run.__name__ = name
    return run


bars, features, labelled, panel, split_panel = (step(n) for n in ("bars", "features", "labelled", "panel", "split_panel"))
predictions, joined, weighted, periods, metrics, break_even = (step(n) for n in ("predictions", "joined", "weighted", "periods", "metrics", "break_even"))
fold_timestamps, dated_periods, breadth_metrics, horizon_joined, horizon_metrics = (
    step(n) for n in ("fold_timestamps", "dated_periods", "breadth_metrics", "horizon_joined", "horizon_metrics")
)
exclusion_metrics, exclusion_ic, contributions, ic_timeline = (step(n) for n in ("exclusion_metrics", "exclusion_ic", "contributions", "ic_timeline"))
states, thresholds, regimes, regime_cells, regime_portfolio = (step(n) for n in ("states", "thresholds", "regimes", "regime_cells", "regime_portfolio"))
dependence, regime_summary, stability = (step(n, settle=True) for n in ("dependence", "regime_summary", "stability"))
