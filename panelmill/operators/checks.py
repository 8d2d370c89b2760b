"""Integrity checks as aggregates: a check costs one pass and brings a few numbers to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.scalar import any_of, is_finite


def require_columns(df: DataFrame, columns: list[str], name: str = "frame") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {missing}")


def positive_distinct(values: list[int], name: str = "values") -> list[int]:
    """Sorted distinct positive integers (horizons, block lengths, breadths); anything else is an error."""
    if not values or any(isinstance(v, bool) or int(v) != v or v <= 0 for v in values):
        raise ValueError(f"{name} must be positive whole numbers")
    return sorted({int(v) for v in values})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``occurrences``."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def require_unique(df: DataFrame, keys: list[str], name: str = "frame") -> None:
    row = duplicate_keys(df, keys).limit(1).collect()
    if row:
        raise ValueError(f"{name} has duplicate keys {keys}: {row[0].asDict()}")


def validate_predictions(df: DataFrame) -> DataFrame:
    """Violations of a prediction frame: ``check`` and ``violations``."""
    require_columns(df, ["timestamp", "symbol", "target", "prediction"], "predictions")
    keys = [c for c in ("model", "fold", "timestamp", "symbol") if c in df.columns]
    bad = any_of([~is_finite(F.col(c)) for c in ("target", "prediction")])
    counts = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"))
    repeated = duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys"))
    one = counts.crossJoin(repeated)  # two one-row frames
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("violations")) for n, c in (
        ("empty", (F.col("n") == 0).cast("bigint")), ("not_finite", F.col("not_finite")), ("duplicate_keys", F.col("duplicate_keys")))])))


def safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """Join after checking the declared cardinality (``1:1``, ``m:1``, ``1:m``) by aggregation."""
    a, b = validate.split(":")
    if a == "1":
        require_unique(left, on, "left side")
    if b == "1":
        require_unique(right, on, "right side")
    return left.join(right, on, how)


def key_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: ``side`` is ``missing`` or ``unexpected``."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def reproduction_error(source: DataFrame, reproduced: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows on both sides, and the largest absolute difference of each metric over matching keys."""
    right = reproduced.select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    joined = source.select(*keys, *metrics, F.lit(1).alias("__s")).join(right.withColumn("__r", F.lit(1)), keys, "full_outer")
    return joined.agg(
        F.count("__s").alias("source_rows"), F.count("__r").alias("reproduced_rows"), F.count_if(F.col("__s").isNotNull() & F.col("__r").isNotNull()).alias("matched_rows"),
        *[F.max(F.abs(F.col(m) - F.col(f"__{m}"))).alias(f"max_{m}_error") for m in metrics],
    )


def require_reproduced(errors: DataFrame, tolerance: float) -> None:
    row = errors.first().asDict()
    if not row["source_rows"] == row["reproduced_rows"] == row["matched_rows"]:
        raise ValueError(f"keys differ: {row}")
    if worst := {k: v for k, v in row.items() if k.startswith("max_") and (v is None or v > tolerance)}:
        raise ValueError(f"not reproduced within {tolerance}: {worst}")


def alignment_audit(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Per symbol: rows and largest errors of labels against a reference rebuilt from bars, and how execution differs from the label."""
    r = reference.select("symbol", "timestamp", F.col("label_end_timestamp").alias("__end"), F.col("raw_target").alias("__raw"), "execution_return")
    joined = panel.join(r, ["symbol", "timestamp"], "left")
    gap = F.timestamp_diff("MICROSECOND", F.col("__end"), F.col("label_end_timestamp"))
    d = F.col("execution_return") - F.col("raw_target")
    return joined.groupBy("symbol").agg(
        F.count("*").alias("panel_rows"), F.min("timestamp").alias("first_panel_timestamp"), F.max("timestamp").alias("last_panel_timestamp"),
        F.max(F.abs(gap)).alias("max_label_end_error_us"), F.max(F.abs(F.col("raw_target") - F.col("__raw"))).alias("max_raw_target_abs_error"),
        F.avg("raw_target").alias("mean_raw_target"), F.avg("execution_return").alias("mean_execution_return"),
        F.avg(d).alias("mean_execution_minus_label"), F.avg(F.abs(d)).alias("mean_abs_execution_minus_label"),
    )


def model_alignment(predictions: DataFrame) -> DataFrame:
    """Over all (timestamp, symbol) keys: how many models cover each, and the largest spread of their targets."""
    keys = predictions.groupBy("timestamp", "symbol").agg(F.countDistinct("model").alias("m"), (F.max("target") - F.min("target")).alias("d"))
    return keys.groupBy("m").agg(F.count("*").alias("key_count"), F.max("d").alias("max_target_difference")).withColumnRenamed("m", "model_count")


def identity_error(predictions: DataFrame, a: str = "momentum", b: str = "reversal") -> DataFrame:
    """Largest |prediction_a + prediction_b| over keys, for two models that should be opposite."""
    per = predictions.where(F.col("model").isin(a, b)).groupBy("timestamp", "symbol", "fold").agg(F.sum("prediction").alias("s"), F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") == 2).alias("paired_rows"), F.max(F.abs("s")).alias("max_sum"))


def cost_monotonicity(phases: DataFrame, by: list[str], value: str = "pooled_net_mean_return") -> DataFrame:
    """Steps along the cost levels at which the net return rises, per group."""
    from pyspark.sql import Window

    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy("cost_bps"))
    return phases.select(*by, step.alias("step")).groupBy(*by).agg(F.count("step").alias("steps"), F.count_if(F.col("step") > 1e-15).alias("rising_steps"))


def cohort_violations(cohorts: DataFrame, holding: int, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Per group of cohort metrics: cohorts missing from 0 .. holding - 1, unexpected or repeated ones, and unusable numbers."""
    numbers = [c for c in ("gross_mean_return", "mean_net_return", "mean_turnover", "gross_cumulative_log_return", "cumulative_net_log_return") if c in cohorts.columns]
    unusable = any_of([~is_finite(F.col(c)) for c in numbers] + [F.col("period_count") <= 0, F.col("mean_turnover") <= 0])
    inside = (F.col("cohort") >= 0) & (F.col("cohort") < holding)
    return cohorts.groupBy(*by).agg(
        (F.lit(holding) - F.countDistinct(F.when(inside, F.col("cohort")))).alias("missing_cohorts"),
        F.count_if(~inside).alias("unexpected_cohorts"),
        (F.count("*") - F.countDistinct("cohort")).alias("repeated_cohorts"),
        F.count_if(unusable).alias("unusable_rows"),
    )


def coverage_violations(assigned: DataFrame, expected: DataFrame, keys: list[str], per_key: int) -> DataFrame:
    """Expected keys whose number of assigned rows is not ``per_key`` (regime labels per timestamp, cohorts per segment)."""
    held = assigned.groupBy(*keys).agg(F.count("*").alias("assigned_rows"))
    return expected.select(*keys).distinct().join(held, keys, "left").select(*keys, F.coalesce("assigned_rows", F.lit(0)).alias("assigned_rows")).where(F.col("assigned_rows") != per_key)


def cohort_set_differences(metrics: DataFrame, by: list[str], cost: float, other: float) -> DataFrame:
    """Groups and cohorts that have metrics at one of two cost levels only: ``side`` is ``missing`` (at ``other``) or ``unexpected``."""
    at = lambda c: metrics.where(F.abs(F.col("cost_bps") - c) <= 1e-12).select(*by, "cohort")
    return key_differences(at(cost), at(other), [*by, "cohort"])


def target_differences(predictions: DataFrame, panel: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Prediction keys that the panel lacks, or whose target differs from the panel's by more than ``tolerance``."""
    source = panel.select("timestamp", "symbol", F.col("target").alias("__target"))
    joined = predictions.join(source, ["timestamp", "symbol"], "left")
    near = F.coalesce(F.abs(F.col("target") - F.col("__target")) <= tolerance, F.lit(False))
    return joined.where(~near).select("timestamp", "symbol", "target", F.col("__target").alias("panel_target"))


def execution_alignment(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Per fold: predictions, those without an execution return or with another label end, and how execution differs from the label."""
    r = reference.select("timestamp", "symbol", F.col("label_end_timestamp").alias("__end"), "execution_return")
    joined = predictions.join(r, ["timestamp", "symbol"], "left")
    d = F.col("execution_return") - F.col("raw_target")
    return joined.groupBy("fold").agg(
        F.count("*").alias("rows"), F.count_if(F.col("execution_return").isNull()).alias("without_execution"),
        F.count_if(~F.col("__end").eqNullSafe(F.col("label_end_timestamp"))).alias("other_label_end"), F.avg(d).alias("mean_execution_minus_label"), F.avg(F.abs(d)).alias("mean_abs_execution_minus_label"),
    )
