"""Robust scaling: median and interquartile range of the training rows, exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalar import join_null_safe


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], slack: float = 1e-3) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one row per (group, ``p``), without gathering a group.

    A mergeable sketch brackets each quantile within a rank error of ``slack``.  One more aggregation
    counts what lies below all brackets of a group and finds the values beside them, and only rows inside
    a bracket are ranked.  Memory per task is the sketch and a small share of a group, where the built-in
    exact ``percentile`` holds every distinct value of one.  Nulls and NaN are ignored; a null group key
    is a group; a group without values has no rows.
    """
    accuracy = max(10_000, int(10 / slack))
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = [max(0.0, p - slack) for p in probabilities] + [min(1.0, p + slack) for p in probabilities]
    k = range(len(probabilities))
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", ends, accuracy).alias("q")
    )
    brackets = sketch.where("n > 0").select(
        *by,
        "n",
        *[(F.get("q", F.lit(i)) if probabilities[i] - slack > 0 else F.col("least")).alias(f"a{i}") for i in k],
        *[(F.get("q", F.lit(len(k) + i)) if probabilities[i] + slack < 1 else F.col("most")).alias(f"b{i}") for i in k],
    )
    # Groups are few beside rows; the join is left to Catalyst (broadcast when small, else by group with skew splitting).
    joined = join_null_safe(rows, brackets, by) if by else rows.crossJoin(F.broadcast(brackets))
    v = F.col("v")
    # In small groups the two order statistics may lie right beside the bracket.
    around = joined.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.count_if(v < F.col(f"a{i}")).alias(f"below{i}") for i in k],
        *[F.max(F.when(v < F.col(f"a{i}"), v)).alias(f"prev{i}") for i in k],
        *[F.min(F.when(v > F.col(f"b{i}"), v)).alias(f"next{i}") for i in k],
    ).select(*by, "n", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{c}{i}").alias(c) for c in ("below", "prev", "next")]) for i in k])))
    hits = F.array_compact(F.array(*[F.when((v >= F.col(f"a{i}")) & (v <= F.col(f"b{i}")), F.lit(i)) for i in k]))
    keys = [*by, "i"]
    inside = joined.select(*by, "v", F.explode(hits).alias("i")).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    placed = inside.select(*keys, "v", running.alias("within"))
    at = F.element_at(F.array(*[F.lit(p) for p in probabilities]), (F.col("i") + 1).cast("int")) * (F.col("n") - 1)
    ranked = join_null_safe(around, placed, keys, "left").select(*keys, at.alias("at"), "v", "below", "prev", "next", (F.col("below") + F.col("within")).alias("through"))

    def statistic(index: Column) -> Column:
        within = F.min(F.when(F.col("through") > index, F.col("v")))
        return F.when(F.max("below") > F.max(index), F.max("prev")).otherwise(F.coalesce(within, F.max("next")))

    p = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), (F.col("i") + 1).cast("int"))
    return (
        ranked.groupBy(*keys, "at")
        .agg(statistic(F.floor("at")).alias("x"), statistic(F.ceil("at")).alias("y"))
        .select(*by, p.alias("p"), (F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))).alias("quantile"))
    )


def fit_robust_scaler(train: DataFrame, features: list[str], by: list[str] = ["fold"]) -> DataFrame:  # noqa: B006
    """``by``, ``feature``, ``median`` and ``scale`` (interquartile range; 1 where it is not above 1e-12)."""
    doubles = train.select(*by, *[F.col(f).cast("double").alias(f) for f in features])
    long = doubles.unpivot(by, features, "feature", "value")
    q = exact_quantiles(long, [*by, "feature"], "value", [0.25, 0.5, 0.75])
    wide = q.groupBy(*by, "feature").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "lo"), (0.5, "median"), (0.75, "hi"))])
    spread = F.col("hi") - F.col("lo")
    return wide.select(*by, "feature", "median", F.when(spread > 1e-12, spread).otherwise(1.0).alias("scale"))


def apply_robust_scaler(df: DataFrame, scaler: DataFrame, features: list[str], by: list[str] = ["fold"], float_first: bool = False) -> DataFrame:  # noqa: B006
    """The rows with each feature as (value - median) / scale, as float; ``float_first`` turns value, median and scale to floats before."""
    wide = scaler.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "scale")))).alias("__s"))

    def scaled(f: str) -> Column:
        s, kind = F.col("__s")[f], "float" if float_first else "double"
        moved = (F.col(f).cast(kind) - s["median"].cast(kind)).cast(kind)
        return (moved / s["scale"].cast(kind)).cast("float")

    return join_null_safe(df, wide, by).withColumns({f: scaled(f) for f in features}).drop("__s")
