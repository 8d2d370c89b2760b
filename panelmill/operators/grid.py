"""Irregular readings onto a regular grid by local polynomial regression.

The grid of a source is cut into chunks of fixed time; readings near a chunk's edge go to both
neighbours, so each (source, chunk) group is whole in itself and a hot source spreads over as
many tasks as it has chunks.  Inside a group the readings are sorted once; two binary searches
per grid time give the readings in reach of the kernel, and all local fits of the group are
solved together from weighted sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.scalar import epoch_micros, floor_div, is_finite, micros_to_ntz

MINUTE = 60_000_000


def local_linear(grid: np.ndarray, at: np.ndarray, values: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Local linear fits at ``grid`` with the Epanechnikov kernel; estimate and effective support.

    ``at`` is ascending.  The effective support is (sum w)^2 / sum w^2, the number of equally
    weighted readings that would carry as much; 0 and NaN where no reading is in reach.  Where the
    readings in reach lie at a single moment the fit falls back to their weighted mean.
    """
    lo, hi = np.searchsorted(at, grid - reach, "right"), np.searchsorted(at, grid + reach, "left")
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(grid)), n)
    idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    u = (at[idx] - grid[owner]) / reach
    w = 0.75 * (1.0 - u * u)
    y = values[idx]

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, x, len(grid))

    s0, s1, s2, t0, t1, q = total(w), total(w * u), total(w * u * u), total(w * y), total(w * u * y), total(w * w)
    with np.errstate(divide="ignore", invalid="ignore"):
        det = s0 * s2 - s1 * s1
        flat = det <= 1e-12 * s0 * s0
        estimate = np.where(flat, t0 / s0, (s2 * t0 - s1 * t1) / np.where(flat, 1.0, det))
        support = np.where(q > 0, s0 * s0 / np.where(q > 0, q, 1.0), 0.0)
    return estimate, support


def regular_grid(
    readings: DataFrame,
    source: str,
    timestamp: str,
    value: str,
    intervals: DataFrame | None = None,
    interval: str = "interval_minutes",
    sequence: str | None = None,
    default_minutes: int = 5,
    reach_periods: float = 3.0,
    min_support: float = 1.5,
    chunk_slots: int = 4096,
) -> DataFrame:
    """One row per period of each source from its first to its last period with a usable reading.

    Columns: ``source``, ``slot`` (timestamp, start of the period), ``readings`` (usable ones in it),
    ``missing`` (none), ``estimate`` (regression at the start of the period, null if the effective
    support within ``reach_periods`` periods is under ``min_support``), ``support`` and ``status``:
    ``observed``, ``filled`` (missing, estimated) or ``missing``.

    Defined cases: a reading is usable if its value is finite and above zero and its timestamp is not
    null; repeated readings of a (source, timestamp) count once, the usable one with the largest
    ``sequence``; a source that ``intervals`` lacks, or whose interval there is null or below one, has
    ``default_minutes``; repeated rows of ``intervals`` give the smallest interval; a null source is a
    source of its own (with the default); an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    usable = readings.select(
        F.col(source).alias("src"),
        epoch_micros(F.col(timestamp)).alias("at"),
        F.col(value).cast("double").alias("y"),
        (F.col(sequence).cast("bigint") if sequence else F.lit(0).cast("bigint")).alias("seq"),
    ).where(F.col("at").isNotNull() & is_finite(F.col("y")) & (F.col("y") > 0))
    once = usable.groupBy("src", "at").agg(F.max_by("y", "seq").alias("y"))
    if intervals is not None:
        steps = (
            intervals.select(F.col(source).alias("src"), F.col(interval).cast("bigint").alias("m"))
            .where(F.col("m") >= 1)
            .groupBy("src")
            .agg(F.min("m").alias("m"))
        )
        once = once.join(steps, "src", "left")
    else:
        once = once.withColumn("m", F.lit(None).cast("bigint"))
    step = F.coalesce("m", F.lit(default_minutes).cast("bigint")) * MINUTE
    placed = once.select("src", "at", "y", step.alias("step")).withColumn("slot", floor_div(F.col("at"), F.col("step")))

    # Which chunks the grid of a source has, readings in them or not.
    spans = placed.groupBy("src").agg(F.min("step").alias("step"), F.min("slot").alias("a"), F.max("slot").alias("b"))
    frames = spans.withColumn(
        "chunk", F.explode(F.sequence(floor_div(F.col("a"), chunk_slots), floor_div(F.col("b"), chunk_slots)))
    ).select("src", "chunk", "step", F.greatest("a", F.col("chunk") * chunk_slots).alias("a"), F.least("b", (F.col("chunk") + 1) * chunk_slots - 1).alias("b"))
    # Readings go to every chunk with a grid time in their reach.
    pad = int(np.ceil(reach_periods)) + 1
    spread = placed.withColumn(
        "chunk", F.explode(F.sequence(floor_div(F.col("slot") - pad, chunk_slots), floor_div(F.col("slot") + pad, chunk_slots)))
    ).select("src", "chunk", "at", "y")
    none = F.lit(None)
    both = frames.select("src", "chunk", "step", "a", "b", none.cast("bigint").alias("at"), none.cast("double").alias("y")).unionByName(
        spread.select("src", "chunk", *[none.cast("bigint").alias(c) for c in ("step", "a", "b")], "at", "y")
    )
    out = T.StructType(
        [
            T.StructField("src", readings.schema[source].dataType),
            T.StructField("slot", T.LongType()),
            T.StructField("readings", T.LongType()),
            T.StructField("estimate", T.DoubleType()),
            T.StructField("support", T.DoubleType()),
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["a"].notna()]
        if head.empty:  # readings of a neighbour only
            return pd.DataFrame({f.name: pd.Series(dtype="object" if f.name == "src" else "float64") for f in out})
        step, a, b = (int(head[c].iloc[0]) for c in ("step", "a", "b"))
        body = pdf[pdf["at"].notna()]
        at, y = body["at"].to_numpy("int64"), body["y"].to_numpy("float64")
        order = np.argsort(at, kind="stable")
        at, y = at[order], y[order]
        slots = np.arange(a, b + 1)
        base = a * step
        # Relative times: microseconds since 1970 would lose digits in the weighted sums.
        estimate, support = local_linear(((slots - a) * step).astype("float64"), (at - base).astype("float64"), y, reach_periods * step)
        held = at // step - a
        held = held[(held >= 0) & (held < len(slots))]
        return pd.DataFrame(
            {
                "src": head["src"].iloc[0],
                "slot": slots * step,
                "readings": np.bincount(held, minlength=len(slots)),
                "estimate": np.where(support >= min_support, estimate, np.nan),
                "support": support,
            }
        )

    return both.groupBy("src", "chunk").applyInPandas(fit, out).select(
        F.col("src").alias(source),
        micros_to_ntz(F.col("slot")).alias("slot"),
        "readings",
        (F.col("readings") == 0).alias("missing"),
        F.nanvl("estimate", F.lit(None)).alias("estimate"),
        "support",
        F.when(F.col("readings") > 0, "observed").when(F.col("support") >= min_support, "filled").otherwise("missing").alias("status"),
    )
