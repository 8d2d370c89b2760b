"""Permutation nulls and circular block bootstrap.

Two random sources: draws from md5 text, which any SQL engine can repeat row by row, and NumPy's
PCG64 stream where results must match a given seed bit for bit (one bounded series per task).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelmill.functions.scalar import epoch_micros, join_null_safe
from panelmill.operators.xsection import with_ranks


def md5_draw(*parts: Column) -> Column:
    """A text that orders like a uniform draw, from the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def md5_index(modulus: Column | int, *parts: Column) -> Column:
    """A draw from 0 .. modulus - 1, from the first seven hexadecimal digits of the md5 of the parts."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.pmod(F.conv(F.substring(md5_draw(*parts), 1, 7), 16, 10).cast("bigint"), m)


def section_ranks(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per cross-section: ``rows``, its (symbol, prediction_rank, target_rank) by symbol."""
    return with_ranks(df, by).groupBy(*by, "timestamp").agg(F.sort_array(F.collect_list(F.struct("symbol", "prediction_rank", "target_rank"))).alias("rows"))


def paired_correlation(x: Column, y: Column) -> Column:
    """``correlation`` of two arrays of ranks of the same length, pair by pair."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    add = {"n": lambda a, b: F.lit(1.0), "a": lambda a, b: a, "b": lambda a, b: b, "aa": lambda a, b: a * a, "bb": lambda a, b: b * b, "ab": lambda a, b: a * b}

    def step(s: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(*[(s[k] + f(a, b)).alias(k) for k, f in add.items()])).otherwise(s)

    def finish(s: Column) -> Column:
        va, vb = s["n"] * s["aa"] - s["a"] * s["a"], s["n"] * s["bb"] - s["b"] * s["b"]
        return F.try_divide(s["n"] * s["ab"] - s["a"] * s["b"], F.when((va > 0) & (vb > 0), F.sqrt(va * vb)))

    return F.aggregate(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), zero, step, finish)


def permuted_ic(df: DataFrame, permutations: int, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Mean rank IC per permutation of the targets within each timestamp.

    Ranks are computed once and a cross-section is gathered once; its permutations run inside its arrays,
    so what fans out is timestamps, not rows.  A permutation orders the symbols of a timestamp by an md5
    draw that does not depend on ``by``, so all models see the same permuted targets.
    """
    us = epoch_micros(F.col("timestamp"))
    cells = section_ranks(df, by).select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
    # The symbol in n-th place by draw gives its target to the symbol in n-th place by name.
    drawn = F.array_sort(F.transform("rows", lambda x: F.struct(md5_draw(F.col("permutation"), us, x["symbol"]).alias("d"), x["target_rank"].alias("t"))))
    per = cells.select(*by, "permutation", paired_correlation(F.col("rows.prediction_rank"), F.transform(drawn, lambda x: x["t"])).alias("ic"))
    return per.groupBy(*by, "permutation").agg(F.avg("ic").alias("mean_rank_ic"), F.count("ic").alias("n_timestamps"))


def null_summary(nulls: DataFrame, observed: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Null moments, z-score and two-sided p = (#{|null| >= |observed|} + 1) / (n + 1); ``observed`` has observed_mean_rank_ic."""
    x, o = F.col("mean_rank_ic"), F.col("observed_mean_rank_ic")
    spread = F.stddev_samp(x)
    return nulls.join(observed, by).groupBy(*by).agg(
        F.max(o).alias("observed_mean_rank_ic"), F.avg(x).alias("null_mean_rank_ic"), spread.alias("null_rank_ic_std"),
        F.min(x).alias("null_min_rank_ic"), F.max(x).alias("null_max_rank_ic"),
        F.try_divide(F.max(o) - F.avg(x), F.when(spread > 0, spread)).alias("observed_null_zscore"),
        ((F.count_if(F.abs(x) >= F.abs(o)) + 1) / (F.count("*") + 1)).alias("empirical_two_sided_p_value"),
        F.count("*").alias("permutations"),
    )


def circular_block_sums(series: DataFrame, value: str, length: int, by: list[str], order: str = "timestamp") -> DataFrame:
    """For each position, the sum of the ``length`` values from it on, wrapping round at the end.

    ``at`` counts positions from 0.  The first ``length - 1`` values are appended once more and one
    frame does the rest.
    """
    w = Window.partitionBy(*by)
    placed = series.select(*by, (F.row_number().over(w.orderBy(order)) - 1).alias("at"), F.count("*").over(w).alias("n"), F.col(value).alias("v"))
    twice = placed.unionByName(placed.where(F.col("at") < length - 1).withColumn("at", F.col("at") + F.col("n")))
    total = F.sum("v").over(w.orderBy("at").rowsBetween(0, length - 1))
    return twice.select(*by, "at", "n", total.alias("block_sum")).where(F.col("at") < F.col("n"))


def md5_block_bootstrap(series: DataFrame, value: str, length: int, resamples: int, seed: int, by: list[str]) -> DataFrame:
    """Bootstrap means from floor(n / length) whole circular blocks and one of n mod length, with md5 starts; SQL can repeat it.

    The starts (resamples x blocks) join the block sums by position, those of the partial block the
    values themselves.  A series shorter than a block has no rows.
    """
    keys = [*by, "at"]
    w = Window.partitionBy(*by)
    placed = series.select(*by, (F.row_number().over(w.orderBy("timestamp")) - 1).cast("bigint").alias("at"), F.col(value).alias("v"))
    whole = circular_block_sums(series, value, length, by).select(*by, F.col("at").cast("bigint").alias("at"), "n", F.col("block_sum").alias("v"))
    n = whole.groupBy(*by).agg(F.max("n").alias("n")).where(F.col("n") >= length)
    draws = n.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    blocks = draws.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / length) - 1)).alias("block"))
    starts = blocks.select(*by, "n", "resample", md5_index(F.col("n"), F.lit(seed), F.col("resample"), F.col("block")).alias("at"))
    rest, first = F.col("n") % length, md5_index(F.col("n"), F.lit(seed), F.col("resample"), F.lit("rest"))
    steps = draws.where(rest > 0).select(*by, "n", "resample", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), rest - 1), lambda i: (first + i) % F.col("n"))).alias("at"))
    drawn = join_null_safe(starts, whole.select(*keys, "v"), keys).unionByName(join_null_safe(steps, placed, keys))
    return drawn.groupBy(*by, "resample").agg((F.sum("v") / F.max("n")).alias("mean_value"))


def bootstrap_summary(samples: DataFrame, value: str, level: float, by: list[str]) -> DataFrame:
    """Mean, deviation, central interval (linear quantiles) and share above zero of bootstrap values."""
    x, a = F.col(value), (1.0 - level) / 2.0
    return samples.groupBy(*by).agg(
        F.count("*").alias("resamples"), F.avg(x).alias("bootstrap_mean"), F.stddev_samp(x).alias("bootstrap_std"),
        F.percentile(x, a).alias("confidence_lower"), F.percentile(x, 1.0 - a).alias("confidence_upper"),
        F.avg((x > 0).cast("double")).alias("probability_positive"),
    )


def block_sums(values: np.ndarray, length: int) -> np.ndarray:
    """Circular window sums of each column by prefix sums."""
    ends = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(np.concatenate([values, values[: length - 1]]), axis=0)])
    return ends[length:] - ends[:-length] if length else np.zeros_like(values)


def bootstrap_means(values: np.ndarray, resamples: int, length: int, seed: int, chunk: int = 128) -> np.ndarray:
    """Circular block bootstrap of column means: floor(n / L) whole blocks and one of n mod L, uniform starts.

    Draw order of the seeded generator: chunk by chunk, all starts of the whole blocks, then those of the partial ones.
    """
    n = len(values)
    if not 1 <= length <= n:
        raise ValueError("block length must lie between 1 and the length of the series")
    rng, (whole, rest) = np.random.default_rng(seed), divmod(n, length)
    full, part = block_sums(values, length), block_sums(values, rest) if rest else None
    out = []
    for at in range(0, resamples, chunk):
        k = min(chunk, resamples - at)
        total = full[rng.integers(0, n, size=(k, whole))].sum(axis=1)
        if part is not None:
            total = total + part[rng.integers(0, n, size=k)]
        out.append(total / n)
    return np.concatenate(out)


def seeded_block_bootstrap(series: DataFrame, values: list[str], length: int, resamples: int, seed: str, by: list[str], order: str = "timestamp") -> DataFrame:
    """Bootstrap means of ``values`` per group with NumPy's stream; null values are left out of numerator and count.

    ``seed`` is an integer column, constant in a group.  One task holds one series: a timeline of one
    number per timestamp, some hundred thousand rows at most.
    """
    fields = ", ".join([*(f"`{b}` {series.schema[b].dataType.simpleString()}" for b in by), "resample int", *(f"`{v}` double" for v in values)])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[values].to_numpy("float64")
        ok = np.isfinite(x)
        both = bootstrap_means(np.concatenate([np.where(ok, x, 0.0), ok.astype("float64")], axis=1), resamples, length, int(pdf["__seed"].iloc[0]))
        with np.errstate(invalid="ignore", divide="ignore"):
            means = both[:, : len(values)] / both[:, len(values) :]
        out = pd.DataFrame(means, columns=values)
        out.insert(0, "resample", np.arange(resamples, dtype="int32"))
        for i, b in reversed(list(enumerate(by))):
            out.insert(0, b, key[i])
        return out

    return series.select(*by, order, *values, F.col(seed).alias("__seed")).groupBy(*by).applyInPandas(run, fields)


def portfolio_distribution(samples: DataFrame, cost: float, annual: float, by: list[str]) -> DataFrame:
    """Per resample: cohorts' bootstrap means weighted equally, with net return, annualised returns and break-even cost."""
    g, t = F.col("gross"), F.col("mean_turnover")
    rows = samples.groupBy(*by, "resample").agg(F.avg("gross_return").alias("gross"), F.avg("turnover").alias("mean_turnover"))
    net = g - t * cost / 10_000.0
    return rows.select(*by, "resample", "mean_turnover", (g * annual).alias("gross_annualized_return"), (net * annual).alias("net_annualized_return"), (F.try_divide(g, t) * 10_000.0).alias("break_even_cost_bps"))


def seeded_permutation_ic(df: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Mean rank IC per (model, fold, permutation) with rows permuted by a seeded uniform matrix of timestamps x symbols.

    Seeds are (seed, permutation, fold): one fold's permuted targets are shared by all its models.  Each
    timestamp jumps the generator to its own row of the matrix, so a cross-section is all a task needs.
    Cross-sections that lack one of the fold's symbols are left out.
    """
    by = ["model", "fold"]
    row = Window.partitionBy("fold").orderBy("timestamp")  # over a fold's distinct timestamps only
    rows_of = df.select("fold", "timestamp").distinct().select("fold", "timestamp", (F.row_number().over(row) - 1).cast("bigint").alias("row"))
    width = df.groupBy("fold").agg(F.countDistinct("symbol").alias("width"))
    cells = section_ranks(df, by).join(rows_of, ["fold", "timestamp"]).join(width, "fold").where(F.size("rows") == F.col("width"))
    flat = cells.select(*by, "row", F.col("rows.prediction_rank").alias("p"), F.col("rows.target_rank").alias("t"))
    schema = T.StructType([df.schema["model"], df.schema["fold"], T.StructField("ic", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list[dict]] = {}
        bits = np.random.PCG64()
        draw = np.random.Generator(bits).random
        for batch in batches:
            out = []
            for fold, at, p, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if fold not in states:
                    states[fold] = [np.random.PCG64(np.random.SeedSequence([seed, k, int(fold)])).state for k in range(permutations)]
                p, t = np.array(p, "float64"), np.array(t, "float64")
                orders = np.empty((permutations, len(t)), "int64")
                for k, state in enumerate(states[fold]):
                    bits.state = state
                    bits.advance(at * len(t))
                    orders[k] = np.argsort(draw(len(t)), kind="stable")
                a, b = p - p.mean(), t[orders] - t.mean()
                d = np.sqrt((a * a).sum() * (b * b).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    out.append(np.where(d > 0, b @ a / d, np.nan).tolist())
            ics = [[None if x != x else x for x in row] for row in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ics, pa.list_(pa.float64()))], schema=to_arrow_schema(schema))

    per = flat.mapInArrow(run, schema).select(*by, F.posexplode("ic").alias("permutation", "ic"))
    return per.groupBy(*by, "permutation").agg(F.avg("ic").alias("mean_rank_ic"), F.count("ic").alias("n_timestamps"))
