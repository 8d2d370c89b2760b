"""Scalar column expressions: finiteness, safe division, epoch arithmetic, time parts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(c: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite; never null."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(is_finite(c), c)


def safe_divide(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den, or ``default`` where den is zero or null."""
    return F.coalesce(F.try_divide(num, den), F.lit(default).cast("double"))


def positive_log(c: Column) -> Column:
    """Natural log of positive values, null elsewhere (no -inf, no NaN)."""
    return F.when(c > 0, F.ln(c))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp without zone (which means UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def floor_div(c: Column, by: Column | int) -> Column:
    """Integer division that rounds towards minus infinity, for any sign of ``c``."""
    by = F.lit(by).cast("bigint") if isinstance(by, int) else by
    c = c.cast("bigint")
    return ((c - F.pmod(c, by)) / by).cast("bigint")


def bucket_micros(ts: Column, width: int, origin: int = 0) -> Column:
    """Start (epoch micros) of the fixed-width bucket that holds ``ts``."""
    at = epoch_micros(ts)
    return at - F.pmod(at - F.lit(origin), F.lit(width).cast("bigint"))


def micros_to_ntz(us: Column) -> Column:
    """Timestamp without zone from epoch microseconds."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of ``value`` on a circle of length ``period``."""
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def label_number(value: float) -> str:
    """Short decimal label that is safe in a column name: 2.0 -> '2', 0.5 -> '0p5'."""
    return f"{value:g}".replace(".", "p").replace("-", "m")


def settle(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each of these evaluated exactly once per row.

    Filters above are otherwise pushed through a projection by substituting its expressions, which
    evaluates a costly one (splitting, parsing) once per mention.  A generator of one row is a
    boundary the optimizer does not substitute through.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which null keys meet null keys; the key columns come from ``left``."""
    other = right.select(*[F.col(c).alias(f"__r{i}") if c in on else F.col(c) for i, c in enumerate(right.columns)])
    names = {c: f"__r{right.columns.index(c)}" for c in on}
    met = left.join(other, all_of([F.col(c).eqNullSafe(F.col(names[c])) for c in on]), how)
    return met if how in ("left_semi", "left_anti") else met.drop(*names.values())
