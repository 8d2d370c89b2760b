"""Rolling totals over trailing calendar periods, idle days included.

Three steps, two of them ordinary partial aggregations:

1. repeated deliveries of an (entity, timestamp) collapse to one row, per value the latest
   finite delivery; the shuffle key has the timestamp in it, so a hot entity spreads;
2. rows collapse to one monoid element (sum, count, min, max) per entity and day, with
   map-side combine, so an entity's input to step 3 is bounded by the calendar;
3. inside partitions hashed by entity and sorted by day, a two-stack queue per trailing
   period holds the active window and emits one row for every day from the entity's first
   to its last active day.

The queue needs only an associative combine, never an inverse, hence min and max come at
the same amortised O(1) a day as the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.scalar import finite_or_null

#: One value's element: sum, count, min, max.
Element = tuple[float, int, float, float]
EMPTY: Element = (0.0, 0, float("inf"), float("-inf"))
BATCH_ROWS = 20_000


def combine(a: tuple, b: tuple) -> tuple:
    """Associative combine of two tuples of elements, older first."""
    return tuple(
        (x[0] + y[0], x[1] + y[1], x[2] if x[2] <= y[2] else y[2], x[3] if x[3] >= y[3] else y[3]) for x, y in zip(a, b)
    )


class TwoStackQueue:
    """A FIFO window with an O(1) amortised total under an associative operation.

    The back stack keeps a running total of the newest elements; the front stack keeps, for each
    element, the total of itself and everything newer in that stack.  When the front runs out,
    the back is turned over onto it once.
    """

    __slots__ = ("_back", "_back_total", "_combine", "_front", "_zero")

    def __init__(self, zero: Any, combine: Callable[[Any, Any], Any]):
        self._zero, self._combine = zero, combine
        self._front: list[tuple[int, Any]] = []
        self._back: list[tuple[int, Any]] = []
        self._back_total = zero

    def push(self, key: int, element: Any) -> None:
        """Append an element; keys must not decrease."""
        self._back.append((key, element))
        self._back_total = self._combine(self._back_total, element)

    def evict_through(self, key: int) -> None:
        """Drop every element with a key up to and including ``key``."""
        while True:
            if not self._front:
                if not self._back or self._back[0][0] > key:
                    return
                total = self._zero
                while self._back:
                    k, e = self._back.pop()
                    total = self._combine(e, total)
                    self._front.append((k, total))
                self._back_total = self._zero
            if self._front[-1][0] > key:
                return
            self._front.pop()

    def total(self) -> Any:
        """Total of the whole window, oldest to newest."""
        return self._combine(self._front[-1][1], self._back_total) if self._front else self._back_total


def trailing_rows(days: Iterator[tuple[int, tuple]], periods: list[int], width: int) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(day, active, totals by period) for each day from the first to the last of ``days`` (ascending)."""
    zero = (EMPTY,) * width
    queues = [TwoStackQueue(zero, combine) for _ in periods]
    at: int | None = None
    for day, element in days:
        while at is not None and at < day:  # idle days since the last active one
            for q, p in zip(queues, periods):
                q.evict_through(at - p)
            yield at, False, [q.total() for q in queues]
            at += 1
        for q, p in zip(queues, periods):
            q.evict_through(day - p)
            q.push(day, element)
        yield day, True, [q.total() for q in queues]
        at = day + 1


def rolling_totals(
    df: DataFrame,
    entity: str,
    timestamp: str,
    values: list[str],
    periods: list[int] = [7, 30],  # noqa: B006
    sequence: str | None = None,
) -> DataFrame:
    """One row per entity and UTC day from its first to its last active day.

    Columns: ``entity``, ``day`` (date), ``active`` and for each period p and value v
    ``{v}_sum_{p}d``, ``{v}_avg_{p}d``, ``{v}_count_{p}d``, ``{v}_min_{p}d``, ``{v}_max_{p}d``.

    Defined cases: null, NaN and infinite values do not count; a day is active if any value of a
    row on it is finite; (entity, timestamp) counts once, per value the finite one with the largest
    ``sequence``; rows without a timestamp belong to no day and are left out; a null entity is an
    entity of its own; a window without values has sum 0, count 0 and null average, minimum and
    maximum; an empty table gives an empty result; columns not named here are ignored, whatever
    their names.
    """
    width = len(values)
    narrow = df.select(
        F.col(entity).alias("e"),
        F.col(timestamp).cast("timestamp_ntz").alias("t"),
        F.col(sequence).cast("bigint").alias("s") if sequence else F.lit(0).cast("bigint").alias("s"),
        *[finite_or_null(F.col(v).cast("double")).alias(f"v{i}") for i, v in enumerate(values)],
    ).where(F.col("t").isNotNull())
    once = narrow.groupBy("e", "t").agg(
        *[F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("s"))).alias(f"v{i}") for i in range(width)]
    )
    daily = (
        once.groupBy("e", F.datediff(F.to_date("t"), F.lit("1970-01-01").cast("date")).alias("d"))
        .agg(
            *[
                agg(f"v{i}").alias(f"{name}{i}")
                for i in range(width)
                for name, agg in (("s", F.sum), ("n", F.count), ("lo", F.min), ("hi", F.max))
            ]
        )
        .where(" + ".join(f"n{i}" for i in range(width)) + " > 0")
    )
    kind = df.schema[entity].dataType
    stats = (("sum", T.DoubleType()), ("avg", T.DoubleType()), ("count", T.LongType()), ("min", T.DoubleType()), ("max", T.DoubleType()))
    out = T.StructType(
        [T.StructField(entity, kind), T.StructField("day", T.DateType()), T.StructField("active", T.BooleanType())]
        + [T.StructField(f"{v}_{name}_{p}d", t) for p in periods for v in values for name, t in stats]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[Any, int, tuple]]:
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                for row in zip(*cols):
                    yield row[0], row[1], tuple(
                        (row[j] or 0.0, row[j + 1], row[j + 2], row[j + 3]) if row[j + 1] else EMPTY for j in range(2, 2 + 4 * width, 4)
                    )

        target = None
        held: list[list] = []

        def flush() -> pa.RecordBatch:
            nonlocal held
            arrays = [pa.array(c, type=target.field(i).type) for i, c in enumerate(zip(*held))]
            held = []
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        stream = rows()
        pending = next(stream, None)
        while pending is not None:
            if target is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(out)
            name = pending[0]

            def days() -> Iterator[tuple[int, tuple]]:
                nonlocal pending
                while pending is not None and pending[0] == name:  # noqa: B023
                    yield pending[1], pending[2]
                    pending = next(stream, None)

            for day, active, totals in trailing_rows(days(), periods, width):
                row = [name, day, active]
                for total in totals:
                    for s, n, lo, hi in total:
                        row += (s, s / n, n, lo, hi) if n else (0.0, None, 0, None, None)
                held.append(row)
                if len(held) >= BATCH_ROWS:
                    yield flush()
        if held:
            yield flush()

    return daily.repartition("e").sortWithinPartitions("e", "d").mapInArrow(run, out)
