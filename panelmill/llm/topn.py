"""The N best items of every group, by bounded heaps that merge.

A heap keeps, per group, the N items that come first by score and then by unique identifier.  Keeping
the best N of the best N of the parts gives the best N of the whole, so a hot group is cut where its
rows lie, before the shuffle, and merged after it by the same code.

Items delivered several times have to meet before anything may be cut, since a later delivery can
take a high score back.  ``top_n_latest`` therefore sends each row once, by its group, and cuts there;
only groups that would fill a good part of a task of their own (found by a mergeable sketch of fixed
size over the group keys) go by item first, are cut to N on each partition and then meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows pending in a heap before it is cut back to N per group.
PENDING_ROWS = 200_000


def latest_rows(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Of each key the row that comes last by ``order``; nulls in ``order`` come first.

    A partial aggregation runs before the shuffle, so a key with very many rows stays cheap.
    """
    row = F.struct(*[F.col(c) for c in payload])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("__row")).select(*keys, "__row.*")


def _codes(column: pa.ChunkedArray | pa.Array, descending: bool = False) -> np.ndarray:
    """Dense ranks of the values in their order (bytes order for text), nulls lowest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    ranks = pc.rank(coded.dictionary, tiebreaker="dense").to_numpy(zero_copy_only=False).astype("int64")
    at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    codes = np.where(at < 0, 0, np.append(ranks, 0)[at])
    return -codes if descending else codes


class BoundedHeaps:
    """At most ``n`` rows per group of the rows seen so far, first by ``order``.

    Rows wait in Arrow batches and are cut back together: one sort, a rank in each group, a filter.
    """

    def __init__(self, n: int, group: list[str], order: list[tuple[str, bool]]):
        self.n, self.group, self.order = n, group, order
        self._parts: list[pa.Table] = []
        self.rows = self._after_cut = 0

    def add(self, part: pa.Table) -> None:
        if part.num_rows:
            self._parts.append(part)
            self.rows += part.num_rows

    @property
    def full(self) -> bool:
        return self.rows > 2 * self._after_cut + PENDING_ROWS

    def _groups(self, table: pa.Table) -> np.ndarray:
        group = np.zeros(table.num_rows, "int64")
        for name in self.group:
            codes = _codes(table[name])
            _, group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)
        return group

    def cut(self) -> None:
        if not self._parts:
            return
        table = pa.concat_tables(self._parts).combine_chunks()
        group = self._groups(table)
        keys = [_codes(table[name], descending) for name, descending in self.order]
        order = np.lexsort([*reversed(keys), group])
        sorted_group = group[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        self._parts = [table.take(pa.array(np.sort(order[place < self.n])))]  # rows stay in the order they came
        self.rows = self._after_cut = self._parts[0].num_rows

    def drain(self, but_last_group: bool = False) -> Iterator[pa.RecordBatch]:
        """What is kept; ``but_last_group`` holds back the group of the last row, which may go on."""
        self.cut()
        held: list[pa.Table] = []
        for part in self._parts:
            if but_last_group and part.num_rows:
                group = self._groups(part)
                going_on = pa.array(group == group[-1])
                held.append(part.filter(going_on))
                part = part.filter(pc.invert(going_on))
            yield from part.to_batches(max_chunksize=50_000)
        self._parts = held
        self.rows = self._after_cut = sum(p.num_rows for p in held)


def heap_pass(df: DataFrame, n: int, group: list[str], order: list[tuple[str, bool]], grouped: bool) -> DataFrame:
    """The first ``n`` rows of each group within each partition, in bounded memory.

    ``grouped``: the rows of a group follow each other, so a finished group leaves at once.  Else the
    heaps are emptied whenever they hold many groups: right before a shuffle, where a group may come out
    of a partition more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = BoundedHeaps(n, group, order)
        for batch in batches:
            heaps.add(pa.Table.from_batches([batch]))
            if heaps.full:
                if grouped:
                    yield from heaps.drain(but_last_group=True)
                else:
                    heaps.cut()
                    if heaps.rows > 4 * PENDING_ROWS:
                        yield from heaps.drain()
        yield from heaps.drain()

    return df.mapInArrow(run, df.schema)


def merge_pass(df: DataFrame, n: int, group: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """Brings each group together, in a sorted stream, and keeps its first ``n`` rows."""
    return heap_pass(df.repartition(*group).sortWithinPartitions(*group), n, group, order, grouped=True)


def top_n_per_group(df: DataFrame, n: int, group: list[str], order: list[tuple[str, bool]], keep: Column | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` = [(column, descending), ...].

    End ``order`` with a unique identifier of the item: then equal scores always give the same rows.
    Rows for which ``keep`` is not true drop out first.  Defined cases: a group with fewer rows gives
    all of them; null group keys form groups of their own; nulls in an order column come first
    ascending and last descending; rows repeated in full count each; an empty table and ``n`` = 0 give
    an empty result; other columns travel along, so narrow the input first.
    """
    rows = df.where(keep) if keep is not None else df
    return merge_pass(heap_pass(rows, n, group, order, grouped=False), n, group, order)


def hot_groups(df: DataFrame, group: list[str], partitions: int) -> DataFrame:
    """``hash`` of the groups that may hold over a quarter of an average partition's rows.

    One pass over the group keys with a mergeable sketch of frequent items, one row of fixed size: at
    most 4 x ``partitions`` groups can be that large, and the sketch misses none of them.
    """
    most = min(4 * partitions, 100_000)
    key = F.xxhash64(*group).alias("hash")
    found = df.select(key).agg(F.expr(f"approx_top_k(hash, {most}, {min(8 * most, 1_000_000)})").alias("top"), F.count("*").alias("n"))
    return found.select(F.inline("top"), "n").where(F.col("count") * F.lit(4 * partitions) > F.col("n")).select(F.col("item").alias("hash"))


def top_n_latest(
    df: DataFrame, n: int, group: list[str], item: list[str], latest: list[str], order: list[tuple[str, bool]], payload: list[str], keep: Column | None = None
) -> DataFrame:
    """The first ``n`` items of each group by ``order``, where of each item only the row that comes last by ``latest`` counts.

    Output columns: ``group``, ``item`` and ``payload``.  ``keep`` is applied to the latest rows.  Hot
    groups and the rest take different ways to the same rows; see the module's docstring.  Defined
    cases are those of ``top_n_per_group``; nulls in ``latest`` come first, so an item with only such
    rows keeps one of them; which one of rows equal in all of ``latest`` counts is open, so end it with
    an identifier.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([*group, *item, *latest, *payload]))
    # At most 4 hashes a partition: a broadcast of known size.
    hot = F.broadcast(hot_groups(rows, group, partitions))
    key = F.xxhash64(*group)
    warm, cold = rows.join(hot, key == F.col("hash"), "left_semi"), rows.join(hot, key == F.col("hash"), "left_anti")

    def items(part: DataFrame) -> DataFrame:
        last = latest_rows(part, [*group, *item], latest, payload)
        return last.where(keep) if keep is not None else last

    # Cold: one exchange by group; an item's rows are a part of its group's, so all of them are there.
    here = items(cold.repartition(*group)).sortWithinPartitions(*group)
    met = merge_pass(heap_pass(items(warm), n, group, order, grouped=False), n, group, order)
    return heap_pass(here, n, group, order, grouped=True).unionByName(met)
