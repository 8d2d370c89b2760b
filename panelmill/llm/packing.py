"""Documents into containers of fixed capacity: dominance reduction, then best fit.

Documents are spread at random over shards of bounded size and each shard is packed by itself, so
no task ever holds more than a shard and the price of not packing across shards is less than one
container in each.

Within a shard, the reduction of Martello and Toth goes through the documents from the largest
down and fixes a set for good wherever it provably dominates every other set with that document:

* nothing else fits beside it: the document alone;
* another fills the container exactly, or weighs as much as the best pair where at most two fit: with
  that one;
* at most k more fit (k up to MOST_PARTNERS), and the largest that fits, the largest that fits beside
  that, and so on are k documents of which the i-th is at least as large as the i-th largest of any
  other set: with these.

What is fixed leaves the instance; passes repeat until none fixes anything.  Then the instance is
relaxed: its smallest documents are set aside, a share at a time, and the reduction goes on with the
rest.  What it fixes then is the best for the relaxed instance, so the number of containers so far
never exceeds what the whole instance needs at least.  Best fit decreasing packs what was set aside
into the room that is left and into new containers.  Sizes are looked up in bit sets (one bit per size
or residual), so a lookup costs a few machine words per thousand tokens of capacity.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partners beside a document up to which dominance is tried.
MOST_PARTNERS = 4
#: Share of the remaining documents that is set aside at once when no set is proven.
RELAXED_SHARE = 0.25

class SizeSet:
    """Items by size, with the largest size up to a bound and the smallest sizes."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(sizes):
            self.items[s].append(i)
        self.mask = 0
        for s in self.items:
            self.mask |= 1 << s

    def __bool__(self) -> bool:
        return self.mask != 0

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            self.mask ^= 1 << size
        return item

    def put(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.mask |= 1 << size

    def largest(self, bound: int) -> int:
        """Largest size up to ``bound``, or -1."""
        return (self.mask & ((2 << bound) - 1)).bit_length() - 1 if bound >= 0 else -1

    def smallest(self, n: int, above: int = -1) -> list[int]:
        """The ``n`` smallest sizes over ``above``, each as often as it has items."""
        out: list[int] = []
        mask = self.mask >> (above + 1) << (above + 1)
        while mask and len(out) < n:
            s = (mask & -mask).bit_length() - 1
            out += [s] * min(len(self.items[s]), n - len(out))
            mask &= mask - 1
        return out

    def pair_between(self, over: int, bound: int) -> bool:
        """Whether two items sum to more than ``over`` and at most ``bound``."""
        mask = self.mask & ((2 << bound) - 1)
        while mask:
            a = mask.bit_length() - 1
            mask ^= 1 << a
            if 2 * a <= over:
                return False
            b = self.largest(min(bound - a, a))
            if b == a and len(self.items[a]) < 2:
                b = self.largest(min(bound - a, a - 1))
            if b >= 0 and a + b > over:
                return True
        return False


def dominating_partner_sizes(free: SizeSet, rest: int) -> list[int] | None:
    """Sizes of a set that dominates all others beside a document that leaves ``rest``; None if none is proven.

    The document itself is not in ``free``.
    """
    low = free.smallest(MOST_PARTNERS + 1)
    if not low or low[0] > rest:
        return []
    one = free.largest(rest)
    if one == rest:
        return [one]
    fit = int((np.cumsum(low) <= rest).sum())  # so many fit at most
    if fit > MOST_PARTNERS:
        return None
    if fit == 1 or fit == 2 and not free.pair_between(one, rest):
        return [one]
    chosen: list[int] = []
    taken: list[int] = []
    room, proven = rest, True
    while proven and len(chosen) < fit:
        size = free.largest(room)
        if size < 0:
            proven = False  # a set of more documents exists
            break
        # Were the i-th largest of another set larger than this one, i documents over it would fit.
        over = sorted([*free.smallest(len(chosen) + 1, above=size), *(c for c in chosen if c > size)])[: len(chosen) + 1]
        proven = len(over) <= len(chosen) or sum(over) > rest
        chosen.append(size)
        taken.append(free.take(size))
        room -= size
    for size, item in zip(chosen, taken):
        free.put(size, item)
    return chosen if proven else None


def reduce_instance(free: SizeSet, capacity: int) -> list[list[int]]:
    """Containers fixed by dominance; their items leave ``free``."""
    fixed: list[list[int]] = []
    while True:
        before, bound = len(fixed), capacity
        low = free.smallest(MOST_PARTNERS + 1)
        many = sum(low) if len(low) > MOST_PARTNERS else capacity + 1  # so much room holds more partners than are tried
        while (size := free.largest(bound)) >= 0:
            rest = capacity - size
            # Within a pass the smallest items only grow; up there only one that fills the container is a proof.
            unproven = rest >= many and not free.items.get(rest)
            for _ in range(0 if unproven else len(free.items[size])):
                if not free.items[size]:
                    break
                item = free.take(size)
                partners = dominating_partner_sizes(free, capacity - size)
                if partners is None:
                    free.put(size, item)
                    break  # items of the same size have the same partners
                fixed.append([item, *(free.take(p) for p in partners)])
            bound = size - 1
            if bound < 0:
                break
        if len(fixed) == before:
            return fixed


def reduce_relaxed(free: SizeSet, capacity: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Containers fixed by dominance while the smallest items are set aside until none is left, and the (size, item) set aside.

    No packing of all items has fewer containers than were fixed.
    """
    fixed: list[list[int]] = []
    aside: list[tuple[int, int]] = []
    while free:
        for _ in range(max(1, int(sum(map(len, free.items.values())) * RELAXED_SHARE))):
            size = (free.mask & -free.mask).bit_length() - 1
            aside.append((size, free.take(size)))
        fixed += reduce_instance(free, capacity)
    return fixed, aside


def best_fit(containers: list[list[int]], room: list[int], items: list[tuple[int, int]], capacity: int) -> None:
    """Best fit decreasing of (size, item) into the ``room`` left in ``containers`` and into new ones, in place."""
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for at, r in enumerate(room):
        by_room[r].append(at)
        rooms |= 1 << r
    for size, item in sorted(items, reverse=True):
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = by_room[left].pop()
            if not by_room[left]:
                rooms ^= 1 << left
            containers[at].append(item)
        else:
            left, at = capacity, len(containers)
            containers.append([item])
        by_room[left - size].append(at)
        rooms |= 1 << (left - size)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of indices into ``sizes``) of total size up to ``capacity``; no size may exceed it.

    Items of size zero join the first container.
    """
    free = SizeSet(sizes)
    empty = free.items.pop(0, [])
    if empty:
        free.mask ^= 1
    containers = reduce_instance(free, capacity)
    fixed, aside = reduce_relaxed(free, capacity)
    containers += fixed
    best_fit(containers, [capacity - sum(sizes[i] for i in c) for c in containers], aside, capacity)
    if empty:
        containers = containers or [[]]
        containers[0].extend(empty)
    return containers


def pack_documents(sized: DataFrame, capacity: int, shards: int, doc_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``doc_id``, ``container``, ``part``, ``first_token`` and ``n_tokens``, one row per document.

    A document over ``capacity`` fills containers of its own with its first parts and its last part is
    packed like a document, hence one row per part.  Defined cases: a document of size zero or null
    has one row of size 0 and joins its shard's first container; repeated rows are packed each; a null
    ``doc_id`` is packed too; an empty table gives an empty result; other columns are ignored.
    """
    schema = T.StructType(
        [T.StructField("doc_id", sized.schema[doc_id].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("container", "part", "first_token", "n_tokens")]
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable")
        n = pdf["size"].to_numpy("int64")
        whole = np.maximum(n - 1, 0) // capacity  # full containers before the last part
        owner = np.repeat(np.arange(len(n)), whole + 1)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(whole + 1) - whole - 1, whole + 1)
        last = part == whole[owner]
        length = np.where(last, n[owner] - part * capacity, capacity)
        container = np.zeros(len(owner), "int64")
        tails = np.flatnonzero(last)
        packed = pack(length[tails].tolist(), capacity)
        for at, items in enumerate(packed):
            container[tails[items]] = at
        heads = np.flatnonzero(~last)
        container[heads] = len(packed) + np.arange(len(heads))
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].to_numpy()[owner],
                "container": (int(key[0]) << 32) + container,
                "part": part,
                "first_token": part * capacity,
                "n_tokens": length,
            }
        )

    # Rows with the same id and size are the same to the packing: numbered, they spread over the shards, and
    # which shard a document goes to hangs on nothing but the data.
    rows = sized.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    numbered = rows.groupBy("doc_id", "size").agg(F.count("*").alias("n")).select("doc_id", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    sharded = numbered.select(F.pmod(F.xxhash64("doc_id", "size", "copy"), F.lit(shards)).alias("shard"), "doc_id", "size")
    # Shards are small in bytes and long in work: a fixed number of tasks, so that they are not joined into a few.
    sharded = sharded.repartition(3 * shards, "shard")
    return sharded.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("doc_id", doc_id)
