import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm.packing import SizeSet, pack, pack_documents, reduce_instance, reduce_relaxed


def fewest(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
@settings(max_examples=200, deadline=None)
def test_reduction_loses_nothing(case):
    capacity, sizes = case
    free = SizeSet(sizes)
    fixed = reduce_instance(free, capacity)
    rest = [s for s, items in free.items.items() for _ in items]
    assert sorted([i for f in fixed for i in f] + [i for items in free.items.values() for i in items]) == list(range(len(sizes)))
    assert len(fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
@settings(max_examples=200, deadline=None)
def test_relaxed_reduction_is_a_lower_bound(case):
    capacity, sizes = case
    free = SizeSet(sizes)
    fixed = reduce_instance(free, capacity)
    more, aside = reduce_relaxed(free, capacity)
    assert not free and sorted([i for c in fixed + more for i in c] + [i for _, i in aside]) == list(range(len(sizes)))
    assert len(fixed) + len(more) <= fewest(sizes, capacity) <= len(pack(sizes, capacity))
    assert sorted(i for c in pack(sizes, capacity) for i in c) == list(range(len(sizes)))


def test_three_and_more_partners_are_proven():
    assert sorted(map(sorted, reduce_instance(SizeSet([40, 20, 20, 20]), 100))) == [[0, 1, 2, 3]]
    assert sorted(map(sorted, reduce_instance(SizeSet([30, 17, 17, 17, 17]), 100))) == [[0, 1, 2, 3, 4]]


def test_packing_is_tight_and_whole():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(7, 0.8, 5000).astype(int), 8192).tolist()
    containers = pack(sizes, 8192)
    assert sorted(i for c in containers for i in c) == list(range(5000)) and all(sum(sizes[i] for i in c) <= 8192 for c in containers)
    assert sum(sizes) / 8192 / len(containers) > 0.99


def test_small_cases():
    assert pack([], 10) == [] and pack([0, 0], 10) == [[0, 1]] and sorted(map(sorted, pack([6, 4, 5, 5, 10], 10))) == [[0, 1], [2, 3], [4]]


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 5, 40, 99, 100, 101, 250])) for i in range(400)] + [(7, 40)] * 300 + [(None, 3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, n_tokens long, shard string, part int")
    out = pack_documents(df, 100, 4).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 100
    assert out.n_tokens.sum() == sum(n or 0 for _, n in rows) and (out.part == 0).sum() == len(rows)
    whole = out[out.doc_id == [i for i, n in rows if n == 250][0]].sort_values("part")
    assert whole.n_tokens.tolist() == [100, 100, 50] and whole.first_token.tolist() == [0, 100, 200]
    assert {r["container"] >> 32 for r in out.to_dict("records")} == {0, 1, 2, 3}
    rows_of = lambda d: sorted(map(str, d.collect()))
    assert rows_of(pack_documents(df.repartition(11, "n_tokens"), 100, 4)) == rows_of(pack_documents(df.coalesce(1), 100, 4))
    assert pack_documents(df.limit(0), 100, 4).count() == 0
