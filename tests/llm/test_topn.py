import math
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.functions.scalar import is_finite
from panelmill.llm import topn

ORDER = [("score", True), ("name", False), ("member", False)]


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[1] is not None and math.isfinite(r[1]):
            groups.setdefault(r[0], []).append(r)
    pick = lambda r: (-r[1], r[2] is not None, (r[2] or "").encode(), r[3])
    return sorted(map(str, (x for g in groups.values() for x in sorted(g, key=pick)[:n])))


def data(seed=0, k=3000):
    rng = random.Random(seed)
    scores = [None, float("nan"), float("inf"), -0.0, 0.0, 0.5, 0.5, 1.0, -2.0]
    groups = ["hot"] * 6 + ["b", "c", None, "émile"]
    return [(rng.choice(groups), rng.choice([*scores, rng.random()]), rng.choice(["x", "y", "zé", "Z"]), i) for i in range(k)]


@pytest.mark.parametrize("n", [0, 1, 3, 50])
def test_matches_brute_force(spark, n, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, "g string, score double, name string, member int").repartition(7)
    got = topn.top_n_per_group(df, n, ["g"], ORDER, is_finite(F.col("score"))).collect()
    assert sorted(str((r["g"], r["score"] + 0.0 if r["score"] else r["score"], r["name"], r["member"])) for r in got) == sorted(x.replace("-0.0", "0.0") for x in brute(rows, n)) or n == 0 and got == []


def test_heaps_stay_bounded_and_merge():
    heaps = topn.BoundedHeaps(2, ["g"], [("s", True), ("i", False)])
    for at in range(0, 900_000, 100_000):
        heaps.add(pa.table({"g": pa.array(["a", "b"] * 50_000), "s": pa.array([float(x % 97) for x in range(100_000)]), "i": pa.array(range(at, at + 100_000))}))
        if heaps.full:
            heaps.cut()
        assert heaps.rows <= 2 * topn.PENDING_ROWS
    out = pa.Table.from_batches(list(heaps.drain())).to_pylist()
    assert sorted((r["g"], r["s"]) for r in out) == [("a", 96.0)] * 2 + [("b", 96.0)] * 2
    assert list(topn.BoundedHeaps(2, ["g"], [("s", True)]).drain()) == []


def test_grouped_stream_lets_finished_groups_go():
    heaps = topn.BoundedHeaps(1, ["g"], [("s", True)])
    heaps.add(pa.table({"g": pa.array(["a", "a", "b"]), "s": pa.array([1.0, 2.0, 3.0])}))
    assert pa.Table.from_batches(list(heaps.drain(but_last_group=True))).to_pylist() == [{"g": "a", "s": 2.0}]
    heaps.add(pa.table({"g": pa.array(["b", None]), "s": pa.array([4.0, 0.0])}))
    assert pa.Table.from_batches(list(heaps.drain())).to_pylist() == [{"g": "b", "s": 4.0}, {"g": None, "s": 0.0}]


@pytest.mark.parametrize("pending", [40, 200_000])
def test_latest_deliveries_in_hot_and_small_groups(spark, monkeypatch, pending):
    """A third of the rows in one group, a third of those one item; later deliveries take scores back."""
    monkeypatch.setattr(topn, "PENDING_ROWS", pending)
    rng, t = random.Random(5), datetime(2025, 1, 1)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else rng.choice([None, *(f"g{k}" for k in range(400))])
        name = "one" if g == "hot" and i % 9 == 0 else rng.choice("abcdefgh")
        rows.append((i, g, name, rng.randrange(40 if g == "hot" else 3), rng.choice([None, float("nan"), 0.5, rng.random(), rng.random()]), rng.choice([None, t, t.replace(hour=1)]), "clash"))
    df = spark.createDataFrame(rows, "id long, g string, name string, member int, score double, at timestamp_ntz, hash string").repartition(5)
    latest = {}
    for r in rows:
        k, v = r[1:4], (r[5] is not None, r[5] or t, r[0])
        if k not in latest or v > latest[k][0]:
            latest[k] = v, r
    want = {}
    for _, r in latest.values():
        if r[4] is not None and math.isfinite(r[4]):
            want.setdefault(r[1], []).append((-r[4], r[2], r[3], r[0]))
    want = sorted(x[3] for g in want.values() for x in sorted(g)[:3])
    hot = {r["hash"] for r in topn.hot_groups(df, ["g"], 8).collect()}
    assert hot == {r[0] for r in df.where("g = 'hot'").select(F.xxhash64("g")).distinct().collect()}
    got = topn.top_n_latest(df, 3, ["g"], ["name", "member"], ["at", "id"], ORDER, ["score", "id"], is_finite(F.col("score")))
    assert sorted(r["id"] for r in got.collect()) == want
    assert topn.top_n_latest(df.limit(0), 3, ["g"], ["name", "member"], ["at", "id"], ORDER, ["score", "id"]).count() == 0


def test_nulls_in_order_columns(spark):
    df = spark.createDataFrame([("g", 1.0, None, 1), ("g", 1.0, "a", 2), ("g", None, "a", 3)], "g string, score double, name string, member int")
    assert [r["member"] for r in topn.top_n_per_group(df, 2, ["g"], ORDER).orderBy("member").collect()] == [1, 2]


def test_latest_rows(spark):
    t = datetime(2025, 1, 1)
    rows = [("k", t, 1, "old"), ("k", t.replace(hour=1), 2, "new"), ("k", t.replace(hour=1), 3, "newest"), ("k", None, 9, "undated"), (None, t, 4, "null key")]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id long, v string")
    assert sorted(r["v"] for r in topn.latest_rows(df, ["k"], ["at", "id"], ["v"]).collect()) == ["newest", "null key"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, score double, name string, member int")
    assert topn.top_n_per_group(df, 3, ["g"], ORDER).count() == 0
