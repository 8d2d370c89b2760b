from datetime import datetime, timedelta

import numpy as np
import pytest

from panelmill.operators import networks as N

RNG = np.random.default_rng(0)


SHAPES = {"mlp": (N.mlp_init(5, (7, 3), 1), (11, 5)), "tcn": (N.tcn_init(3, 4, 3, 1), (5, 9, 3)), "transformer": (N.transformer_init(2, 2, 4, 8, 2, 1, 6), (3, 8, 2))}


@pytest.mark.parametrize("kind", sorted(SHAPES))
def test_gradients_match_differences(kind):
    w, shape = SHAPES[kind]
    x, y = RNG.normal(size=shape), RNG.normal(size=shape[0])
    loss, g = N.gradient(kind, w, x, y)
    assert loss == pytest.approx(float(((N.FORWARD[kind](w, x) - y) ** 2).mean()))
    for k in w:
        for at in {0, w[k].size // 2, w[k].size - 1}:
            place = np.unravel_index(at, w[k].shape)
            lo, hi = ({**w, k: w[k].copy()} for _ in range(2))
            lo[k][place] -= 1e-5
            hi[k][place] += 1e-5
            assert g[k][place] == pytest.approx((N.gradient(kind, hi, x, y)[0] - N.gradient(kind, lo, x, y)[0]) / 2e-5, rel=1e-4, abs=1e-7), k


def test_mlp_learns_and_stops():
    x = RNG.normal(size=(3000, 4))
    y = x[:, 0] - x[:, 1]
    g = np.arange(1000) // 10
    w, history = N.train("mlp", N.mlp_init(4, (16,)), (x[:2000], y[:2000]), (x[2000:], y[2000:], g), epochs=12, batch=64, rate=3e-3)
    assert N.mean_row_ic(N.mlp_forward(w, x[2000:]), y[2000:], g) > 0.85 and history[-1]["train_loss"] < history[0]["train_loss"]
    start = N.mlp_init(4)
    kept, short = N.train("mlp", start, (x[:100], y[:100]), (x[:100], np.zeros(100), np.zeros(100)), epochs=8)
    assert len(short) == 2 and kept is start
    with pytest.raises(ValueError):
        N.dropout(1.0, RNG)


@pytest.mark.parametrize("kind", ["tcn", "transformer"])
def test_sequence_models_learn(kind):
    x = RNG.normal(size=(900, 8, 2))
    y = x[:, -1, 0] + x[:, -2, 1]
    g = np.arange(300) // 10
    start = N.tcn_init(2, 8, 3) if kind == "tcn" else N.transformer_init(2, 2, 4, 16, 1, 0, 16)
    w, history = N.train(kind, start, (x[:600], y[:600]), (x[600:], y[600:], g), epochs=40, patience=40, batch=32, rate=3e-3, drop_rate=0.0)
    assert N.mean_row_ic(N.FORWARD[kind](w, x[600:]), y[600:], g) > 0.6 and history[-1]["train_loss"] < 0.6 * history[0]["train_loss"]


def test_dropout_keeps_the_mean_and_is_off_when_scoring():
    x = np.ones((200, 200))
    dropped = N.dropout(0.25, np.random.default_rng(0))(x)
    assert set(np.unique(dropped.round(9))) == {0.0, round(4 / 3, 9)} and abs(dropped.mean() - 1) < 0.02
    w, shape = SHAPES["tcn"]
    assert np.array_equal(N.tcn_forward(w, np.ones(shape)), N.tcn_forward(w, np.ones(shape)))


def test_minibatches_cover_every_row():
    rows = np.concatenate(list(N.minibatches(103, 10, np.random.default_rng(1))))
    assert sorted(rows.tolist()) == list(range(103)) and rows.tolist() != list(range(103))


def test_convolution_is_causal_with_receptive_field_128():
    w, x = N.tcn_init(3, 8, 7), RNG.normal(size=(1, 200, 3))
    base = N.tcn_forward(w, x)
    for at, seen in ((72, True), (71, False), (199, True)):
        y = x.copy()
        y[0, at] += 1
        assert (abs(N.tcn_forward(w, y) - base)[0] > 1e-12) == seen
    z = x.copy()
    z[0, 150:] = 9
    assert np.array_equal(N.causal_conv(x, RNG.normal(size=(2, 3, 3)), np.zeros(3), 4)[0, :150].shape, (150, 3))
    k = RNG.normal(size=(2, 3, 3))
    assert np.allclose(N.causal_conv(x, k, np.zeros(3), 4)[0, :150], N.causal_conv(z, k, np.zeros(3), 4)[0, :150])


def test_attention_is_causal():
    w, x = N.transformer_init(3), RNG.normal(size=(2, 128, 3))
    y = x.copy()
    y[:, 64:] += 1
    a, b = N.transformer_tokens(w, x), N.transformer_tokens(w, y)
    assert np.allclose(a[:, :16], b[:, :16]) and not np.allclose(a[:, 16], b[:, 16]) and N.transformer_forward(w, x).shape == (2,)


def test_scoring_on_executors(spark):
    t = datetime(2025, 1, 1)
    rows = [(t + timedelta(hours=i), "A", float(i), float(-i), [[float(i), 1.0]] * 8) for i in range(20)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, a double, b double, window array<array<double>>")
    w = N.mlp_init(2, (4,))
    got = {r["timestamp"]: r["prediction"] for r in N.score(df, "mlp", w, ["a", "b"], ["timestamp", "symbol"]).collect()}
    assert got[t + timedelta(hours=3)] == pytest.approx(float(N.mlp_forward(w, np.array([[3.0, -3.0]]))[0]))
    v = N.tcn_init(2, 4, 3)
    assert N.score(df, "tcn", v, "window", ["timestamp"]).count() == 20
    assert N.score(df.limit(0), "tcn", v, "window", ["timestamp"]).count() == 0
    x, y, g = N.driver_sample(df.withColumn("target", df.a), ["a", "b"], ["timestamp", "symbol"], rows=7)
    assert x.shape == (7, 2) and len(y) == len(g) == 7
