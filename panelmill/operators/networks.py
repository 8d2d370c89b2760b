"""Neural scores of a panel in NumPy: a feature MLP, a causal convolution network, a patch transformer.

Forward passes are pure functions of a dictionary of arrays, scored in Arrow batches on the
executors.  Training runs on the driver over a bounded, documented sample of training rows, the way
a single-node trainer would: the same forward passes on ``autodiff.Var``, mean squared error, AdamW
with a clipped gradient, dropout, and the epoch with the best validation rank IC.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators.autodiff import Var, gelu, later, raw, softmax, unit

Weights = dict[str, np.ndarray]
#: A dropout: what it gets with some values set to zero and the rest scaled up; nothing when scoring.
Drop = Callable
#: Training rows taken to the driver, at most (by hash of the key), and windows for the sequence models.
TRAINING_ROWS, TRAINING_WINDOWS = 200_000, 20_000


def keep_all(x):
    return x


def layer_norm(x, gain, bias):
    return unit(x) * gain + bias


def linear_init(rng: np.random.Generator, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return rng.uniform(-1, 1, (a, b)) / math.sqrt(a), rng.uniform(-1, 1, b) / math.sqrt(a)


# Feature MLP: normalised input, hidden layers with GELU and dropout, one output


def mlp_init(width: int, hidden: tuple[int, ...] = (128, 64), seed: int = 0) -> Weights:
    rng, sizes = np.random.default_rng(seed), [width, *hidden, 1]
    w: Weights = {"gain": np.ones(width), "bias": np.zeros(width)}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        w[f"w{i}"], w[f"b{i}"] = linear_init(rng, a, b)
    return w


def mlp_forward(w: Weights, x, drop: Drop = keep_all):
    h, depth = layer_norm(x, w["gain"], w["bias"]), sum(k[0] == "w" for k in w)
    for i in range(depth):
        h = h @ w[f"w{i}"] + w[f"b{i}"]
        if i < depth - 1:
            h = drop(gelu(h))
    return h[..., 0]


# Causal convolution network: 1x1 projection, blocks of kernel 2 with dilations 1, 2, 4, ... over (batch, time, channel)


def causal_conv(x, w, b, dilation: int):
    """Output at t from x[t - dilation * (k - 1 - j)]; before the start there is nothing."""
    k, out = raw(w).shape[0], b
    for j in range(k):
        out = later(x, dilation * (k - 1 - j)) @ w[j] + out
    return out


def tcn_init(width: int, channels: int = 32, blocks: int = 7, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {"gain": np.ones(channels), "shift": np.zeros(channels)}
    w["in"], w["in_b"] = linear_init(rng, width, channels)
    w["head"], w["head_b"] = linear_init(rng, channels, 1)
    for i in range(blocks):
        w[f"c{i}"], w[f"d{i}"] = rng.uniform(-1, 1, (2, channels, channels)) / math.sqrt(2 * channels), np.zeros(channels)
        w[f"n{i}"], w[f"m{i}"] = np.ones(channels), np.zeros(channels)
    return w


def tcn_forward(w: Weights, x, drop: Drop = keep_all):
    """Score at the last time; the receptive field is 2 ** blocks."""
    h = x @ w["in"] + w["in_b"]
    for i in range(sum(k[0] == "c" for k in w)):
        out = layer_norm(causal_conv(h, w[f"c{i}"], w[f"d{i}"], 2**i), w[f"n{i}"], w[f"m{i}"])
        h = gelu(drop(gelu(out)) + h)
    return (layer_norm(h[:, -1], w["gain"], w["shift"]) @ w["head"] + w["head_b"])[:, 0]


# Patch transformer: patches of bars as tokens, pre-norm blocks with a causal mask


def transformer_init(width: int, patch: int = 4, patches: int = 32, dim: int = 64, layers: int = 2, seed: int = 0, inner: int = 128) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {"place": rng.normal(0, 0.02, (patches, dim)), "gain": np.ones(dim), "shift": np.zeros(dim), "head": rng.normal(0, 0.01, (dim, 1)), "head_b": np.zeros(1)}
    w["embed"], w["embed_b"] = linear_init(rng, width * patch, dim)
    for i in range(layers):
        for name, a, b in (("qkv", dim, 3 * dim), ("out", dim, dim), ("up", dim, inner), ("down", inner, dim)):
            w[f"{name}{i}"], w[f"{name}_b{i}"] = linear_init(rng, a, b)
        w |= {f"ga{i}": np.ones(dim), f"ba{i}": np.zeros(dim), f"gf{i}": np.ones(dim), f"bf{i}": np.zeros(dim)}
    return w


def attention(x, qkv, qkv_b, out, out_b, heads: int, drop: Drop = keep_all):
    b, t, d = x.shape
    mixed = x @ qkv + qkv_b
    q, k, v = (mixed[..., i * d : (i + 1) * d].reshape(b, t, heads, d // heads).transpose(0, 2, 1, 3) for i in range(3))
    score = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads) + np.where(np.tril(np.ones((t, t), bool)), 0.0, -1e30)
    return (drop(softmax(score)) @ v).transpose(0, 2, 1, 3).reshape(b, t, d) @ out + out_b


def transformer_tokens(w: Weights, x, heads: int = 4, drop: Drop = keep_all):
    """Token states of windows (batch, patches * patch, width); each depends on itself and earlier ones only."""
    patches = raw(w["place"]).shape[0]
    h = x.reshape(x.shape[0], patches, -1) @ w["embed"] + w["embed_b"] + w["place"]
    for i in range(sum(k.startswith("ga") and k != "gain" for k in w)):
        own = attention(layer_norm(h, w[f"ga{i}"], w[f"ba{i}"]), w[f"qkv{i}"], w[f"qkv_b{i}"], w[f"out{i}"], w[f"out_b{i}"], heads, drop)
        h = h + drop(own)
        inner = drop(gelu(layer_norm(h, w[f"gf{i}"], w[f"bf{i}"]) @ w[f"up{i}"] + w[f"up_b{i}"]))
        h = h + drop(inner @ w[f"down{i}"] + w[f"down_b{i}"])
    return h


def transformer_forward(w: Weights, x, drop: Drop = keep_all):
    return (layer_norm(transformer_tokens(w, x, drop=drop)[:, -1], w["gain"], w["shift"]) @ w["head"] + w["head_b"])[:, 0]


FORWARD = {"mlp": mlp_forward, "tcn": tcn_forward, "transformer": transformer_forward}


# Training


def gradient(kind: str, w: Weights, x: np.ndarray, y: np.ndarray, drop: Drop = keep_all) -> tuple[float, Weights]:
    """Mean squared error and its gradient in the weights."""
    v = {k: Var(a) for k, a in w.items()}
    error = FORWARD[kind](v, x, drop) - y
    loss = (error * error).mean()
    loss.backward()
    return float(loss.data), {k: np.zeros_like(a.data) if a.grad is None else a.grad for k, a in v.items()}


def dropout(rate: float, rng: np.random.Generator) -> Drop:
    if not 0.0 <= rate < 1.0:
        raise ValueError("dropout must lie in [0, 1)")
    return (lambda x: x * ((rng.random(x.shape) >= rate) / (1.0 - rate))) if rate else keep_all


class AdamW:
    """Adam with decoupled weight decay and a clipped gradient norm."""

    def __init__(self, w: Weights, rate: float = 1e-3, decay: float = 1e-4, clip: float = 1.0):
        self.rate, self.decay, self.clip, self.t = rate, decay, clip, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, w: Weights, g: Weights) -> None:
        self.t += 1
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, self.clip / (norm + 1e-6))
        for k, x in g.items():
            x = x * shrink
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            w[k] *= 1.0 - self.rate * self.decay
            w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def minibatches(n: int, size: int, rng: np.random.Generator, shuffle: bool = True) -> Iterator[np.ndarray]:
    """Index batches that cover every row once."""
    order = rng.permutation(n) if shuffle else np.arange(n)
    for at in range(0, n, size):
        yield order[at : at + size]


def mean_row_ic(prediction: np.ndarray, target: np.ndarray, group: np.ndarray) -> float:
    """Mean rank correlation over groups, undefined ones left out."""
    df = pd.DataFrame({"p": prediction, "t": target, "g": group})
    ranks = df.groupby("g")[["p", "t"]].rank()
    c = ranks - ranks.groupby(df["g"]).transform("mean")
    s = pd.DataFrame({"xy": c.p * c.t, "xx": c.p**2, "yy": c.t**2}).groupby(df["g"]).sum()
    ic = (s.xy / np.sqrt(s.xx * s.yy).where(s.xx * s.yy > 0)).dropna()
    return float(ic.mean()) if len(ic) else float("nan")


def train(
    kind: str, start: Weights, fit: tuple[np.ndarray, np.ndarray], validation: tuple[np.ndarray, np.ndarray, np.ndarray],
    epochs: int = 8, patience: int = 2, batch: int = 4096, rate: float = 1e-3, drop_rate: float = 0.1, seed: int = 0, decay: float = 1e-4, clip: float = 1.0,
) -> tuple[Weights, list[dict[str, float]]]:
    """Weights of the epoch with the best validation rank IC (by over 1e-6), and the history.

    ``fit`` is features (or windows) and targets, ``validation`` also the group of each row.  Stops after
    ``patience`` epochs without improvement; without any the starting weights come back.
    """
    (x, y), (xv, yv, gv) = fit, validation
    w, rng = {k: v.copy() for k, v in start.items()}, np.random.default_rng(seed)
    drop, adam = dropout(drop_rate, rng), AdamW(w, rate, decay, clip)
    best, kept, wait, history = -math.inf, start, 0, []
    for epoch in range(epochs):
        losses = []
        for rows in minibatches(len(x), batch, rng):
            loss, g = gradient(kind, w, x[rows], y[rows], drop)
            adam.step(w, g)
            losses.append(loss)
        p = np.concatenate([FORWARD[kind](w, xv[at : at + 8192]) for at in range(0, len(xv), 8192)]) if len(xv) else np.zeros(0)
        ic = mean_row_ic(p, yv, gv)
        history.append({"epoch": epoch, "train_loss": float(np.mean(losses)) if losses else math.nan, "validation_loss": float(((p - yv) ** 2).mean()) if len(p) else math.nan, "validation_mean_rank_ic": ic})
        if ic > best + 1e-6:
            best, kept, wait = ic, {k: v.copy() for k, v in w.items()}, 0
        else:
            wait += 1
            if wait >= patience:
                break
    return kept, history


def score(df: DataFrame, kind: str, weights: Weights, features: list[str] | str, keep: list[str]) -> DataFrame:
    """``keep`` and ``prediction``: feature columns for the MLP, a window column (rows of features) for the others."""
    forward = FORWARD[kind]
    columns = features if isinstance(features, list) else [features]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("prediction", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = pdf[columns].to_numpy("float64") if kind == "mlp" else np.stack([np.stack(w) for w in pdf[columns[0]]]).astype("float64")
            yield pdf[keep].assign(prediction=np.concatenate([forward(weights, x[at : at + 4096]) for at in range(0, len(x), 4096)]))

    return df.select(*keep, *[c for c in columns if c not in keep]).mapInPandas(run, schema)


def driver_sample(df: DataFrame, features: list[str] | str, key: list[str], target: str = "target", rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``rows`` rows, by hash of ``key``, as features (or windows), target and timestamp group."""
    columns = features if isinstance(features, list) else [features]
    chosen = df.orderBy(F.xxhash64(*key), *key).limit(rows).select(*dict.fromkeys([*columns, target, "timestamp"])).toPandas()
    y, g = chosen[target].to_numpy("float64"), chosen["timestamp"].to_numpy()
    if isinstance(features, list):
        return chosen[columns].to_numpy("float64"), y, g
    return (np.stack([np.stack(w) for w in chosen[features]]).astype("float64") if len(chosen) else np.zeros((0, 1, 1))), y, g
