"""Reverse-mode differentiation of NumPy expressions, for training the networks.

A ``Var`` behaves like an array in the few operations that the networks use, so their forward passes are
written once: on arrays they score, on ``Var`` they also leave the way back to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Back = Callable[[np.ndarray], tuple]


def _fitted(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The gradient summed over the axes along which an operand of this shape was repeated."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


class Var:
    __array_priority__ = 100.0

    def __init__(self, data: np.ndarray, parents: tuple[Var, ...] = (), back: Back | None = None):
        self.data, self.parents, self.back = np.asarray(data), parents, back
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    def __add__(self, other):
        o = lift(other)
        return Var(self.data + o.data, (self, o), lambda g: (_fitted(g, self.shape), _fitted(g, o.shape)))

    __radd__ = __add__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + (-lift(other))

    def __rsub__(self, other):
        return lift(other) + (-self)

    def __mul__(self, other):
        o = lift(other)
        return Var(self.data * o.data, (self, o), lambda g: (_fitted(g * o.data, self.shape), _fitted(g * self.data, o.shape)))

    __rmul__ = __mul__

    def __truediv__(self, number: float):
        return self * (1.0 / number)

    def __matmul__(self, other):
        o = lift(other)
        turn = lambda x: x.swapaxes(-1, -2)
        return Var(self.data @ o.data, (self, o), lambda g: (_fitted(g @ turn(o.data), self.shape), _fitted(turn(self.data) @ g, o.shape)))

    def __rmatmul__(self, other):
        return lift(other) @ self

    def __getitem__(self, at):
        def back(g: np.ndarray) -> tuple:
            out = np.zeros_like(self.data)
            out[at] = g  # slices and single places only: none is taken twice
            return (out,)

        return Var(self.data[at], (self,), back)

    def reshape(self, *shape: int):
        return Var(self.data.reshape(*shape), (self,), lambda g: (g.reshape(self.shape),))

    def transpose(self, *axes: int):
        return Var(self.data.transpose(*axes), (self,), lambda g: (g.transpose(*np.argsort(axes)),))

    def mean(self):
        n = self.data.size
        return Var(self.data.mean(), (self,), lambda g: (np.full(self.shape, g / n),))

    def backward(self) -> None:
        """Gradients of this number in everything it came from."""
        order: list[Var] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is not None:
                for p, g in zip(v.parents, v.back(v.grad)):
                    p.grad = g if p.grad is None else p.grad + g


def lift(x) -> Var:
    return x if isinstance(x, Var) else Var(np.asarray(x, "float64"))


def _through(x, value: np.ndarray, back: Back):
    """``value`` computed from ``x``: an array for an array, a ``Var`` for a ``Var``."""
    return Var(value, (x,), back) if isinstance(x, Var) else value


def raw(x) -> np.ndarray:
    return x.data if isinstance(x, Var) else x


def gelu(x):
    """Gaussian error linear unit, tanh form."""
    a, c = raw(x), math.sqrt(2.0 / math.pi)
    t = np.tanh(c * (a + 0.044715 * a**3))
    return _through(x, 0.5 * a * (1.0 + t), lambda g: (g * (0.5 * (1.0 + t) + 0.5 * a * (1.0 - t * t) * c * (1.0 + 3 * 0.044715 * a * a)),))


def unit(x, eps: float = 1e-5):
    """The last axis with mean 0 and deviation 1."""
    a = raw(x)
    s = 1.0 / np.sqrt(a.var(-1, keepdims=True) + eps)
    y = (a - a.mean(-1, keepdims=True)) * s
    return _through(x, y, lambda g: (s * (g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True)),))


def softmax(x):
    a = raw(x)
    e = np.exp(a - a.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return _through(x, p, lambda g: (p * (g - (g * p).sum(-1, keepdims=True)),))


def later(x, steps: int):
    """(batch, time, ...) moved ``steps`` later in time; before the start there is nothing."""
    if not steps:
        return x
    a, n = raw(x), raw(x).shape[1]
    k = min(steps, n)
    shifted = np.concatenate([np.zeros_like(a[:, :k]), a[:, : n - k]], axis=1)
    return _through(x, shifted, lambda g: (np.concatenate([g[:, k:], np.zeros_like(g[:, :k])], axis=1),))
