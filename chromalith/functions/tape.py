"""Reverse-mode differentiation over numpy arrays, as much as the graph model needs."""

from __future__ import annotations

import numpy as np


class Var:
    """A value with the rule that hands its gradient to its inputs."""

    def __init__(self, value, inputs=(), back=None):
        self.value, self.inputs, self.back, self.grad = np.asarray(value, float), inputs, back, None

    def __matmul__(self, o: Var) -> Var:
        return Var(self.value @ o.value, (self, o), lambda g: (g @ o.value.T, self.value.T @ g))

    def __add__(self, o) -> Var:
        if not isinstance(o, Var):
            return Var(self.value + o, (self,), lambda g: (_fit(g, self.value.shape),))
        return Var(self.value + o.value, (self, o), lambda g: (_fit(g, self.value.shape), _fit(g, o.value.shape)))

    def __mul__(self, o) -> Var:
        if not isinstance(o, Var):
            return Var(self.value * o, (self,), lambda g: (_fit(g * o, self.value.shape),))
        return Var(self.value * o.value, (self, o), lambda g: (_fit(g * o.value, self.value.shape), _fit(g * self.value, o.value.shape)))

    def __neg__(self) -> Var:
        return self * -1.0

    def relu(self) -> Var:
        on = self.value > 0
        return Var(self.value * on, (self,), lambda g: (g * on,))

    def exp(self) -> Var:
        v = np.exp(self.value)
        return Var(v, (self,), lambda g: (g * v,))

    def power(self, p: float) -> Var:
        return Var(self.value**p, (self,), lambda g: (g * p * self.value ** (p - 1),))

    def softplus(self) -> Var:
        x = self.value
        return Var(np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))), (self,), lambda g: (g / (1 + np.exp(-np.clip(x, -60, 60))),))

    def sum(self, axis=None) -> Var:
        s = self.value.shape
        return Var(self.value.sum(axis), (self,), lambda g: (np.broadcast_to(g if axis is None else np.expand_dims(g, axis), s).copy(),))

    def mean(self) -> Var:
        return self.sum() * (1.0 / max(1, self.value.size))

    def rows(self, at: np.ndarray) -> Var:
        return Var(self.value[at], (self,), lambda g: (segment_sums(g, at, len(self.value)),))

    def segment_sum(self, to: np.ndarray, n: int) -> Var:
        return Var(segment_sums(self.value, to, n), (self,), lambda g: (g[to],))

    def spread(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Var:
        """Each row's sum of weight * the rows that edges bring to it. Where edges fill much of the square of rows, they are laid out as
        a matrix, which then is no larger than a few times the messages; else messages are summed by their end."""
        n, width = self.value.shape
        if n * n <= 4 * width * len(src):
            a = np.bincount(dst * n + src, weight, n * n).reshape(n, n)
            return Var(a @ self.value, (self,), lambda g: (a.T @ g,))
        w = weight[:, None]
        return Var(segment_sums(self.value[src] * w, dst, n), (self,), lambda g: (segment_sums(g[dst] * w, src, n),))

    def cols(self, a: int, b: int) -> Var:
        def back(g):
            out = np.zeros_like(self.value)
            out[..., a:b] = g
            return (out,)

        return Var(self.value[..., a:b], (self,), back)


def beside(a: Var, b: Var) -> Var:
    n = a.value.shape[-1]
    return Var(np.concatenate((a.value, b.value), -1), (a, b), lambda g: (g[..., :n], g[..., n:]))


def segment_sums(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows that go to each; the order of rows holds within a sum."""
    out = np.zeros((n, *rows.shape[1:]))
    if len(to):
        by = np.argsort(to, kind="stable")
        ends = to[by]
        starts = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        out[ends[starts]] = np.add.reduceat(rows[by], starts, axis=0)
    return out


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


def gradients(loss: Var) -> None:
    """Sets .grad on everything that loss depends on."""
    order, seen, stack = [], set(), [(loss, False)]
    while stack:
        v, ready = stack.pop()
        if ready:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(i, False) for i in v.inputs]
    for v in order:
        v.grad = None
    loss.grad = np.ones_like(loss.value)
    for v in reversed(order):
        if v.back:
            for i, g in zip(v.inputs, v.back(v.grad), strict=True):
                i.grad = g if i.grad is None else i.grad + g
