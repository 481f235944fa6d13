"""Bidirectional gated recurrent network in numpy: batched over sequences, trained by backpropagation through time.

A direction's step: z, r = sigmoid(x_z + h W_z), sigmoid(x_r + h W_r); n = tanh(x_n + r * (h W_n)); h' = (1 - z) n + z h.
Inputs come projected: x is (steps, batch, 3 * hidden) in the order z, r, n. Masked steps leave the state as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(x_at: Callable[[int], np.ndarray], order: Iterable[int], batch: int, mask: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """States (steps, hidden, batch), for scoring: features come first, so that every gate is one run of memory.

    x_at(t): the projected input of step t, (3 * hidden, batch), a new array; order: the steps, either way; mask:
    (steps, batch), True where the step counts, or None if all do."""
    hidden, wt = w.shape[0], np.ascontiguousarray(w.T)
    order = list(order)
    h = np.zeros((hidden, batch), np.float32)
    out, g = np.empty((len(order), hidden, batch), np.float32), np.empty((3 * hidden, batch), np.float32)
    for t in order:
        x = x_at(t)
        np.matmul(wt, h, out=g)
        zr, n = x[: 2 * hidden], g[2 * hidden :]
        zr += g[: 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1.0
        zr *= 0.5
        n *= zr[hidden:]
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        z = zr[:hidden]
        if mask is not None:
            z[:, ~mask[t]] = 1.0
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return out


def gru_with_cache(x: np.ndarray, mask: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    steps, batch, three = x.shape
    hidden = three // 3
    h = np.zeros((batch, hidden), np.float32)
    out, cache = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps):
        g = h @ w
        z = sigmoid(x[t, :, :hidden] + g[:, :hidden])
        r = sigmoid(x[t, :, hidden : 2 * hidden] + g[:, hidden : 2 * hidden])
        gn = g[:, 2 * hidden :]
        n = np.tanh(x[t, :, 2 * hidden :] + r * gn)
        m = mask[t][:, None]
        new = m * (n + z * (h - n)) + (1 - m) * h
        cache.append((h, z, r, gn, n, m))
        h = out[t] = new
    return out, cache


def gru_gradients(d_out: np.ndarray, cache: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of w, given those of all states."""
    steps, batch, hidden = d_out.shape
    dx, dw = np.zeros((steps, batch, 3 * hidden), np.float32), np.zeros_like(w)
    dh = np.zeros((batch, hidden), np.float32)
    for t in reversed(range(steps)):
        h, z, r, gn, n, m = cache[t]
        dh = dh + d_out[t]
        own = dh * m
        dn = own * (1 - z) * (1 - n * n)
        dz = own * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t, :, :hidden], dx[t, :, hidden : 2 * hidden], dx[t, :, 2 * hidden :] = dz, dr, dn
        dg = np.concatenate([dz, dr, dn * r], 1)
        dw += h.T @ dg
        dh = dh * (1 - m) + own * z + dg @ w.T
    return dx, dw


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def recurrent_weights(rng: np.random.Generator, hidden: int) -> np.ndarray:
    return np.concatenate([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)], 1).astype(np.float32)
