"""Bidirectional gated recurrent units in numpy: forward, backpropagation through time, and Adam.

Training arrays are (time, direction, batch, ...); direction 1 runs over the reversed sequence. Input projections come
ready, as the first layer of symbols is a table look-up. Activations are rational (x / (1 + |x|)), which vectorise
several times better than tanh. All float32.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * squash(x) + F32(0.5)


def squash_slope(s: np.ndarray) -> np.ndarray:
    """Derivative, from the value."""
    return np.square(1 - np.abs(s))


def sigmoid_slope(z: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.square(1 - np.abs(2 * z - 1))


def step(h: np.ndarray, x: np.ndarray, Ut: np.ndarray) -> np.ndarray:
    """One step in the layout (2, H, batch), contiguous along the batch; x (2, 3H, batch) is overwritten."""
    H = Ut.shape[2]
    g = np.matmul(Ut, h)
    zr = x[:, : 2 * H]
    zr += g[:, : 2 * H]
    d = np.abs(zr)
    d += F32(1)
    zr /= d
    zr *= F32(0.5)
    zr += F32(0.5)
    n = g[:, 2 * H :]
    n *= zr[:, H:]
    n += x[:, 2 * H :]
    d = np.abs(n)
    d += F32(1)
    n /= d
    new = h - n
    new *= zr[:, :H]
    new += n
    return new


def run(inputs, U: np.ndarray, batch: int, steps: int) -> np.ndarray:
    """States (steps, 2, H, batch); ``inputs(t)`` gives fresh projections (2, 3H, batch). Nothing else is kept."""
    H, Ut = U.shape[1], np.ascontiguousarray(U.transpose(0, 2, 1))
    out = np.empty((steps, 2, H, batch), F32)
    h = np.zeros((2, H, batch), F32)
    for t in range(steps):
        h = out[t] = step(h, inputs(t), Ut)
    return out


def forward(gx: np.ndarray, U: np.ndarray, mask: np.ndarray | None = None):
    """States (T, 2, B, H) and what the backward pass needs; where the mask is 0 the state is held."""
    T, S, B, _ = gx.shape
    H = U.shape[1]
    h, hs, cache = np.zeros((S, B, H), F32), np.empty((T, S, B, H), F32), []
    for t in range(T):
        g = np.matmul(h, U)
        z, r = sigmoid(gx[t, ..., :H] + g[..., :H]), sigmoid(gx[t, ..., H : 2 * H] + g[..., H : 2 * H])
        un = g[..., 2 * H :]
        n = squash(gx[t, ..., 2 * H :] + r * un)
        new = (1 - z) * n + z * h
        cache.append((h, z, r, n, un))
        h = new if mask is None else np.where(mask[t], new, h)
        hs[t] = h
    return hs, cache


def backward(dhs: np.ndarray, cache, U: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projections and of U from those of every state."""
    T, S, B, H = dhs.shape
    dgx, dU, dh = np.empty((T, S, B, 3 * H), F32), np.zeros_like(U), np.zeros((S, B, H), F32)
    for t in range(T - 1, -1, -1):
        h, z, r, n, un = cache[t]
        dh = dh + dhs[t]
        live = dh if mask is None else dh * mask[t]
        dn = live * (1 - z) * squash_slope(n)
        dz = live * (h - n) * sigmoid_slope(z)
        dr = dn * un * sigmoid_slope(r)
        dgx[t] = np.concatenate([dz, dr, dn], -1)
        dgh = np.concatenate([dz, dr, dn * r], -1)
        dU += np.matmul(h.transpose(0, 2, 1), dgh)
        dh = live * z + np.matmul(dgh, U.transpose(0, 2, 1)) + (0 if mask is None else dh * (1 - mask[t]))
    return dgx, dU


def scatter(symbols: np.ndarray, grads: np.ndarray, size: int) -> np.ndarray:
    """Sum of the gradient rows of each symbol."""
    flat, rows = symbols.ravel(), grads.reshape(-1, grads.shape[-1])
    order = np.argsort(flat, kind="stable")
    out = np.zeros((size, rows.shape[1]), F32)
    if len(flat):
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        out[flat[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = F32(min(1.0, clip / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.01) * (g * g - self.v[k])
            rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.params[k] -= F32(rate) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def init(rng: np.random.Generator, *shape: int, scale: float = 0.3) -> np.ndarray:
    return rng.normal(0, scale, shape).astype(F32)
