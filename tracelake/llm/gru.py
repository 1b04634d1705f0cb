"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A window is a run of input vectors with a mask; both directions' states are pooled by attention
and give the logit of label 1.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x):
    return np.tanh(x * 0.5) * 0.5 + 0.5


def fresh(inputs: int, hidden: int, attention: int, seed: int = 7, dtype=F32) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}W"] = r.normal(0, 0.3, (inputs, 3 * hidden))
        p[f"{d}U"] = r.normal(0, 0.3, (hidden, 3 * hidden))
        p[f"{d}b"] = np.zeros(3 * hidden)
    p["aW"], p["av"] = r.normal(0, 0.3, (2 * hidden, attention)), r.normal(0, 0.3, attention)
    p["o"], p["c"] = r.normal(0, 0.3, 2 * hidden), np.zeros(1)
    return {k: v.astype(dtype) for k, v in p.items()}


def states(p, d: str, proj: np.ndarray, mask: np.ndarray, cache: list | None = None) -> np.ndarray:
    """States (step, window, hidden) of direction d from projected inputs (step, window, 3 * hidden)."""
    steps, n, h3 = proj.shape
    k = h3 // 3
    h, U = np.zeros((n, k), proj.dtype), p[f"{d}U"]
    out = np.empty((steps, n, k), proj.dtype)
    full = mask.all(1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g, u = proj[t], h @ U
        rz = sigmoid(g[:, : 2 * k] + u[:, : 2 * k])
        r, z = rz[:, :k], rz[:, k:]
        new = np.tanh(g[:, 2 * k :] + r * u[:, 2 * k :])
        if cache is not None:
            cache.append((t, h, r, z, new, u[:, 2 * k :]))
        now = new + z * (h - new)
        h = now if full[t] else np.where(mask[t][:, None], now, h)
        out[t] = h
    return out


def pooled(p, H: np.ndarray, mask: np.ndarray):
    a = np.tanh(H @ p["aW"])
    e = np.where(mask, a @ p["av"], -1e9)
    w = np.exp(e - e.max(0))
    w = w * mask
    w /= np.maximum(w.sum(0), 1e-9)
    return a, w, np.einsum("tn,tnk->nk", w, H)


def logits(p, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """x: (step, window, input)."""
    return logits_of(p, x @ p["fW"] + p["fb"], x @ p["bW"] + p["bb"], mask)


def logits_of(p, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
    H = np.concatenate([states(p, "f", forward, mask), states(p, "b", backward, mask)], 2)
    return pooled(p, H, mask)[2] @ p["o"] + p["c"]


def gradients(p, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted cross entropy and its gradients."""
    caches: dict[str, list] = {"f": [], "b": []}
    H = np.concatenate([states(p, d, x @ p[f"{d}W"] + p[f"{d}b"], mask, caches[d]) for d in "fb"], 2)
    a, w, pool = pooled(p, H, mask)
    s = pool @ p["o"] + p["c"]
    prob = sigmoid(s)
    loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum())
    ds = weight * (prob - y)
    g = {"o": pool.T @ ds, "c": ds.sum(keepdims=True)}
    dpool = ds[:, None] * p["o"]
    dH = w[:, :, None] * dpool
    dw = np.einsum("nk,tnk->tn", dpool, H)
    de = w * (dw - (w * dw).sum(0))
    da = de[:, :, None] * p["av"] * (1 - a * a)
    g["av"] = np.einsum("tn,tna->a", de, a)
    g["aW"] = np.einsum("tnk,tna->ka", H, da)
    dH = dH + da @ p["aW"].T
    k = H.shape[2] // 2
    for i, d in enumerate("fb"):
        gW, gU, gb = (np.zeros_like(p[f"{d}{c}"]) for c in "WUb")
        dh = np.zeros_like(dH[0, :, :k])
        for t, h, r, z, new, u in reversed(caches[d]):
            dh = dh + dH[t, :, i * k : (i + 1) * k]
            m = mask[t][:, None]
            on = dh * m
            dn = on * (1 - z) * (1 - new * new)
            dr, dz = dn * u * r * (1 - r), on * (h - new) * z * (1 - z)
            dg, du = np.concatenate([dr, dz, dn], 1), np.concatenate([dr, dz, dn * r], 1)
            gW += x[t].T @ dg
            gb += dg.sum(0)
            gU += h.T @ du
            dh = on * z + dh * ~m + du @ p[f"{d}U"].T
        g |= {f"{d}W": gW, f"{d}U": gU, f"{d}b": gb}
    return loss, g


class Adam:
    def __init__(self, p, rate: float = 0.01):
        self.rate, self.n = rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, p, g) -> None:
        self.n += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] ** 2 - self.v[k])
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(p[k].dtype)
