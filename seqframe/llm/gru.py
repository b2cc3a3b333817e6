"""A bidirectional gated recurrent network over bytes, in numpy.

Input is an array of bytes of shape (steps, windows); every step of every window gets
a distribution over the classes. States start at zero at either end of a window.
Arrays are kept with the units first, so that all element-wise work runs over long rows.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGRU:
    """Parameters, by direction d in 0 (forward) and 1: in{d} (256, 3 units) input to the
    gates z, r and the candidate; re{d} (3 units, units); bias of the recurrent candidate
    cb{d}; out (classes, 2 units), ob (classes)."""

    def __init__(self, units: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.units, self.classes = units, classes
        self.p: dict[str, np.ndarray] = {}
        for d in (0, 1):
            self.p[f"in{d}"] = rng.normal(0, 0.3, (256, 3 * units)).astype(np.float32)
            self.p[f"re{d}"] = rng.normal(0, 1 / np.sqrt(units), (3 * units, units)).astype(np.float32)
            self.p[f"cb{d}"] = np.zeros((units, 1), np.float32)
        self.p["out"] = rng.normal(0, 1 / np.sqrt(2 * units), (classes, 2 * units)).astype(np.float32)
        self.p["ob"] = np.zeros((classes, 1), np.float32)

    def _states(self, x: np.ndarray, d: int, tape: list | None = None) -> np.ndarray:
        """(steps, units, windows): the state after each step, in the order of the text."""
        u, p = self.units, self.p
        table, re, cb = p[f"in{d}"], p[f"re{d}"], p[f"cb{d}"]
        steps, n = x.shape
        h = np.zeros((u, n), np.float32)
        out = np.empty((steps, u, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = table[x[t]].T
            g = re @ h
            zr = _sigmoid(a[: 2 * u] + g[: 2 * u])
            z, r = zr[:u], zr[u:]
            gc = g[2 * u :] + cb
            c = np.tanh(a[2 * u :] + r * gc)
            if tape is not None:
                tape.append((t, h, z, r, gc, c))
            h = c + z * (h - c)
            out[t] = h
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """(steps, classes, windows): probabilities at each position."""
        out, ob = self.p["out"], self.p["ob"]
        logits = out[:, : self.units] @ self._states(x, 0)
        logits += out[:, self.units :] @ self._states(x, 1)
        logits += ob
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, by backpropagation
        through time. y: class of each window; weight (steps, windows): 0 for padding."""
        u, p = self.units, self.p
        steps, n = x.shape
        tapes: list[list] = [[], []]
        states = [self._states(x, d, tapes[d]) for d in (0, 1)]
        both = np.concatenate(states, axis=1)
        logits = p["out"] @ both + p["ob"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        total = max(1.0, float(weight.sum()))
        windows = np.arange(n)
        loss = float(-(np.log(prob[:, y, windows] + 1e-9) * weight).sum() / total)
        prob[:, y, windows] -= 1
        prob *= (weight / total)[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["out"] = np.einsum("tcn,tun->cu", prob, both, optimize=True)
        grad["ob"] = prob.sum(axis=(0, 2))[:, None]
        for d in (0, 1):
            above = np.einsum("cu,tcn->tun", p["out"][:, d * u : (d + 1) * u], prob, optimize=True)
            re = p[f"re{d}"]
            dh = np.zeros((u, n), np.float32)
            for t, h, z, r, gc, c in reversed(tapes[d]):
                dh = dh + above[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dgc = dc * r
                da = np.concatenate([dz, dr, dc])
                dg = np.concatenate([dz, dr, dgc])
                np.add.at(grad[f"in{d}"], x[t], da.T)
                grad[f"re{d}"] += dg @ h.T
                grad[f"cb{d}"] += dgc.sum(axis=1, keepdims=True)
                dh = dh * z + re.T @ dg
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam with a falling rate and clipped gradients; losses by epoch. x (windows, steps)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step, last = [], 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, seen = rng.permutation(len(x)), []
            for k in range(0, len(x), batch):
                w = order[k : k + batch]
                loss, grad = self.gradients(np.ascontiguousarray(x[w].T), y[w], np.ascontiguousarray(weight[w].T))
                norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
                step += 1
                now = rate * (1 - 0.9 * step / last)
                for name, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    fixed = (1 - 0.9**step), (1 - 0.99**step)
                    self.p[name] -= (now * (m[name] / fixed[0]) / (np.sqrt(v[name] / fixed[1]) + 1e-8)).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses
