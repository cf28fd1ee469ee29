"""A small causal self-attention model in numpy: forward, gradients, Adam, and windows over sequences.

One attention layer and one feed-forward layer with residuals; the output is a two-level softmax (class of
the target, then member of the class), so a prediction costs about two square roots of the vocabulary.
"""

from __future__ import annotations

import numpy as np


#: Logits are cut off here: its exponential is far from the largest number, so no maximum need be taken out.
TOP = np.float32(60)


def _exp(x: np.ndarray) -> np.ndarray:
    np.minimum(x, TOP, out=x)
    return np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept: a product with ones is faster than a reduction of short rows."""
    return x @ np.ones((x.shape[-1], 1), x.dtype)


class Model:
    """Inputs 0 … n_in-1, targets 0 … n_out-1, windows of ``width`` inputs."""

    def __init__(self, n_in: int, n_out: int, width: int, dim: int = 16, seed: int = 0):
        self.n_in, self.n_out, self.width, self.dim = n_in, n_out, width, dim
        self.side = int(np.ceil(np.sqrt(n_out)))
        n_class = -(-n_out // self.side)
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[-1] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {
            "embed": draw(n_in, dim), "place": draw(width, dim) * 0.5,
            "q": draw(dim, dim), "k": draw(dim, dim), "v": draw(dim, dim), "o": draw(dim, dim) * 0.5,
            "w1": draw(dim, 2 * dim), "b1": np.zeros(2 * dim, np.float32), "w2": draw(2 * dim, dim) * 0.3,
            "class": draw(n_class, dim) * 0.1, "class_b": np.zeros(n_class, np.float32),
            "member": draw(n_class, self.side, dim) * 0.1, "member_b": np.zeros((n_class, self.side), np.float32),
        }
        self.absent = np.zeros((n_class, self.side), np.float32)
        self.absent.ravel()[n_out:] = -1e9
        self.mask = np.triu(np.full((width, width), -1e9, np.float32), 1)

    def expect(self, times: np.ndarray) -> Model:
        """Start from the frequencies of the targets (one more for each), whatever the context."""
        t = np.zeros(self.absent.size)
        t[: self.n_out] = times + 1.0
        t = t.reshape(self.absent.shape)
        self.p["class_b"] = np.log(t.sum(axis=1)).astype(np.float32) - np.float32(np.log(t.sum()))
        self.p["member_b"] = np.log(np.maximum(t, 1e-3) / t.sum(axis=1, keepdims=True)).astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _hidden(self, x: np.ndarray):
        p, d = self.p, self.dim
        e = p["embed"][x] + p["place"][: x.shape[1]]
        q, k, v = e @ p["q"], e @ p["k"], e @ p["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(d**-0.5)
        s += self.mask[: x.shape[1], : x.shape[1]]
        a = _exp(s)
        total = _sums(a)
        o = (a @ v) / total
        y = e + o @ p["o"]
        f = np.maximum(y @ p["w1"] + p["b1"], 0)
        z = y + f @ p["w2"]
        return z, (e, q, k, v, a, total, o, y, f)

    def _classes(self, z: np.ndarray, target: np.ndarray):
        """Log-probability of each target for its hidden state; class softmax, and per class rows and member softmax."""
        p = self.p
        c, m = target // self.side, target % self.side
        u = z @ p["class"].T + p["class_b"]
        rows = np.arange(len(z))
        picked = np.minimum(u[rows, c], TOP)
        u = _exp(u)
        total = _sums(u)[:, 0]
        logp = picked - np.log(total)
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(len(p["class"]) + 1))
        groups = []
        for g in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[g] : cuts[g + 1]]
            w = z[mine] @ p["member"][g].T
            w += p["member_b"][g] + self.absent[g]
            hit = np.minimum(w[rows[: len(mine)], m[mine]], TOP)
            w = _exp(w)
            t = _sums(w)[:, 0]
            logp[mine] += hit - np.log(t)
            groups.append((g, mine, w, t))
        return logp, (c, m, u, total, groups)

    def score(self, x: np.ndarray, target: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of target[counted]."""
        z, _ = self._hidden(x)
        return self._classes(z[counted], target[counted])[0]

    def gradients(self, x: np.ndarray, target: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the counted targets, and its gradients."""
        p, d = self.p, self.dim
        z, (e, q, k, v, a, sums, o, y, f) = self._hidden(x)
        a = a / sums
        zs, ts = z[counted], target[counted]
        n = max(1, len(ts))
        logp, (c, m, u, total, groups) = self._classes(zs, ts)
        g = {k_: np.zeros_like(v_) for k_, v_ in p.items()}
        du = u / total[:, None]
        du[np.arange(len(zs)), c] -= 1
        du /= n
        dzs = du @ p["class"]
        g["class"], g["class_b"] = du.T @ zs, du.sum(axis=0)
        for gr, mine, w, t in groups:
            dw = w / t[:, None]
            dw[np.arange(len(mine)), m[mine]] -= 1
            dw /= n
            dzs[mine] += dw @ p["member"][gr]
            g["member"][gr], g["member_b"][gr] = dw.T @ zs[mine], dw.sum(axis=0)
        dz = np.zeros_like(z)
        dz[counted] = dzs
        two = lambda b: b.reshape(-1, b.shape[-1])
        df = (dz @ p["w2"].T) * (f > 0)
        g["w2"], g["w1"], g["b1"] = two(f).T @ two(dz), two(y).T @ two(df), two(df).sum(axis=0)
        dy = dz + df @ p["w1"].T
        do = dy @ p["o"].T
        g["o"] = two(o).T @ two(dy)
        da = do @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ do
        ds = a * (da - _sums(da * a)) * np.float32(d**-0.5)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        de = dy + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        for name, dx in (("q", dq), ("k", dk), ("v", dv)):
            g[name] = two(e).T @ two(dx)
        g["place"][: x.shape[1]] = de.sum(axis=0)
        order = np.argsort(x.ravel(), kind="stable")
        given = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], given[1:] != given[:-1]])) if len(given) else order
        if len(first):
            g["embed"][given[first]] = np.add.reduceat(two(de)[order], first, axis=0)
        return float(-logp.sum() / n), g


class Adam:
    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] = 0.9 * self.m[k] + np.float32(0.1) * x
            self.v[k] = 0.99 * self.v[k] + np.float32(0.01) * x * x
            self.model.p[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def windows(lengths: np.ndarray, width: int, stride: int):
    """Overlapping windows over sequences laid end to end: places (window, slot), and which slots count.

    A sequence's first window counts whole, later ones in their last ``stride`` slots, so each place counts
    once and has ``width - stride`` places before it at least, where the sequence has them.
    """
    lengths = np.asarray(lengths, np.int64)
    begin = np.cumsum(lengths) - lengths
    number = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - width) // stride)), 0)
    of = np.repeat(np.arange(len(lengths)), number)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    slots = np.arange(width)
    place = nth[:, None] * stride + slots
    counted = (place < lengths[of][:, None]) & ((nth == 0)[:, None] | (slots >= width - stride))
    return np.minimum(place, lengths[of][:, None] - 1) + begin[of][:, None], counted
