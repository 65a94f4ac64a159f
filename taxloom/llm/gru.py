"""A gated recurrent language model in numpy, with a class-factored softmax.

Token 0 ends a text, token 1 stands for words outside the vocabulary. Words of
similar frequency form a class, of few words where they are frequent; a
token's probability is that of its class times that of the token in its class,
so a step costs two softmaxes over the square root of the vocabulary. Training is truncated backpropagation over
parallel streams of texts; scoring carries the state of every text across
windows to its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END, UNK = 0, 1
F32 = np.float32


@dataclass
class Gru:
    """x: V x 3H inputs; u: H x 3H recurrence; b: 3H; class and word outputs with biases."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    ww: np.ndarray
    bw: np.ndarray
    #: Tokens start[c]:start[c + 1] are class c.
    start: np.ndarray

    @property
    def hidden(self) -> int:
        return self.u.shape[0]

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.wc, self.bc, self.ww, self.bw]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _exps(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(a), in a's place, and each row's sum; rows of up to some thousand logits below 70 cannot overflow."""
    np.minimum(a, F32(70), out=a)
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], a.dtype)


def new(counts: np.ndarray, hidden: int, seed: int = 7) -> Gru:
    """An untrained model that gives every token its share of `counts` (the corpus counts by token)."""
    rng = np.random.default_rng(seed)
    v = len(counts)
    # Classes grow with rarity: what is frequent shares its class with few.
    edges = np.cumsum(np.arange(1, v + 2) * 2 - 1)
    start = np.append(np.concatenate([[0], edges[edges < v]]), v)
    share = (counts + 0.5) / (counts + 0.5).sum()
    mass = np.add.reduceat(share, start[:-1])
    draw = lambda *shape, s: (rng.normal(size=shape) * s).astype(F32)
    return Gru(draw(v, 3 * hidden, s=0.3), draw(hidden, 3 * hidden, s=hidden**-0.5), np.zeros(3 * hidden, F32), draw(hidden, len(mass), s=0.1), np.log(mass).astype(F32), draw(v, hidden, s=0.1), np.log(share).astype(F32), start)


def _step(m: Gru, token: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    k = m.hidden
    a = m.x[token] + m.b
    g = h @ m.u
    gates = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), z, r, n, g[:, 2 * k :]


def _by_class(m: Gru, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of targets by their classes, and (class, from, to) in that order for every class that occurs."""
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(len(m.start)))
    return order, [(c, int(cuts[c]), int(cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist()]


def log_probs(m: Gru, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after state h."""
    cls = m.class_of[target]
    order, runs = _by_class(m, cls)
    h, target, cls = h[order], target[order], cls[order]
    rows = np.arange(len(target))
    e, total = _exps(h @ m.wc + m.bc)
    p = e[rows, cls] / total
    for c, i, j in runs:
        lo, hi = m.start[c], m.start[c + 1]
        e, total = _exps(h[i:j] @ m.ww[lo:hi].T + m.bw[lo:hi])
        p[i:j] *= e[rows[: j - i], target[i:j] - lo] / total
    out = np.empty(len(target))
    out[order] = np.log(np.maximum(p, np.finfo(p.dtype).tiny))
    return out


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by their number `at`, n in all."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own[starts]] = np.add.reduceat(rows[order], starts)
    return out


def _window(m: Gru, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Loss, gradients and last state over a window of shape (steps, streams).

    The state is emptied where `fresh` says so, and at every text's start.
    """
    k, kept, states = m.hidden, [], []
    goes_on = inputs != END if fresh is None else (inputs != END) & ~fresh
    for t in range(len(inputs)):
        h = h * goes_on[t][:, None]
        before = h
        h, z, r, n, gn = _step(m, inputs[t], h)
        kept.append((before, z, r, n, gn))
        states.append(h)
    flat = targets.ravel()
    gwc, gbc, gww, gbw = (np.zeros_like(p) for p in (m.wc, m.bc, m.ww, m.bw))
    cls = m.class_of[flat]
    order, runs = _by_class(m, cls)
    hs, flat, cls = np.concatenate(states)[order], flat[order], cls[order]
    rows = np.arange(len(flat))
    d, total = _exps(hs @ m.wc + m.bc)
    d /= total[:, None]
    loss = -np.log(d[rows, cls]).sum()
    d[rows, cls] -= 1
    gwc += hs.T @ d
    gbc += d.sum(axis=0)
    by_class = d @ m.wc.T
    for c, i, j in runs:
        lo, hi = m.start[c], m.start[c + 1]
        d, total = _exps(hs[i:j] @ m.ww[lo:hi].T + m.bw[lo:hi])
        d /= total[:, None]
        own = rows[: j - i], flat[i:j] - lo
        loss -= np.log(d[own]).sum()
        d[own] -= 1
        gww[lo:hi] += d.T @ hs[i:j]
        gbw[lo:hi] += d.sum(axis=0)
        by_class[i:j] += d @ m.ww[lo:hi]
    dh_out = np.empty_like(by_class)
    dh_out[order] = by_class
    dh_out = dh_out.reshape(len(inputs), -1, k)
    carry = np.zeros_like(h)
    das, dgs = [], []
    for t in reversed(range(len(inputs))):
        before, z, r, n, gn = kept[t]
        dh = dh_out[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        das.append(da)
        dgs.append(dg)
        carry = (dh * z + dg @ m.u.T) * goes_on[t][:, None]
    da = np.concatenate(das)
    gx = _summed(da, inputs[::-1].ravel(), len(m.x))
    gu = np.concatenate([kept[t][0] for t in reversed(range(len(inputs)))]).T @ np.concatenate(dgs)
    return float(loss), [gx, gu, da.sum(axis=0), gwc, gbc, gww, gbw], h


class Trainer:
    """Truncated backpropagation with Adam's step sizes; what it is fed teaches m at once."""

    #: Most streams side by side, steps of a window, and windows that a feed should have at least.
    STREAMS, WINDOW, LEAST = 512, 16, 64

    def __init__(self, m: Gru, rate: float = 0.01):
        self.m, self.rate, self.step = m, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in m.params()]

    def feed(self, parts: list[np.ndarray], before: list[int]) -> float:
        """One pass over parts of texts, each behind a token of its own; returns the loss per token.

        Laid end to end, in an order drawn at random, they are cut into streams
        of equal length; the last stream overlaps the one before it where
        lengths would differ.
        """
        window = self.WINDOW
        order = np.random.default_rng(3).permutation(len(parts))
        tokens = np.concatenate([parts[i] for i in order])
        heads = np.cumsum([0, *(len(parts[i]) for i in order[:-1])])
        follows = np.append(END, tokens[:-1])
        follows[heads] = [before[i] for i in order]
        anew = np.zeros(len(tokens), dtype=bool)
        anew[heads] = True
        b = int(np.clip(len(tokens) // (window * self.LEAST), 1, self.STREAMS))
        length = -(-len(tokens) // b)
        starts = np.minimum(np.arange(b) * length, len(tokens) - length)
        at = starts[None, :] + np.arange(length)[:, None]
        target, source, fresh = tokens[at], follows[at], anew[at]
        h, total = np.zeros((b, self.m.hidden), F32), 0.0
        for lo in range(0, length, window):
            loss, grads, h = _window(self.m, source[lo : lo + window], target[lo : lo + window], h, fresh[lo : lo + window])
            total += loss
            self.step += 1
            n = target[lo : lo + window].size
            up1, up2 = 1 - 0.9**self.step, 1 - 0.99**self.step
            for p, g, (m1, m2) in zip(self.m.params(), grads, self.moments, strict=True):
                g = np.clip(g * F32(window / n), -1, 1)
                m1 += F32(0.1) * (g - m1)
                m2 += F32(0.01) * (g * g - m2)
                p -= F32(self.rate / up1) * m1 / (np.sqrt(m2 * F32(1 / up2)) + F32(1e-6))
        return total / (b * length)


def score(m: Gru, tokens: np.ndarray, first: np.ndarray, window: int = 32) -> np.ndarray:
    """Natural log probability of every whole text; text d is tokens[first[d]:first[d + 1]] and ends with END.

    Texts advance in lockstep, the longest first; states pass from window to window.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    out = np.zeros(len(n))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")
    h = np.zeros((len(n), m.hidden), F32)
    for lo in range(0, longest, window):
        states, targets, owners = [], [], []
        for k in range(lo, min(lo + window, longest)):
            a = active[k]
            i = at[:a] + k
            before = tokens[i - 1] if k else np.full(a, END)
            h = _step(m, before, h[:a])[0]
            states.append(h)
            targets.append(tokens[i])
            owners.append(np.arange(a))
        lp = log_probs(m, np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), weights=lp, minlength=len(n))
    result = np.empty(len(n))
    result[order] = out
    return result
