"""A small gated recurrent language model with a class-factored softmax, in numpy.

Words 0 to K-1 are grouped by frequency into C classes of W words. The probability of a word is that
of its class times that of the word within the class. Parameters start at the unigram model: only
the class and word biases are set, so training can only move away from it by what it learns.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _exps(logit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's logit at ``at`` less the log of its row's sum of exponentials, the exponentials (in place) and the sums."""
    if max(logit.max(), -logit.min()) > 60:  # so that exponentials neither overflow nor all vanish
        logit -= logit.max(axis=1, keepdims=True)
    picked = logit[np.arange(len(logit)), at]
    e = np.exp(logit, out=logit)
    total = e @ np.ones(e.shape[1], e.dtype)
    return picked - np.log(total), e, total


class Gru:
    def __init__(self, classes: int, width: int, hidden: int, counts: np.ndarray | None = None, seed: int = 1) -> None:
        """``counts``: training count of each of the ``classes * width`` words, most frequent first."""
        self.c, self.w, self.h = classes, width, hidden
        rng = np.random.default_rng(seed)
        k = classes * width
        near = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
        self.p = {
            "x": near(k + 1, 3 * hidden),  # what each previous word adds to the gates; row k starts a text
            "u": near(hidden, 3 * hidden),
            "cw": near(hidden, classes), "cb": np.zeros(classes, F32),
            "ww": near(classes, hidden, width), "wb": np.zeros((classes, width), F32),
        }
        if counts is not None:
            n = counts.astype(np.float64).reshape(classes, width) + 0.5
            self.p["cb"] = np.log(n.sum(axis=1) / n.sum()).astype(F32)
            self.p["wb"] = np.log(n / n.sum(axis=1, keepdims=True)).astype(F32)
            self.p["cw"] *= 0
            self.p["ww"] *= 0

    def to_array(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(F32)
            at += v.size
        return self

    def _forward(self, prev: np.ndarray, h: np.ndarray, first: np.ndarray | None = None, keep: bool = False):
        """States (steps, hidden, n) after each step from ``h`` (n, hidden); with ``keep``, what the way back needs.

        Streams run along the last axis, so that every gate of a step is one block of memory.
        """
        steps, n = prev.shape
        d, u = self.h, self.p["u"]
        x, u = self.p["x"].copy(), u.T.copy()
        x[:, :2 * d] *= -1  # the exponents of the two logistic gates
        u[:2 * d] *= -1
        there = None if first is None else (~first).astype(u.dtype)
        held = steps if keep else 1
        h0, c = (np.empty((held, d, n), u.dtype) for _ in range(2))
        zr, a = np.empty((held, 2 * d, n), u.dtype), np.empty((held, 3 * d, n), u.dtype)
        s = np.empty((steps, d, n), u.dtype)
        h = np.ascontiguousarray(h.T, dtype=u.dtype)
        for t in range(steps):
            k = t if keep else 0
            if there is not None:
                h = np.multiply(h, there[t], out=h0[k])
            gates = np.ascontiguousarray(x[prev[t]].T)
            np.matmul(u, h, out=a[k])
            q = np.add(a[k, :2 * d], gates[:2 * d], out=zr[k])
            np.exp(q, out=q)
            q += 1
            np.reciprocal(q, out=q)
            v = np.multiply(q[d:], a[k, 2 * d:], out=c[k])
            v += gates[2 * d:]
            np.tanh(v, out=v)
            step = np.subtract(v, h, out=s[t])
            step *= q[:d]
            step += h
            h = step
        return s, (h0, zr, c, a[:, 2 * d:])

    def states(self, prev: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states that predict each step. ``prev[t, b]`` is the word before step t."""
        s, _ = self._forward(prev, h)
        return np.ascontiguousarray(s.transpose(0, 2, 1)), s[-1].T if len(s) else h

    def loss(self, s: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target after state ``s``; with ``grads``, also d(-sum)/ds."""
        p = self.p
        order, live = self._by_class(target, self.c)
        cls, word = np.divmod(target[order], self.w)
        # Rows by class, with a one behind each state: biases are the last rows of the weights.
        one = np.empty((len(s), self.h + 1), s.dtype)
        one[:, :-1], one[:, -1] = s[order], 1
        classes = np.vstack([p["cw"], p["cb"]])
        words = np.concatenate([p["ww"], p["wb"][:, None]], axis=1)
        out = np.empty(len(s), s.dtype)
        if not live:
            return out, None if grads is None else np.zeros_like(s)
        c_logp, c_exp, c_total = _exps(one @ classes, cls)
        w_logit = np.empty((len(s), self.w), np.result_type(one, words))
        for c, at in live:
            np.matmul(one[at], words[c], out=w_logit[at])
        logp, w_exp, w_total = _exps(w_logit, word)
        out[order] = c_logp + logp
        if grads is None:
            return out, None
        rows = np.arange(len(s))
        for g, total, at in ((c_exp, c_total, cls), (w_exp, w_total, word)):
            g *= (1 / total)[:, None]
            g[rows, at] -= 1
        both = one.T @ c_exp
        grads["cw"] += both[:-1]
        grads["cb"] += both[-1]
        back = c_exp @ p["cw"].T
        inner = np.empty_like(back)
        for c, at in live:
            both = one[at].T @ w_exp[at]
            grads["ww"][c] += both[:-1]
            grads["wb"][c] += both[-1]
            np.matmul(w_exp[at], p["ww"][c].T, out=inner[at])
        back += inner
        ds = np.empty_like(back)
        ds[order] = back
        return out, ds

    def _by_class(self, words: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The order of the words by class, and each class's share of it."""
        cls = words // self.w
        order = np.argsort(cls.astype(np.uint16) if classes < 2**16 else cls, kind="stable")
        size = np.bincount(cls, minlength=classes)
        end = np.cumsum(size)
        return order, [(c, slice(end[c] - size[c], end[c])) for c in np.flatnonzero(size).tolist()]

    def _by_word(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of ``rows`` by word (the start's included): one small product per class."""
        out = np.zeros(((self.c + 1) * self.w, rows.shape[1]), rows.dtype)
        order, live = self._by_class(words, self.c + 1)
        rows, place = rows[order], words[order] % self.w
        hot = np.zeros((len(words), self.w), rows.dtype)
        hot[np.arange(len(words)), place] = 1
        for c, at in live:
            np.matmul(hot[at].T, rows[at], out=out[c * self.w:(c + 1) * self.w])
        return out[:self.c * self.w + 1]

    def gradients(self, prev: np.ndarray, target: np.ndarray, h: np.ndarray, first: np.ndarray):
        """Truncated backpropagation over one window. ``first[t, b]`` marks a text's first step: the
        state is cleared there. Returns (gradients, log probability sum, last state)."""
        steps, n = prev.shape
        d = self.h
        u = self.p["u"]
        s, (h0, zr, c, an) = self._forward(prev, h, first, keep=True)
        grads = {k: np.zeros_like(v) for k, v in self.p.items() if k != "x"}
        logp, ds = self.loss(s.transpose(0, 2, 1).reshape(-1, d), target.ravel(), grads)
        ds = np.ascontiguousarray(ds.reshape(steps, n, d).transpose(0, 2, 1))
        # What a step's gradient is multiplied by, for all steps at once.
        z, r = zr[:, :d], zr[:, d:]
        rest = 1 - z
        on_c = z * (1 - c * c)
        factor = np.empty((steps, 3, d, n), u.dtype)
        factor[:, 0] = (c - h0) * z * rest
        factor[:, 1] = on_c * an * r * (1 - r)
        factor[:, 2] = on_c * r
        there = (~first).astype(u.dtype)
        dh = np.zeros((d, n), u.dtype)
        for t in range(steps - 1, -1, -1):
            g = ds[t]
            g += dh
            factor[t] *= g
            dh = u @ factor[t].reshape(3 * d, n)
            dh += g * rest[t]
            dh *= there[t]
        da = factor.reshape(steps, 3 * d, n)
        grads["u"] += np.matmul(h0, da.transpose(0, 2, 1)).sum(axis=0)
        factor[:, 2] = ds * on_c
        grads["x"] = (slice(None), self._by_word(prev.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * d)))
        return grads, float(logp.sum()), s[-1].T

    def train(self, tokens: np.ndarray, end: int, streams: int = 128, window: int = 16, rate: float = 0.1,
              size: float | None = None) -> None:
        """One pass over the texts in ``tokens``, each closed by ``end``, as parallel streams (Adagrad).

        What does not fill all streams follows in fewer, its gradients at the same weight a token (``size``).
        """
        n = len(tokens)
        streams = max(1, min(streams, n // window))
        length = n // streams
        if length < 1:
            return
        grid = tokens[:streams * length].reshape(streams, length).T
        start = self.c * self.w
        prev = np.vstack([np.full((1, streams), start), grid[:-1]])
        first = prev == end
        first[0] = True
        prev = np.where(first, start, prev)
        if not hasattr(self, "_sum"):
            self._sum = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        h = np.zeros((streams, self.h), F32)
        size = F32(1 / streams if size is None else size)
        for at in range(0, length, window):
            part = slice(at, at + window)
            grads, _, h = self.gradients(prev[part], grid[part], h, first[part])
            for k, g in grads.items():
                if k == "x":
                    rows, g = g
                    g = g * size
                    self._sum[k][rows] += g * g
                    self.p[k][rows] -= rate * g / np.sqrt(self._sum[k][rows])
                else:
                    g *= size
                    self._sum[k] += g * g
                    self.p[k] -= rate * g / np.sqrt(self._sum[k])
        self.train(tokens[streams * length:], end, streams, window, rate, size)

    def score(self, texts: list[np.ndarray], window: int = 64, batch: int = 384) -> np.ndarray:
        """Natural log probability of each whole text (its last token included).

        Texts of like length advance together; the state is carried from window to window.
        """
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        start = self.c * self.w
        for a in range(0, len(order), batch):
            mine = order[a:a + batch]
            sizes = np.array([len(texts[i]) for i in mine])
            h = np.zeros((len(mine), self.h), F32)
            last = np.full(len(mine), start)
            for at in range(0, int(sizes.max(initial=0)), window):
                live = int((sizes > at).sum())  # longest first, so these come first
                steps = min(window, int(sizes[0]) - at)
                grid = np.zeros((live, steps), dtype=np.int64)
                valid = np.zeros((live, steps), dtype=bool)
                for j in range(live):
                    part = texts[mine[j]][at:at + steps]
                    grid[j, :len(part)] = part
                    valid[j, :len(part)] = True
                grid, valid = grid.T, valid.T
                prev = np.vstack([last[None, :live], grid[:-1]])
                s, h = self.states(prev, h[:live])
                pick = valid.ravel()
                full = np.zeros(steps * live)
                rows = np.flatnonzero(pick)
                s, word = s.reshape(-1, self.h), grid.ravel()
                for some in (rows[k:k + 8192] for k in range(0, len(rows), 8192)):  # what the cache holds
                    full[some] = self.loss(s[some], word[some])[0]
                out[[mine[j] for j in range(live)]] += full.reshape(steps, live).sum(axis=0)
                last = grid[-1]
        return out
