"""A gated recurrent language model with a class-factored softmax, in numpy.

Tokens are ids. The most frequent `words` ids are in `word_classes` classes of equal number by
frequency; each other token belongs to one of `rest_classes` classes and is not told apart further
here. P(token | past) = P(class | state) * P(word | class, state); the second factor is left out
for rest classes. Output biases start at the unigram frequencies.

Texts run in lanes: a lane has texts one after another, with the state set to zero where a text
starts. Lanes go through time in windows; the state at a window's end starts the next window, so
a text's likelihood is that of the whole text however many windows it takes. Training
back-propagates inside a window (truncated BPTT) and updates after it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
#: Logits of this size at most need no shift in single precision.
SAFE = 60


@dataclass(frozen=True)
class Shape:
    words: int = 1024
    word_classes: int = 32
    rest_classes: int = 32

    @property
    def per_class(self) -> int:
        return -(-self.words // self.word_classes)

    @property
    def tokens(self) -> int:
        """Words, rest classes, and the start of a text."""
        return self.words + self.rest_classes + 1

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.per_class, self.word_classes + ids - self.words)


def initial(shape: Shape, counts: np.ndarray, seed: int = 3, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Parameters; counts: of the words and the rest classes, by id."""
    rng = np.random.default_rng(seed)
    normal = lambda *size, by: rng.normal(0, by, size).astype(np.float32)
    smooth = counts + 0.5
    words = np.full(shape.word_classes * shape.per_class, 1e-6)
    words[: shape.words] = smooth[: shape.words]
    words = words.reshape(shape.word_classes, shape.per_class)
    classes = np.concatenate([words.sum(1), smooth[shape.words :]])
    return {
        "x": normal(shape.tokens, 3 * hidden, by=0.3),
        "u": normal(hidden, 3 * hidden, by=hidden**-0.5),
        "c": normal(hidden, len(classes), by=0.05),
        "c_b": np.log(classes / classes.sum()).astype(np.float32),
        "w": normal(shape.word_classes, hidden, shape.per_class, by=0.05),
        "w_b": np.log(words / words.sum(1, keepdims=True)).astype(np.float32),
    }


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in params.values()])


def unflat(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def softmax(logits: np.ndarray, chosen: np.ndarray, safe: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probabilities of the chosen columns, exponentials, their sums by row); logits are used up.

    One shift for all rows is enough but where a row lies far below the largest; rows are shifted each then. Logits
    within SAFE are not shifted.
    """
    if safe:
        here = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + chosen]
        e = np.exp(logits, out=logits)
        total = e @ np.ones(logits.shape[1], logits.dtype)
        return here - np.log(total), e, total
    logits -= logits.max()
    here = logits[np.arange(len(logits)), chosen]
    ones = np.ones(logits.shape[1], logits.dtype)
    e = np.exp(logits)
    total = e @ ones
    if total.min() < 1e-20:
        logits -= logits.max(1, keepdims=True)
        here = logits[np.arange(len(logits)), chosen]
        e = np.exp(logits)
        total = e @ ones
    return here - np.log(total), e, total


class Lanes:
    """Texts dealt to lanes of about equal length, longest lane first."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, shape: Shape, lanes: int):
        self.sizes = sizes
        starts = np.cumsum(sizes) - sizes
        loads = [(0, k) for k in range(max(1, min(lanes, len(sizes))))]
        held: list[list[int]] = [[] for _ in loads]
        for k in np.argsort(-sizes, kind="stable").tolist():
            load, lane = heapq.heappop(loads)
            held[lane].append(k)
            heapq.heappush(loads, (load + int(sizes[k]), lane))
        total = np.array([sizes[x].sum() for x in held], np.int64)
        order = np.argsort(-total, kind="stable")
        self.length = total[order]
        self.texts = [held[k] for k in order]
        steps = int(self.length.max(initial=0))
        self.want = np.full((len(order), steps), -1, np.int32)
        self.past = np.full((len(order), steps), shape.tokens - 1, np.int32)
        for lane, texts in enumerate(self.texts):
            at = 0
            for k in texts:
                n = int(sizes[k])
                own = ids[starts[k] : starts[k] + n]
                self.want[lane, at : at + n] = own
                self.past[lane, at + 1 : at + n] = own[:-1]
                at += n
        self.want, self.past = np.ascontiguousarray(self.want.T), np.ascontiguousarray(self.past.T)
        self.start_id = shape.tokens - 1

    def windows(self, size: int):
        """(first step, wanted ids, past ids) of the lanes that still run."""
        for t in range(0, len(self.want), size):
            n = int(np.searchsorted(-self.length, -t, "left"))
            yield t, self.want[t : t + size, :n], self.past[t : t + size, :n]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (step, lane) by text."""
        out = np.zeros(len(self.sizes))
        for lane, texts in enumerate(self.texts):
            own = self.sizes[texts]
            if len(own):
                run = np.concatenate([[0.0], np.cumsum(values[: own.sum(), lane], dtype=np.float64)])
                ends = np.cumsum(own)
                out[texts] = run[ends] - run[ends - own]
        return out


class Gru:
    def __init__(self, shape: Shape, params: dict[str, np.ndarray]):
        self.shape, self.p = shape, params
        self.hidden = params["u"].shape[0]

    def _run(self, past: np.ndarray, h: np.ndarray, start_id: int, keep: bool):
        """States after each step; with keep, what back-propagation needs: by step, the state before, z, r, q and the candidate.

        Gates are apart, (gate, lane, unit), so each is in one piece.
        """
        n, shape = self.hidden, h.shape
        # By exponentials, which numpy computes faster: sigmoid(v) = 1 / (exp(-v) + 1), tanh(v) = 1 - 2 / (exp(2 * v) + 1).
        minus, x = self._gates(self.p["u"]), self._gates(self.p["x"])
        np.negative(minus[:2], out=minus[:2])
        np.negative(x[:2], out=x[:2])
        fresh = past == start_id
        some = fresh.any(1).tolist()
        e = np.empty((len(past), 3, *shape), np.float32)
        for k in range(3):
            e[:, k] = x[k][past]
        states = np.empty((len(past), *shape), np.float32)
        steps = len(past) if keep else 1
        before, zr, a, cand = (np.empty((steps, *parts, *shape), np.float32) for parts in ((), (2,), (3,), ()))
        with np.errstate(over="ignore"):  # an exponential without a bound is a gate that is shut
            for t in range(len(past)):
                at = t if keep else 0
                if some[t]:
                    h = np.where(fresh[t][:, None], np.float32(0), h)
                if keep:
                    before[t] = h
                by, gates, new = np.matmul(h, minus, out=a[at]), zr[at], cand[at]
                np.add(e[t, :2], by[:2], out=gates)
                np.exp(gates, out=gates)
                gates += np.float32(1)
                np.reciprocal(gates, out=gates)
                np.multiply(gates[1], by[2], out=new)
                new += e[t, 2]
                new *= np.float32(2)
                np.exp(new, out=new)
                new += np.float32(1)
                np.divide(np.float32(-2), new, out=new)
                new += np.float32(1)
                h = np.subtract(h, new, out=states[t])
                h *= gates[0]
                h += new
        return states, [before, zr[:, 0], zr[:, 1], a[:, 2], cand] if keep else []

    def _gates(self, weights: np.ndarray) -> np.ndarray:
        """(rows, 3 * hidden) -> a copy as (3, rows, hidden)."""
        return np.ascontiguousarray(weights.reshape(len(weights), 3, self.hidden).transpose(1, 0, 2))

    def _outputs(self, states: np.ndarray, want: np.ndarray, grad: bool):
        """Natural log-probabilities by position; with grad, gradients and the states' own."""
        p, shape, n = self.p, self.shape, self.hidden
        y = want.ravel()
        # A last column of ones takes the biases; states lie within 1, so sums of weights bound the logits.
        s = np.ones((len(y), n + 1), np.float32)
        s[:, :n] = states.reshape(-1, n)
        c, w = np.concatenate([p["c"], p["c_b"][None]]), np.concatenate([p["w"], p["w_b"][:, None]], 1)
        real = y >= 0
        whole = bool(real.all())
        cls = shape.class_of(y if whole else np.maximum(y, 0))
        out, e, total = softmax(s @ c, cls, np.abs(c).sum(0).max() <= SAFE)
        grads: dict[str, np.ndarray] = {}
        ds = None
        if grad:
            d = e
            d *= (1 / total)[:, None]
            d.ravel()[np.arange(0, d.size, d.shape[1]) + cls] -= 1
            if not whole:
                d[~real] = 0
            by_c = s.T @ d
            grads["c"], grads["c_b"] = by_c[:n], by_c[n]
            by_w = np.zeros_like(w)
            grads["w"], grads["w_b"] = by_w[:, :n], by_w[:, n]
            ds = d @ p["c"].T
        words = np.flatnonzero(y < shape.words) if whole else np.flatnonzero(real & (y < shape.words))
        words = words[np.argsort(cls[words].astype(np.uint16) if shape.word_classes <= 1 << 16 else cls[words], kind="stable")]
        bounds = np.searchsorted(cls[words], np.arange(shape.word_classes + 1)).tolist()
        # Rows in the order of their classes, so a class is a slice.
        rows, places = s[words], y[words] - cls[words] * shape.per_class
        values, by_rows, safe = np.empty(len(words), out.dtype), np.empty((len(words), n), np.float32), np.abs(w).sum(1).max() <= SAFE
        for k in range(shape.word_classes):
            at = slice(bounds[k], bounds[k + 1])
            if at.start < at.stop:
                own, place = rows[at], places[at]
                values[at], d, total = softmax(own @ w[k], place, safe)
                if grad:
                    d *= (1 / total)[:, None]
                    d.ravel()[np.arange(0, d.size, d.shape[1]) + place] -= 1
                    np.matmul(own.T, d, out=by_w[k])
                    np.matmul(d, p["w"][k].T, out=by_rows[at])
        out[words] += values
        if grad:
            ds[words] += by_rows
        out[~real] = 0
        return out.reshape(want.shape), grads, ds

    def score(self, lanes: Lanes, window: int = 32) -> np.ndarray:
        """Natural log-likelihood of each text."""
        values = np.zeros(lanes.want.shape, np.float32)
        h = np.zeros((lanes.want.shape[1], self.hidden), np.float32)
        for t, want, past in lanes.windows(window):
            states, _ = self._run(past, h[: want.shape[1]], lanes.start_id, False)
            values[t : t + len(want), : want.shape[1]] = self._outputs(states, want, False)[0]
            h = states[-1]
        return lanes.by_text(values)

    def train(self, lanes: Lanes, rate: float, window: int = 16, memory: dict | None = None) -> dict:
        """One pass of truncated BPTT with Adagrad.

        The state goes through all windows, and each updates the parameters. Returns Adagrad's
        memory, to go on with.
        """
        memory = memory or {k: np.full_like(v, 1e-5) for k, v in self.p.items()}
        self.p = {k: v.copy() for k, v in self.p.items()}
        h = np.zeros((lanes.want.shape[1], self.hidden), np.float32)
        for _, want, past in lanes.windows(window):
            states, kept = self._run(past, h[: want.shape[1]], lanes.start_id, True)
            h = states[-1]
            for name, (at, g) in self._touched(states, kept, want, past).items():
                # Rows without a gradient stay as they are.
                m = memory[name][at] + g * g
                memory[name][at] = m
                np.sqrt(m, out=m)
                np.divide(g, m, out=m)
                m *= np.float32(rate)
                self.p[name][at] -= m
        return memory

    def _gradients(self, states: np.ndarray, kept: list, want: np.ndarray, past: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood over the window's tokens."""
        out = {}
        for name, (at, g) in self._touched(states, kept, want, past).items():
            out[name] = np.zeros_like(self.p[name])
            out[name][at] = g
        return out

    def _touched(self, states: np.ndarray, kept: list, want: np.ndarray, past: np.ndarray) -> dict[str, tuple]:
        """(rows that the window uses, their gradients)."""
        n, u = self.hidden, self.p["u"]
        _, grads, ds = self._outputs(states, want, True)
        ds = ds.reshape(states.shape)
        before, z, r, q, new = kept
        # All that does not depend on later steps, for the whole window at once.
        by_new, by_q = (1 - z) * (1 - new * new), q * r * (1 - r)
        by_z = (before - new) * z * (1 - z)
        dh, fresh = np.zeros_like(states[0]), past == self.shape.tokens - 1
        some = fresh.any(1).tolist()
        da, ut = np.empty((len(want), 3, want.shape[1], n), np.float32), np.ascontiguousarray(self._gates(u).transpose(0, 2, 1))
        by_cand = np.empty_like(states)
        for t in range(len(want) - 1, -1, -1):
            dh += ds[t]
            d_new = np.multiply(dh, by_new[t], out=by_cand[t])
            np.multiply(dh, by_z[t], out=da[t, 0])
            np.multiply(d_new, by_q[t], out=da[t, 1])
            np.multiply(d_new, r[t], out=da[t, 2])
            dh *= z[t]
            for part in np.matmul(da[t], ut):
                dh += part
            if some[t]:
                dh[fresh[t]] = 0
        du = np.concatenate([before.reshape(-1, n).T @ da[:, k].reshape(-1, n) for k in range(3)], 1)
        ids, rows = past.ravel(), np.concatenate([da[:, 0], da[:, 1], by_cand], -1).reshape(-1, 3 * n)
        # Short numbers are sorted by their digits.
        order = np.argsort(ids.astype(np.uint16) if self.shape.tokens <= 1 << 16 else ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["x"], grads["u"] = np.add.reduceat(rows[order], starts), du
        scale = np.float32(1 / max(1, int((want >= 0).sum())))
        return {k: (ids[starts] if k == "x" else slice(None), grads[k] * scale) for k in self.p}
