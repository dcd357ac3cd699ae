"""A gated recurrent language model in numpy with a class-factored output softmax.

The event space is all words. The ``K`` most frequent have an input vector of their own and stand
in classes; a word's probability is that of its class times its share in a softmax over the class.
Every other word belongs to a tail class by its surface (last character, ASCII or not); its share
there is (count + 0.1) / mass, which an unseen word has with count 0.

States of texts read side by side are the columns of a matrix, so that each gate is one block.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
CLASSES = 64
#: Truncation of backpropagation, and streams that are learnt from side by side.
STEPS, STREAMS = 16, 256
RATE = 0.1
TAILS = 16
#: Hidden states whose outputs are computed together, and of those, logits held at once.
FLUSH, ROWS = 40_000, 1024
#: Logits up to this need not be lowered by their largest before the exponential.
SAFE = 60.0


def split(counts: np.ndarray) -> np.ndarray:
    """First word of each class (and the end) of words in falling order of frequency. Classes have
    equal sums of the roots of counts, which keeps those of frequent words small."""
    if not len(counts):
        return np.zeros(1, np.int64)
    mass = np.cumsum(np.sqrt(counts))
    cls = ((mass - np.sqrt(counts)) * min(CLASSES, len(counts)) / mass[-1]).astype(np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(counts)]])


def start(counts: np.ndarray, tail_mass: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the relative frequencies. The output rows of classes
    and words end in their bias; states have a 1 there."""
    k, cuts, rng = len(counts), split(counts), np.random.default_rng(5)
    counts = np.maximum(counts.astype(np.float64), 0.1)
    heads = np.add.reduceat(counts, cuts[:-1]) if k else np.zeros(0)
    mass = np.maximum(np.concatenate([heads, tail_mass]), 0.1)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    words, classes = small(k, HIDDEN + 1) * 0.1, small(len(mass), HIDDEN + 1) * 0.1
    words[:, HIDDEN] = np.log(counts / np.repeat(heads, np.diff(cuts)))
    classes[:, HIDDEN] = np.log(mass / mass.sum())
    return {"input": small(k + TAILS, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN) * 2, "class": classes, "word": words}


def step(state: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next states, gates) from gate inputs x (3 * HIDDEN rows; overwritten) and states h (HIDDEN rows)."""
    u = state.T @ h
    gates, n, un = x[: 2 * HIDDEN], x[2 * HIDDEN :], u[2 * HIDDEN :]
    gates += u[: 2 * HIDDEN]
    np.negative(gates, gates)
    with np.errstate(over="ignore"):
        np.exp(gates, gates)
    gates += 1
    np.reciprocal(gates, gates)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    n += r * un
    np.tanh(n, n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, un


def class_of(cuts: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Output class of each word number; numbers from k on are tails."""
    table = np.concatenate([np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), len(cuts) - 1 + np.arange(TAILS)]).astype(np.uint8 if len(cuts) + TAILS < 256 else np.int64)
    return table[words]


def _softmax(h: np.ndarray, w: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of the logits of rows w after states h, their sums, and what the logits were lowered by."""
    e, top = h @ w.T, 0.0
    if not safe:
        top = e.max(1)
        e -= top[:, None]
    np.exp(e, e)
    return e, e @ np.ones(len(w), e.dtype), top


def bounded(w: np.ndarray) -> bool:
    """Whether no logit of states between -1 and 1 can be beyond SAFE."""
    return not len(w) or float((np.abs(w[:, :HIDDEN]).sum(1) + w[:, HIDDEN]).max()) < SAFE


def log_probs(p: dict, cuts: np.ndarray, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log probability of each word after its state (a row of h); of a tail word, of its class."""
    k = len(p["word"])
    order = np.argsort(words, kind="stable")
    ws, out = words[order], np.empty(len(h), np.float64)
    hs = np.ones((len(h), HIDDEN + 1), h.dtype)
    hs[:, :HIDDEN] = h[order]
    own = np.einsum("ij,ij->i", hs, p["class"][class_of(cuts, ws, k)])
    safe = bounded(p["class"])
    for lo in range(0, len(h), ROWS):
        _, total, top = _softmax(hs[lo : lo + ROWS], p["class"], safe)
        out[lo : lo + ROWS] = own[lo : lo + ROWS] - np.log(total) - top
    bounds, safe = np.searchsorted(ws, cuts), bounded(p["word"])
    heads = bounds[-1]
    out[:heads] += np.einsum("ij,ij->i", hs[:heads], p["word"][ws[:heads]])
    for c in np.flatnonzero(np.diff(bounds)):
        for lo in range(bounds[c], bounds[c + 1], ROWS):
            hi = min(lo + ROWS, bounds[c + 1])
            _, total, top = _softmax(hs[lo:hi], p["word"][cuts[c] : cuts[c + 1]], safe)
            out[lo:hi] -= np.log(total) + top
    back = np.empty_like(out)
    back[order] = out
    return back


def score(p: dict, cuts: np.ndarray, words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of whole texts (word numbers one after another, offsets).

    Texts advance side by side, the long ones to the end; states are carried throughout."""
    sizes = np.diff(offs)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offs[:-1][order], sizes[order]
    n, rows = len(sizes), np.ascontiguousarray(p["input"])
    out = np.zeros(n, np.float64)
    h = np.zeros((HIDDEN, n), np.float32)
    room = FLUSH + n
    states, read, at, used = np.empty((HIDDEN, room), np.float32), np.empty(room, np.int64), np.empty(room, np.int64), 0
    live = n
    for t in range(int(sizes[0]) if n else 0):
        while sizes[live - 1] <= t:
            live = live - 1 if live < 64 else int(np.searchsorted(-sizes, -t, "left"))
        w = words[starts[:live] + t]
        h = h[:, :live]
        states[:, used : used + live], read[used : used + live], at[used : used + live] = h, w, np.arange(live)
        used += live
        if used >= FLUSH:
            out += np.bincount(at[:used], weights=log_probs(p, cuts, np.ascontiguousarray(states[:, :used].T), read[:used]), minlength=n)
            used = 0
        h = step(p["state"], np.ascontiguousarray(rows[w].T), h)[0]
    if used:
        out += np.bincount(at[:used], weights=log_probs(p, cuts, np.ascontiguousarray(states[:, :used].T), read[:used]), minlength=n)
    back = np.empty_like(out)
    back[order] = out
    return back


def streams(words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Words cut into streams side by side: what is read at each step, and what follows it. Every
    word follows once: before the first stands an end, and where streams are of unequal length
    the shorter ones are followed by -1, which is not learnt."""
    n = len(words)
    side = min(STREAMS, max(1, n // (STEPS * 64)))
    steps = -(-n // side)
    x, y = np.full(side * steps + 1, end, words.dtype), np.full(side * steps, -1, words.dtype)
    x[1 : n + 1], y[:n] = words, words
    return x[:-1].reshape(side, steps).T, y.reshape(side, steps).T


def _less(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Take each row from that of ``out`` which ``at``, in rising order, names."""
    if len(at):
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        out[at[first]] -= np.add.reduceat(rows, first)


class Learner:
    """Truncated backpropagation with per-parameter step sizes (Adagrad), on touched rows only."""

    def __init__(self, p: dict, cuts: np.ndarray, end: int, sums: dict | None = None):
        self.p, self.cuts, self.end = p, cuts, end
        self.sums = sums or {name: np.full_like(v, 1e-3) for name, v in p.items()}

    def _move(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        s = self.sums[name]
        new = s[rows] + grad * grad
        s[rows] = new
        self.p[name][rows] -= RATE * grad / np.sqrt(new)

    def window(self, words: np.ndarray, targets: np.ndarray, h0: np.ndarray) -> tuple[np.ndarray, float]:
        """Learn one window: words (steps, streams) read after which targets follow (-1: nothing).
        Returns the last states and the loss."""
        p, (t_max, b) = self.p, words.shape
        ended = words == self.end
        x = np.ascontiguousarray(p["input"][words.reshape(-1)].reshape(t_max, b, -1).transpose(0, 2, 1))
        states, olds, z, r, n, un = (np.empty((t_max, HIDDEN, b), x.dtype) for _ in range(6))
        h = h0
        for t in range(t_max):
            olds[t] = h
            h, z[t], r[t], n[t], un[t] = step(p["state"], x[t], h)
            h[:, ended[t]] = 0  # a new text begins
            states[t] = h
        flat = targets.reshape(-1)
        rows = np.flatnonzero(flat >= 0)
        dh = np.zeros((t_max * b, HIDDEN), x.dtype)
        dh[rows], loss = self._outputs(states.transpose(0, 2, 1).reshape(-1, HIDDEN)[rows], flat[rows])
        dh = np.ascontiguousarray(dh.reshape(t_max, b, HIDDEN).transpose(0, 2, 1))
        back, gate, reset = (1 - z) * (1 - n * n), (olds - n) * z * (1 - z), un * r * (1 - r)
        dx, du_all, carry = np.empty((t_max, 3 * HIDDEN, b), x.dtype), np.zeros_like(p["state"]), np.zeros((HIDDEN, b), x.dtype)
        for t in range(t_max - 1, -1, -1):
            d = dh[t] + carry
            d[:, ended[t]] = 0
            dz, dr, dn = dx[t, :HIDDEN], dx[t, HIDDEN : 2 * HIDDEN], dx[t, 2 * HIDDEN :]
            np.multiply(d, back[t], dn)
            np.multiply(d, gate[t], dz)
            np.multiply(dn, reset[t], dr)
            du = dx[t].copy()
            du[2 * HIDDEN :] *= r[t]
            du_all += olds[t] @ du.T
            carry = d * z[t] + p["state"] @ du
        read = words.reshape(-1)
        order = np.argsort(read.astype(np.int16) if len(p["input"]) < 1 << 15 else read, kind="stable")
        sorted_ = read[order]
        first = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
        self._move("input", np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first), sorted_[first])
        self._move("state", np.clip(du_all, -1, 1))
        return h, loss

    def _outputs(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, float]:
        """Learn the output weights; the loss's gradient by states (rows of h) and the loss."""
        p, k, m, cuts = self.p, len(self.p["word"]), len(words), self.cuts
        if not m:
            return np.zeros_like(h), 0.0
        order = np.argsort(words.astype(np.int16) if k + TAILS < 1 << 15 else words, kind="stable")
        ws = words[order]
        hs = np.ones((m, HIDDEN + 1), h.dtype)
        hs[:, :HIDDEN] = h[order]
        cls = class_of(cuts, ws, k)
        e, total, top = _softmax(hs, p["class"], bounded(p["class"]))
        share = (1 / total)[:, None]
        own = p["class"][cls]
        loss = float(np.log(total).sum() + np.sum(top) - np.einsum("ij,ij->", hs, own))
        dh = e @ p["class"]
        dh *= share
        dh -= own
        by_class = e.T @ (hs * share)
        _less(by_class, cls, hs)
        bounds, safe = np.searchsorted(ws, cuts), bounded(p["word"])
        heads, by_word = bounds[-1], np.zeros_like(p["word"])
        own = p["word"][ws[:heads]]
        loss -= float(np.einsum("ij,ij->", hs[:heads], own))
        dh[:heads] -= own
        totals, lowered = np.ones(heads, h.dtype), 0.0
        ends, cut, ones, word = bounds.tolist(), cuts.tolist(), np.ones(k, h.dtype), p["word"]
        for a, b, lo, hi in zip(ends, ends[1:], cut, cut[1:], strict=False):  # few numpy calls: there are many small classes
            if a == b:
                continue
            x, w = hs[a:b], word[lo:hi]
            e = x @ w.T
            if not safe:
                top = e.max(1, keepdims=True)
                e -= top
                lowered += float(top.sum())
            np.exp(e, e)
            total = e @ ones[: hi - lo]
            totals[a:b] = total
            e /= total[:, None]
            np.matmul(e.T, x, out=by_word[lo:hi])
            dh[a:b] += e @ w
        loss += float(np.log(totals).sum()) + lowered
        _less(by_word, ws[:heads], hs[:heads])
        self._move("class", by_class / m)
        self._move("word", by_word / m)
        out = np.empty_like(h)
        out[order] = dh[:, :HIDDEN] / m
        return out, loss

    def learn(self, words: np.ndarray) -> float:
        """Learn every word of a run of texts (each closed by the end word) once, and return the loss."""
        if not len(words):
            return 0.0
        x, y = streams(words, self.end)
        h, loss = np.zeros((HIDDEN, x.shape[1]), np.float32), 0.0
        for lo in range(0, len(x), STEPS):
            h, one = self.window(x[lo : lo + STEPS], y[lo : lo + STEPS], h)
            loss += one
        return loss
