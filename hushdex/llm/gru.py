"""Gated recurrent language model in numpy.

The unit has one gate, which both lets the past into the candidate and opens the
state to it. The output softmax is factored: a class for each token, then the word
within its class. The most frequent words are classes of their own, all others share classes
of bounded size, by falling frequency. Documents run in lanes; a lane's state is
carried from window to window and zeroed where the next document begins, so a
document's log-likelihood covers all of it. Training is truncated backpropagation
through windows. Arrays are step by feature by lane: what one operation touches
is contiguous.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Vocabulary entries 0 and 1: any other word, and the end of a document.
OTHER, END = 0, 1


@dataclass(frozen=True)
class Shape:
    """Sizes of a model. Entries below ``singles`` are classes of their own."""

    vocab: int
    hidden: int = 16
    embed: int = 12
    singles: int = 16
    per_class: int = 128

    @property
    def classes(self) -> int:
        return min(self.singles, self.vocab) + -(-max(0, self.vocab - self.singles) // self.per_class)

    def class_of(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.singles, words, self.singles + (words - self.singles) // self.per_class)

    def members(self, c: int) -> slice:
        a = self.singles + (c - self.singles) * self.per_class
        return slice(a, min(self.vocab, a + self.per_class))

    def sizes(self) -> list[tuple[str, tuple[int, ...]]]:
        v, h, e = self.vocab, self.hidden, self.embed
        return [("e", (v, e)), ("w", (2 * h, e)), ("b", (2 * h,)), ("u", (2 * h, h)), ("cw", (self.classes, h)), ("cb", (self.classes,)), ("ww", (v, h)), ("wb", (v,))]


class Gru:
    """Weights, as views of one flat vector, and the passes over a window."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat = shape, flat
        at = 0
        for name, dims in shape.sizes():
            n = int(np.prod(dims))
            setattr(self, name, flat[at : at + n].reshape(dims))
            at += n

    @staticmethod
    def fresh(shape: Shape, counts: np.ndarray, seed: int = 1) -> Gru:
        """Small random weights; output biases give the words' own frequencies."""
        rng = np.random.default_rng(seed)
        g = Gru(shape, np.zeros(sum(int(np.prod(d)) for _, d in shape.sizes()), np.float32))
        for a, scale in ((g.e, 0.3), (g.w, 0.3), (g.u, 0.2), (g.cw, 0.1), (g.ww, 0.1)):
            a[:] = rng.standard_normal(a.shape) * scale
        cls = shape.class_of(np.arange(shape.vocab))
        by = np.bincount(cls, weights=counts + 1.0, minlength=shape.classes)
        g.cb[:], g.wb[:] = np.log(by / by.sum()), np.log((counts + 1.0) / by[cls])
        return g

    def forward(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple:
        """States of all steps of a window, and what the way back needs.

        ``inputs`` and ``keep`` are step by lane; ``keep`` is 0 where a document
        begins, else 1; ``h`` is feature by lane.
        """
        k, (steps, n) = self.shape.hidden, inputs.shape
        kind = self.flat.dtype
        e = self.e[inputs]
        gx = np.matmul(self.w, e.transpose(0, 2, 1))
        gx += self.b[:, None]
        hu = np.empty((steps, 2 * k, n), kind)
        before, gate, cand, hs = (np.empty((steps, k, n), kind) for _ in range(4))
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            np.dot(self.u, before[t], out=hu[t])
            # The gate is (1 + tanh) / 2; it opens to the candidate and lets the past into it.
            f, c = gate[t], cand[t]
            np.add(gx[t, :k], hu[t, :k], out=f)
            np.tanh(f, out=f)
            f *= 0.5
            f += 0.5
            np.multiply(f, hu[t, k:], out=c)
            c += gx[t, k:]
            np.tanh(c, out=c)
            h = hs[t]
            np.subtract(c, before[t], out=h)
            h *= f
            h += before[t]
        return hs, e, hu, gate, before, cand

    def backward(self, inputs: np.ndarray, keep: np.ndarray, dhs: np.ndarray, kept: tuple, grads: Gru) -> None:
        """Add the gradients of a window, given those of its states."""
        _, e, hu, gate, before, cand = kept
        k, (steps, n) = self.shape.hidden, inputs.shape
        slope = 1 - gate
        stay = slope * keep[:, None]
        slope *= gate
        slope *= 2
        into_f = (cand - before) * slope
        slope *= hu[:, k:]
        into_c = 1 - cand * cand
        into_c *= gate
        dgx, du = np.empty_like(hu), np.empty_like(hu)
        dh, part = np.zeros((k, n), hu.dtype), np.empty((k, n), hu.dtype)
        back = np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            dh += dhs[t]
            d = dgx[t]
            np.multiply(dh, into_c[t], out=d[k:])
            np.multiply(d[k:], gate[t], out=du[t, k:])
            np.multiply(dh, into_f[t], out=d[:k])
            np.multiply(d[k:], slope[t], out=part)
            d[:k] += part
            du[t, :k] = d[:k]
            dh *= stay[t]
            np.dot(back, du[t], out=part)
            part *= keep[t]
            dh += part
        grads.u += np.matmul(du, before.transpose(0, 2, 1)).sum(0)
        grads.w += np.matmul(dgx, e).sum(0)
        grads.b += dgx.sum((0, 2))
        de = np.matmul(dgx.transpose(0, 2, 1), self.w).reshape(-1, self.shape.embed)
        words = inputs.ravel()
        order = np.argsort(words.astype(np.uint16) if self.shape.vocab < 1 << 16 else words, kind="stable")
        words = words[order]
        cut = np.flatnonzero(np.diff(words, prepend=-1))
        grads.e[words[cut]] += np.add.reduceat(de[order], cut)

    def outputs(self, hs: np.ndarray, target: np.ndarray, grads: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target (rows of ``hs``); with ``grads`` also d loss / d hs."""
        s = self.shape
        cls = s.class_of(target)
        order = np.argsort(cls.astype(np.uint16) if s.classes < 1 << 16 else cls, kind="stable")
        hs, cls, target = hs[order], cls[order], target[order]
        logp = np.empty(len(target), hs.dtype)
        dhs = np.empty_like(hs) if grads else None
        for a in range(0, len(target), BLOCK):
            b = a + BLOCK
            logp[a:b] = _softmax(self.cw, self.cb, hs[a:b], cls[a:b], dhs[a:b] if grads else None, grads and (grads.cw, grads.cb))
        ends = np.searchsorted(cls, np.arange(s.singles, s.classes + 1)).tolist()
        for c, a, b in zip(range(s.singles, s.classes), ends, ends[1:], strict=False):
            if a == b:
                continue
            m = s.members(c)
            d = np.empty_like(hs[a:b]) if grads else None
            logp[a:b] += _softmax(self.ww[m], self.wb[m], hs[a:b], target[a:b] - m.start, d, grads and (grads.ww[m], grads.wb[m]))
            if grads:
                dhs[a:b] += d
        out = np.empty_like(logp)
        out[order] = logp
        if dhs is None:
            return out, None
        back = np.empty_like(dhs)
        back[order] = dhs
        return out, back


#: Targets whose softmax is worked out at once: what a core's cache holds.
BLOCK = 2048


def _softmax(w: np.ndarray, bias: np.ndarray, x: np.ndarray, target: np.ndarray, d: np.ndarray | None, grads: tuple | None) -> np.ndarray:
    """Log-probability of every target; fills ``d`` with d loss / d x and adds to ``grads``."""
    e = w @ x.T
    e += bias[:, None]
    at = target.astype(np.int64) * len(x) + np.arange(len(x))
    own = e.ravel()[at]
    with np.errstate(over="ignore", divide="ignore"):
        np.exp(e, out=e)
        total = e.sum(0)
        logp = own - np.log(total)
    if not np.isfinite(logp).all():  # scores beyond the range of exp: from the largest one down
        e = w @ x.T + bias[:, None]
        most = e.max(0)
        e -= most
        np.exp(e, out=e)
        total = e.sum(0)
        logp = own - most - np.log(total)
    if d is not None:
        # Columns scaled by 1 / total, less 1 at the target, without a pass over e.
        e.ravel()[at] -= total
        part = 1 / total
        np.dot(e.T, w, out=d)
        d *= part[:, None]
        grads[0][:] += e @ (x * part[:, None])
        grads[1][:] += e @ part
    return logp


@dataclass
class Lanes:
    """Documents side by side: step by lane."""

    inputs: np.ndarray
    targets: np.ndarray
    begins: np.ndarray
    doc: np.ndarray

    def keep(self, a: int, b: int, kind: np.dtype) -> np.ndarray:
        return (~self.begins[a:b]).astype(kind)


def lanes_of(words: np.ndarray, lens: np.ndarray, most: int) -> Lanes:
    """Arrange documents (word streams without end tokens) in at most ``most`` lanes.

    Longest documents go first, each to the shortest lane; a step holds one token
    of each lane, and doc is -1 where a lane has run out.
    """
    size = lens + 1
    n = int(max(1, min(most, len(lens), size.sum() // max(1, size.max(initial=1)) + 1)))
    heap = [(0, k) for k in range(n)]
    lane, start = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    for d in np.argsort(-size, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        lane[d], start[d] = k, at
        heapq.heappush(heap, (at + int(size[d]), k))
    steps = max(at for at, _ in heap)
    inputs, targets = np.full((steps, n), END, np.int32), np.full((steps, n), END, np.int32)
    begins, doc = np.zeros((steps, n), bool), np.full((steps, n), -1, np.int32)
    # Place of every token, end tokens too.
    own = np.repeat(np.arange(len(lens)), size)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat = (start[own] + inside) * n + lane[own]
    doc.ravel()[flat] = own
    word = inside < lens[own]
    targets.ravel()[flat[word]] = words
    inputs.ravel()[flat[inside > 0]] = words
    begins.ravel()[flat[inside == 0]] = True
    return Lanes(inputs, targets, begins, doc)


def score(g: Gru, lanes: Lanes, docs: int, window: int = 24) -> np.ndarray:
    """Natural log-likelihood of every document, over all its tokens and its end."""
    steps, n = lanes.inputs.shape
    kind, k = g.flat.dtype, g.shape.hidden
    h = np.zeros((k, n), kind)
    got = np.zeros((steps, n), kind)
    for a in range(0, steps, window):
        b = min(steps, a + window)
        hs = g.forward(lanes.inputs[a:b], lanes.keep(a, b, kind), h)[0]
        h = hs[-1]
        live = lanes.doc[a:b] >= 0
        got[a:b][live] = g.outputs(hs.transpose(0, 2, 1)[live], lanes.targets[a:b][live])[0]
    keep = lanes.doc >= 0
    return np.bincount(lanes.doc[keep], weights=got[keep].astype(np.float64), minlength=docs)


def loss_and_grads(g: Gru, lanes: Lanes, a: int, b: int, h: np.ndarray) -> tuple[float, int, Gru, np.ndarray]:
    """Loss over one window, its token count, gradients, and the state to carry on."""
    k, kind = g.shape.hidden, g.flat.dtype
    grads = Gru(g.shape, np.zeros_like(g.flat))
    x, keep = lanes.inputs[a:b], lanes.keep(a, b, kind)
    kept = g.forward(x, keep, h)
    hs = kept[0]
    rows = hs.transpose(0, 2, 1).reshape(-1, k)
    live = (lanes.doc[a:b] >= 0).ravel()
    whole = bool(live.all())
    logp, d = g.outputs(rows if whole else rows[live], lanes.targets[a:b].ravel() if whole else lanes.targets[a:b].ravel()[live], grads)
    if not whole:
        full = np.zeros_like(rows)
        full[live] = d
        d = full
    g.backward(x, keep, np.ascontiguousarray(d.reshape(b - a, -1, k).transpose(0, 2, 1)), kept, grads)
    return -float(logp.sum(dtype=np.float64)), int(live.sum()), grads, hs[-1]


#: Tokens after which a document's training goes on from a zero state: a single
#: long document would leave all lanes but one idle.
PIECE = 400


def pieces(lens: np.ndarray, most: int = PIECE) -> np.ndarray:
    """Lengths of consecutive pieces; each document's last one takes its rest."""
    full = np.maximum(0, lens - 1) // most
    out = np.full(int((full + 1).sum()), most, np.int64)
    out[np.cumsum(full + 1) - 1] = lens - full * most
    return out


class Trainer:
    """Steps scaled by each weight's own past gradients, over truncated windows."""

    def __init__(self, g: Gru, past: np.ndarray | None = None, rate: float = 0.1) -> None:
        self.g, self.rate = g, rate
        self.past, self.tokens = np.full_like(g.flat, 1e-8) if past is None else past, 0

    def train(self, words: np.ndarray, lens: np.ndarray, lanes: int = 512, window: int = 16) -> None:
        if not len(lens):
            return
        data = lanes_of(words, pieces(lens), lanes)
        steps, n = data.inputs.shape
        h = np.zeros((self.g.shape.hidden, n), self.g.flat.dtype)
        for a in range(0, steps, window):
            _, many, grads, h = loss_and_grads(self.g, data, a, min(steps, a + window), h)
            if many:
                self.update(grads.flat, many)
        self.tokens += int((lens + 1).sum())

    def update(self, d: np.ndarray, many: int) -> None:
        norm = float(np.sqrt(np.dot(d, d))) / many
        d *= np.float32(1 / (many * max(1.0, norm)))
        self.past += d * d
        d /= np.sqrt(self.past)
        d *= np.float32(self.rate)
        self.g.flat -= d
