"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A step's input is a word's vector beside the mean vector of its character trigrams, so a word that
was never seen still has its letters. Both are looked up by hash: tables of fixed size, whatever
the corpus. Word vectors start at zero, so an unseen word adds nothing of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from codewarden.llm import words

WORD_ROWS = 1 << 14
GRAM_ROWS = 1 << 12
WORD_DIM = 12
GRAM_DIM = 12
HIDDEN = 10
ATTENTION = 8
#: Words in a window, and from one window's start to the next: every phrase of 17 words is whole in one.
WINDOW = 32
STRIDE = 16
#: Windows that go through the network together.
TOGETHER = 1024


class Lexicon:
    """The distinct words of a batch of texts: table rows of each word and of its trigrams."""

    def __init__(self, texts: pa.Array):
        raw, bounds, _ = words.text_bytes(texts)
        starts, ends, self.first = words.word_spans(raw, bounds, words.IS_GAP)
        hashes = words.hash_spans(raw, starts, ends)
        self.hashes, where, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.of = self.of.astype(np.int32)
        self.word = (self.hashes >> np.uint64(20)) % np.uint64(WORD_ROWS)
        self.word = self.word.astype(np.int64)
        size = ends[where] - starts[where]
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(owner)) - self.offsets[owner]
        byte = starts[where][owner] + inside
        here = words.LOWERED[raw[byte]].astype(np.uint64)
        # Bytes before and after within the word; 0 stands for its edges.
        near = np.zeros(len(here) + 2, np.uint64)
        near[1:-1] = here
        before = np.where(inside > 0, near[:-2], 0)
        after = np.where(inside < size[owner] - 1, near[2:], 0)
        gram = (before << np.uint64(16)) | (here << np.uint64(8)) | after
        self.grams = (words.mix(gram + np.uint64(0x51)) % np.uint64(GRAM_ROWS)).astype(np.int64)

    def trigrams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all trigrams of ``some`` words and where each word's begin."""
        size = self.offsets[some + 1] - self.offsets[some]
        begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(some)), size)
        return self.grams[self.offsets[some][owner] + np.arange(len(owner)) - begin[owner]], begin


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and length of all overlapping windows; a text without words has one
    empty window."""
    counts = np.diff(first)
    each = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), each)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = first[:-1][owner] + number * STRIDE
    return owner, start, np.clip(first[1:][owner] - start, 0, WINDOW)


class Network:
    """Weights and passes. ``weights`` are plain arrays, so a network is pickled with a task."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        dim = WORD_DIM + GRAM_DIM

        def matrix(rows, cols):
            return (r.normal(size=(rows, cols)) / np.sqrt(rows)).astype(np.float32)

        self.weights = {
            "word": np.zeros((WORD_ROWS, WORD_DIM), np.float32),
            "gram": (0.3 * r.normal(size=(GRAM_ROWS, GRAM_DIM))).astype(np.float32),
            "pool": matrix(2 * HIDDEN, ATTENTION),
            "query": matrix(ATTENTION, 1)[:, 0],
            "out": matrix(2 * HIDDEN, 1)[:, 0],
            "bias": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.weights[f"x{way}"] = matrix(dim, 3 * HIDDEN)
            self.weights[f"c{way}"] = np.zeros(3 * HIDDEN, np.float32)
            self.weights[f"g{way}"] = matrix(HIDDEN, 2 * HIDDEN)
            self.weights[f"n{way}"] = matrix(HIDDEN, HIDDEN)

    def inputs(self, lexicon: Lexicon, some: np.ndarray) -> np.ndarray:
        grams, begin = lexicon.trigrams(some)
        mean = np.add.reduceat(self.weights["gram"][grams], begin[:-1], axis=0)
        mean /= np.diff(begin)[:, None]
        return np.concatenate([self.weights["word"][lexicon.word[some]], mean], axis=1)

    def _run(self, way: str, gates: np.ndarray, index: np.ndarray, live: np.ndarray, keep):
        """Hidden states (steps, HIDDEN, windows) of one direction; ``gates`` holds the input's
        share of each distinct word. Windows run along the last axis, so that every slice is in
        one piece."""
        g, n_ = np.ascontiguousarray(self.weights[f"g{way}"].T), self.weights[f"n{way}"].T
        h = np.zeros((HIDDEN, index.shape[1]), gates.dtype)
        states = np.empty((len(index), *h.shape), gates.dtype)
        for t in range(len(index)) if way == "f" else reversed(range(len(index))):
            x = np.ascontiguousarray(gates[index[t]].T)
            zr = g @ h
            zr += x[: 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = n_ @ (r * h)
            n += x[2 * HIDDEN :]
            np.tanh(n, out=n)
            if keep is not None:
                keep[t] = (h, z, r, n)
            step = n - h
            step *= z
            step *= live[t]
            step += h
            states[t] = h = step
        return states

    def _gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.weights[f"x{way}"] + self.weights[f"c{way}"] for way in "fb"]

    def _pooled(self, gates, index, live, keep: dict | None):
        w = self.weights
        caches = {way: [None] * len(index) if keep is not None else None for way in "fb"}
        h = np.concatenate(
            [self._run(way, gate, index, live, caches[way]) for way, gate in zip("fb", gates, strict=True)],
            axis=1,
        )
        att = np.tanh(w["pool"].T @ h)
        score = np.where(live > 0, w["query"] @ att, -1e9)
        score = np.exp(score - score.max(axis=0)) * (live > 0)
        share = score / np.maximum(score.sum(axis=0), 1e-9)
        if keep is not None:
            keep.update(caches=caches, h=h, att=att, share=share)
        return (share * (w["out"] @ h)).sum(axis=0) + w["bias"][0]

    def forward(self, lexicon: Lexicon, index: np.ndarray, live: np.ndarray, keep: dict):
        """Logits of windows, keeping what ``backward`` needs; ``index`` (steps, windows) numbers the
        lexicon's words."""
        some, place = np.unique(index[live > 0], return_inverse=True)
        local = np.zeros(index.shape, np.int64)
        local[live > 0] = place
        if len(some):
            x = self.inputs(lexicon, some)
        else:
            x = np.zeros((1, WORD_DIM + GRAM_DIM), np.float32)
        keep.update(some=some, local=local, x=x)
        return self._pooled(self._gates(x), local, live, keep)

    def backward(self, lexicon: Lexicon, live: np.ndarray, keep: dict, error: np.ndarray) -> dict:
        """Gradients of all weights; those of the tables come as (rows, values)."""
        w = self.weights
        h, att, share, x = keep["h"], keep["att"], keep["share"], keep["x"]
        spoken = w["out"] @ h
        d_spoken = share * error
        grads = {"out": np.einsum("tb,thb->h", d_spoken, h), "bias": np.array([error.sum()])}
        d_score = d_spoken * (spoken - (share * spoken).sum(axis=0))
        grads["query"] = np.einsum("tb,tab->a", d_score, att)
        d_att = d_score[:, None, :] * w["query"][:, None] * (1 - att * att)
        grads["pool"] = np.einsum("thb,tab->ha", h, d_att)
        d_h = d_spoken[:, None, :] * w["out"][:, None] + w["pool"] @ d_att
        d_x = np.zeros_like(x)
        words_in = np.unique(keep["local"])
        order = np.argsort(keep["local"], axis=None, kind="stable")
        begin = np.searchsorted(keep["local"].ravel()[order], words_in)
        for k, way in enumerate("fb"):
            g, n_ = w[f"g{way}"], w[f"n{way}"]
            d_g, d_n = np.zeros_like(g), np.zeros_like(n_)
            d_gates = np.empty((len(h), h.shape[2], 3 * HIDDEN), x.dtype)
            carry = np.zeros((HIDDEN, h.shape[2]), x.dtype)
            steps = range(len(h))
            for t in reversed(steps) if way == "f" else steps:
                before, z, r, n = keep["caches"][way][t]
                d = carry + d_h[t, k * HIDDEN : (k + 1) * HIDDEN]
                d_cand = d * live[t] * z * (1 - n * n)
                d_z = d * live[t] * (n - before) * z * (1 - z)
                d_rh = n_ @ d_cand
                d_r = d_rh * before * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r])
                d_g += before @ d_zr.T
                d_n += (r * before) @ d_cand.T
                d_gates[t, :, : 2 * HIDDEN], d_gates[t, :, 2 * HIDDEN :] = d_zr.T, d_cand.T
                carry = d * (1 - live[t] * z) + d_rh * r + g @ d_zr
            total = np.zeros((len(x), 3 * HIDDEN), x.dtype)
            total[words_in] = np.add.reduceat(d_gates.reshape(-1, 3 * HIDDEN)[order], begin)
            grads[f"g{way}"], grads[f"n{way}"] = d_g, d_n
            grads[f"x{way}"] = x.T @ total
            grads[f"c{way}"] = total.sum(axis=0)
            d_x += total @ w[f"x{way}"].T
        some = keep["some"]
        if len(some):
            grads["word"] = (lexicon.word[some], d_x[:, :WORD_DIM])
            rows, begin = lexicon.trigrams(some)
            size = np.diff(begin)
            grads["gram"] = (rows, np.repeat(d_x[:, WORD_DIM:] / size[:, None], size, axis=0))
        return grads

    def logits(self, lexicon: Lexicon, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows given by first word and length, some at a time."""
        every = np.arange(len(lexicon.hashes))
        x = self.inputs(lexicon, every) if len(every) else np.zeros((1, WORD_DIM + GRAM_DIM), np.float32)
        gates = self._gates(x)
        out = np.empty(len(start), np.float32)
        for a in range(0, len(start), TOGETHER):
            index, live = gather(lexicon, start[a : a + TOGETHER], length[a : a + TOGETHER])
            out[a : a + TOGETHER] = self._pooled(gates, index, live, None)
        return out


def gather(lexicon: Lexicon, start: np.ndarray, length: np.ndarray):
    """(steps, windows) word numbers and which of them are there."""
    steps = np.arange(max(1, int(length.max(initial=0))))[:, None]
    live = steps < length
    at = np.where(live, start + steps, 0)
    index = lexicon.of[at] if len(lexicon.of) else np.zeros(at.shape, np.int64)
    return index, live.astype(np.float32)


class Adam:
    """Steps for plain arrays, and for rows of the tables that a batch has touched."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for name, grad in grads.items():
            rows: np.ndarray | slice = slice(None)
            if isinstance(grad, tuple):
                rows, where = np.unique(grad[0], return_inverse=True)
                order = np.argsort(where, kind="stable")
                grad = np.add.reduceat(grad[1][order], np.searchsorted(where[order], np.arange(len(rows))))
            m = self.m[name][rows] = 0.9 * self.m[name][rows] + 0.1 * grad
            v = self.v[name][rows] = 0.99 * self.v[name][rows] + 0.01 * grad * grad
            m, v = m / (1 - 0.9**self.t), v / (1 - 0.99**self.t)
            self.weights[name][rows] -= self.rate * m / (np.sqrt(v) + 1e-8)
