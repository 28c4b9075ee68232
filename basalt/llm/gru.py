"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, lanes of documents."""

from __future__ import annotations

import heapq
import math

import numpy as np


class Lanes:
    """Documents side by side: each lane holds whole documents one after the other, the longest lanes first.

    ``active`` tells how many lanes go on at a step, so steps that only few long documents reach are
    narrow. The table is kept to about four times the size of the documents by making fewer lanes.
    ``end`` is the id that closes a document, and what comes before its first word.
    """

    def __init__(self, docs: list[np.ndarray], width: int, end: int) -> None:
        lens = np.array([len(d) for d in docs], np.int64)
        lanes = int(max(1, min(width, len(docs), 4 * lens.sum() // max(1, lens.max())))) if len(docs) else 1
        ends, own = [(0, k) for k in range(lanes)], [(0, 0)] * len(docs)
        for i in np.argsort(-lens, kind="stable").tolist():
            at, k = heapq.heappop(ends)
            own[i] = (at, k)
            heapq.heappush(ends, (at + int(lens[i]), k))
        order = sorted(ends, reverse=True)
        new = {k: j for j, (_, k) in enumerate(order)}
        self.places = [(at, new[k]) for at, k in own]
        self.ends = np.array([e for e, _ in order], np.int64)
        self.steps = int(self.ends[0])
        self.target = np.full((self.steps, lanes), -1, np.int32)
        self.given = np.full((self.steps, lanes), end, np.int32)
        self.keep = np.ones((self.steps, lanes), np.bool_)
        for d, (at, k) in zip(docs, self.places):
            self.target[at : at + len(d), k] = d
            self.given[at + 1 : at + len(d), k] = d[:-1]
            self.keep[at, k] = False

    def windows(self, size: int):
        """The steps of each window, and how many lanes have any of them."""
        for at in range(0, self.steps, size):
            yield slice(at, at + size), int(np.searchsorted(-self.ends, -at))

    def sums(self, values: np.ndarray, docs: list[np.ndarray]) -> list[float]:
        return [float(values[at : at + len(d), k].sum(dtype=np.float64)) for d, (at, k) in zip(docs, self.places)]


def segments(docs: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Documents cut at every ``size`` tokens, for training: long ones then don't keep the other lanes waiting."""
    return [d[at : at + size] for d in docs for at in range(0, len(d), size)]


def _logistic(x: np.ndarray) -> np.ndarray:
    """In place; an exponential that is too large gives 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place; numpy's exp is much faster than its tanh."""
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable; short integers are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def _small(weight: np.ndarray) -> bool:
    """No state can give a logit above 80. What keeps out a missing word is negative and counts as nothing."""
    return bool((np.abs(weight[..., :-1, :]).sum(-2) + np.maximum(weight[..., -1, :], 0)).max() < 80)


def _scores(hs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these; states are below 1, so logits stay far below the limit set here, and mostly need not be looked at."""
    return _sums(hs @ weight, _small(weight))


def _sums(z: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not small:
        np.minimum(z, 80, out=z)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], np.float32)


class Gru:
    """h' = n + z (h - n). A word's probability is that of its class times, for a head word, its own within the class.

    ``head_words`` words, the most frequent first, have ids from 0 on and a place in one of ``side``
    classes of as many words each, so the work for a word grows with the square root of the head. All
    other words share the id and the class ``rest``; ``end`` closes a document.
    """

    NAMES = ("embed", "into", "into_b", "state", "state_b", "klass", "word")

    def __init__(self, head_words: int, width: int = 16, hidden: int = 24, seed: int = 3) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.hidden, self.side = hidden, max(2, math.isqrt(max(0, head_words - 1)) + 1)
        self.rest, self.end = self.side**2, self.side**2 + 1
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.embed = rng.normal(0, 0.3, (self.end + 1, width)).astype(np.float32)
        # Of the gates z and r and of the candidate n, in this order.
        self.into, self.into_b = draw(3, width, h), np.zeros((3, h), np.float32)
        self.state, self.state_b = draw(3, h, h), np.zeros(h, np.float32)
        # The last rows are the biases. Places without a word get no probability.
        self.klass, self.word = draw(h + 1, self.side + 2), rng.normal(0, 0.1, (self.side, h + 1, self.side)).astype(np.float32)
        self.klass[h] = self.word[:, h] = 0
        there = (np.arange(self.rest) < head_words).reshape(self.side, self.side)
        self.no_word = np.where(there, 0, -1e9).astype(np.float32)
        self.no_class = np.where(np.concatenate([there.any(1), [True, True]]), 0, -1e9).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def with_weights(self, flat: np.ndarray) -> Gru:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def _run(self, given: np.ndarray, keep: np.ndarray, h: np.ndarray, remember: bool):
        """States after each step, the last one, and with ``remember`` what the gradients need: states before, gates (z, r, n), and n's part of the state."""
        (steps, lanes), size = given.shape, self.hidden
        table = np.matmul(self.embed, self.into) + self.into_b[:, None]
        gates = np.take(table.reshape(-1, size), given[:, None, :] + (np.arange(3, dtype=np.int32) * len(self.embed))[:, None], axis=0)
        out, whole = np.empty((steps, lanes, size), np.float32), keep.all(1)
        own = np.empty((steps if remember else 1, 3, lanes, size), np.float32)
        before = np.empty((steps if remember else 1, lanes, size), np.float32)
        spare = np.empty((lanes, size), np.float32)
        with np.errstate(over="ignore"):
            for t in range(steps):
                at = t if remember else 0
                if whole[t]:
                    before[at] = h
                else:
                    np.multiply(h, keep[t][:, None], out=before[at])
                np.matmul(before[at], self.state, out=own[at])
                own[at, 2] += self.state_b
                gate = gates[t]
                gate[:2] += own[at, :2]
                _logistic(gate[:2])
                np.multiply(gate[1], own[at, 2], out=spare)
                gate[2] += spare
                n, h = _tanh(gate[2]), out[t]
                np.subtract(before[at], n, out=h)
                h *= gate[0]
                h += n
        return out, h, (before, gates, own[:, 2])

    def _classes(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = self.klass.copy()
        weight[-1] += self.no_class
        return _scores(hs, weight)

    def _words(self, hs: np.ndarray, classes: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_classes``, within each state's own class; states are in the classes' order."""
        weight, z = self.word.copy(), np.empty((len(hs), self.side), np.float32)
        weight[:, -1] += self.no_word
        for k, at in classes:
            np.matmul(hs[at], weight[k], out=z[at])
        return _sums(z, _small(weight))

    def _class_of(self, target: np.ndarray) -> np.ndarray:
        return np.where(target < self.rest, target // self.side, target - self.rest + self.side)

    def _by_class(self, klass: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The order of targets by class, the head's only, and where in it each class is."""
        order = _order(klass)
        ends = np.searchsorted(klass[order], np.arange(self.side + 1))
        return order[: ends[-1]], [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]

    def _told(self, hs: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where there is a target, those targets, and their states with a one behind for the bias."""
        some = np.flatnonzero(target.ravel() >= 0)
        rows = np.ones((len(some), self.hidden + 1), np.float32)
        rows[:, :-1] = hs.reshape(-1, self.hidden)[some]
        return some, target.ravel()[some], rows

    def log_probabilities(self, docs: list[np.ndarray], width: int = 512, window: int = 64) -> list[float]:
        """Natural log of each whole document: the state goes on from window to window."""
        lanes = Lanes(docs, width, self.end)
        values, h = np.zeros(lanes.target.shape, np.float32), np.zeros((lanes.target.shape[1], self.hidden), np.float32)
        for part, n in lanes.windows(window):
            hs, h, _ = self._run(lanes.given[part, :n], lanes.keep[part, :n], h[:n], False)
            some, own, rows = self._told(hs, lanes.target[part, :n])
            klass = self._class_of(own)
            z, _, total = self._classes(rows)
            p = z[np.arange(len(own)), klass] - np.log(total)
            order, classes = self._by_class(klass)
            rows, place = rows[order], own[order] % self.side
            z, _, total = self._words(rows, classes)
            p[order] += z[np.arange(len(z)), place] - np.log(total)
            flat = np.zeros(hs.shape[0] * n, np.float32)
            flat[some] = p
            values[part, :n] = flat.reshape(-1, n)
        return lanes.sums(values, docs)

    def _gradients(self, given, keep, target, h) -> tuple[list[np.ndarray], np.ndarray]:
        hs, last, (before, gates, own_n) = self._run(given, keep, h, True)
        some, own, rows = self._told(hs, target)
        klass, scale = self._class_of(own), np.float32(1 / max(1, len(own)))
        _, d, total = self._classes(rows)
        d *= (scale / total)[:, None]
        d[np.arange(len(own)), klass] -= scale
        g_klass, back = rows.T @ d, d @ self.klass[:-1].T
        g_word = np.zeros_like(self.word)
        order, classes = self._by_class(klass)
        rows, place, within = rows[order], own[order] % self.side, np.empty((len(order), self.hidden), np.float32)
        z, d, total = self._words(rows, classes)
        d *= (scale / total)[:, None]
        d[np.arange(len(d)), place] -= scale
        for k, at in classes:
            np.matmul(rows[at].T, d[at], out=g_word[k])
            np.matmul(d[at], self.word[k, :-1].T, out=within[at])
        back[order] += within
        g_out = np.zeros((hs.shape[0] * hs.shape[1], self.hidden), np.float32)
        g_out[some] = back
        g_out = g_out.reshape(hs.shape)
        z, r, n = gates[:, 0], gates[:, 1], gates[:, 2]
        to_z, to_r, to_n = (before - n) * z * (1 - z), own_n * r * (1 - r), (1 - z) * (1 - n * n)
        g_in, g_own_n = np.empty_like(gates), np.empty_like(hs)
        back_state, part = self.state.transpose(0, 2, 1), np.empty((3, *h.shape), np.float32)
        carried, spare = np.zeros_like(h), np.empty_like(h)
        for t in range(len(given) - 1, -1, -1):
            g, own_t = g_out[t], g_in[t]
            g += carried
            np.multiply(g, to_z[t], out=own_t[0])
            np.multiply(g, to_n[t], out=own_t[2])
            np.multiply(own_t[2], to_r[t], out=own_t[1])
            np.multiply(own_t[2], r[t], out=g_own_n[t])
            np.matmul(own_t[:2], back_state[:2], out=part[:2])
            np.matmul(g_own_n[t], back_state[2], out=part[2])
            np.multiply(g, z[t], out=carried)
            np.add(part[0], part[1], out=spare)
            spare += part[2]
            carried += spare
            carried *= keep[t][:, None]
        g_state = np.empty_like(self.state)
        flat = before.reshape(-1, self.hidden)
        into_flat = [np.ascontiguousarray(g_in[:, j]).reshape(-1, self.hidden) for j in range(3)]
        for j in range(3):
            g_state[j] = flat.T @ (into_flat[j] if j < 2 else g_own_n.reshape(-1, self.hidden))
        ids = given.ravel()
        words = self.embed[ids]
        g_into = np.stack([words.T @ x for x in into_flat])
        g_words = sum(x @ w.T for x, w in zip(into_flat, self.into))
        width, ones = self.embed.shape[1], np.ones(len(ids), np.float32)
        cells = (ids[:, None] * np.int64(width) + np.arange(width)).ravel()
        g_embed = np.bincount(cells, g_words.ravel(), self.embed.size).astype(np.float32).reshape(self.embed.shape)
        return [g_embed, g_into, np.stack([ones @ x for x in into_flat]), g_state, ones @ g_own_n.reshape(-1, self.hidden), g_klass, g_word], last

    def train(self, docs: list[np.ndarray], optimiser: Adam, width: int = 256, window: int = 24, segment: int = 1024) -> int:
        """One pass by truncated backpropagation; the state is carried over windows, gradients are not. Returns the number of tokens.

        Documents of more than ``segment`` tokens begin anew there, in training only.
        """
        docs = segments(docs, segment)
        if not docs:
            return 0
        lanes = Lanes(docs, width, self.end)
        h = np.zeros((lanes.target.shape[1], self.hidden), np.float32)
        for part, n in lanes.windows(window):
            grads, h = self._gradients(lanes.given[part, :n], lanes.keep[part, :n], lanes.target[part, :n], h[:n])
            optimiser.step([getattr(self, name) for name in self.NAMES], grads)
        return sum(map(len, docs))


class Adam:
    def __init__(self, rate: float, clip: float = 1.0) -> None:
        self.rate, self.clip, self.n, self.m, self.v = rate, clip, 0, None, None

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> None:
        """Changes the weights in place."""
        if self.m is None:
            self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        size = math.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        self.n += 1
        for w, g, m, v in zip(weights, grads, self.m, self.v):
            g *= np.float32(min(1.0, self.clip / (size + 1e-9)))
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.001) * (g - v)
            w -= np.float32(self.rate / (1 - 0.9**self.n)) * m / (np.sqrt(v / np.float32(1 - 0.999**self.n)) + np.float32(1e-8))
